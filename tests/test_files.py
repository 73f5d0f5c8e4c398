"""Readers and writers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.sources import readers as rd
from kairograph.sources import sinks as sk


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return "file://" + str(path)


def test_id_names(spark, tmp_path):
    p = put(tmp_path / "e.txt", "A_b\t1\n\nbroken\nC\t2\tmore\nA_b\t3\n")
    assert [(r.id, r.name) for r in rd.read_id_names(spark, p).orderBy("seq").collect()] == [(1, "A b"), (2, "C"), (3, "A b")]
    assert [r.id for r in rd.read_id_names(spark, p, fields="exact").orderBy("seq").collect()] == [1, 3]
    with pytest.raises(Exception, match="no tab in line"):
        rd.read_id_names(spark, p, fields="strict").collect()
    assert {r.name: r.id for r in rd.name_to_id(rd.read_id_names(spark, p)).collect()} == {"A b": 3, "C": 2}


def test_facts(spark, tmp_path):
    p = put(tmp_path / "d/X/train.txt", "0 1 2 3 9\n\n4 5\n1\t1  2 4\n")
    put(tmp_path / "d/X/test.txt", "7 0 7 9\n")
    put(tmp_path / "d/X/entity2id.txt", "a\t0\n")
    put(tmp_path / "d/X/relation2id.txt", "r\t0\n")
    assert [(r.s, r.r, r.o, r.t) for r in rd.read_facts(spark, p).orderBy("seq").collect()] == [(0, 1, 2, 3), (1, 1, 2, 4)]
    assert rd.read_facts(spark, p + ".missing").count() == 0
    with pytest.raises(Exception):
        rd.read_facts(spark, p + ".missing", strict=True).count()
    d = rd.read_dataset(spark, "file://" + str(tmp_path / "d"), "X")
    assert [r.split for r in d["facts"].orderBy("seq").collect()] == ["train", "train", "test"]


def test_descriptions(spark, tmp_path):
    p = put(tmp_path / "d.csv", '﻿ID;Name;Description\n1;a;"x; ""y"""\n2;b;z\n')
    assert [(r.id, r.description) for r in rd.read_descriptions(spark, p).orderBy("id").collect()] == [(1, 'x; "y"'), (2, "z")]
    with pytest.raises(ValueError, match="repeats id 1"):
        rd.read_descriptions(spark, put(tmp_path / "e.csv", "id,name,description\n1,a,b\n1,c,d\n"))
    with pytest.raises(ValueError, match="no column description"):
        rd.read_descriptions(spark, put(tmp_path / "f.csv", "id,name\n1,a\n"))


def test_matrices_and_triples(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.savez(tmp_path / "m.npz", x=np.ones((1, 2)))
    base = "file://" + str(tmp_path)
    assert [r.v for r in rd.read_matrix(spark, base + "/m.npy").orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    assert rd.read_matrix(spark, base + "/m.npz", "x").first().v == [1, 1]
    p = put(tmp_path / "g.nt", '<a> <p> "x y" .\n# note\n_:b <p> <c> .\n')
    assert [(r.s, r.o) for r in rd.read_triples(spark, p).orderBy("s").collect()] == [("<a>", '"x y"'), ("_:b", "<c>")]


def test_samples(spark, tmp_path):
    lines = put(tmp_path / "a.jsonl", '{"id": 1, "input": "p"}\n{"id": 2}\n')
    array = put(tmp_path / "a.json", json.dumps([{"id": 1}, {"id": 2}]))
    held = put(tmp_path / "b.json", json.dumps({"samples": [{"id": 1}, {"id": 3}]}))
    form = "id long, input string"
    assert rd.read_samples(spark, lines, form).count() == 2
    assert {r.id for r in rd.read_samples(spark, array, form, lines=False).collect()} == {1, 2}
    assert {r.id for r in rd.read_samples(spark, held, form, lines=False).collect()} == {1, 3}
    with pytest.raises(Exception):
        rd.read_samples(spark, put(tmp_path / "c.jsonl", "{broken\n"), form).collect()
    f = rd.sample_fields(rd.read_samples(spark, lines, form)).orderBy("id").first()
    assert f.prompt_of == "p" and f.mode_of is None


def test_codes(spark, tmp_path):
    p = put(tmp_path / "c.tsv", "entity_id\tentity_name\tz0\tz1\tcode\n4\tx\t1\t12\t1-12\n")
    codes = rd.read_codes(spark, p)
    tokens = rd.read_token_map(spark, put(tmp_path / "t.json", json.dumps({"<z1_01>": {"level": 1, "code_index": 1}, "<z2_12>": {"level": 2, "code_index": 12}})))
    assert {(r.level, r.token) for r in rd.attach_tokens(codes, tokens).collect()} == {(0, "<z1_01>"), (1, "<z2_12>")}
    with pytest.raises(Exception, match="no token for level"):
        rd.attach_tokens(codes, tokens.where("level = 1")).collect()
    m = rd.read_code_map(spark, put(tmp_path / "m.json", json.dumps({"4": "<z1_01><z2_12>"})))
    assert {(r.entity_id, r.level, r.code) for r in m.collect()} == {(4, 1, 1), (4, 2, 12)}
    assert rd.read_word_graph(spark, put(tmp_path / "w.txt", "1\t2\t3\n")).first() == (1, 2, 3)


def test_sinks(spark, tmp_path):
    base = "file://" + str(tmp_path)
    s = spark.createDataFrame([("test", 0, 0, 1.0), ("test", 0, 1, 2.0)], "split string, row_index long, entity_id long, score double")
    sk.write_scores(s, base + "/s", queries=1, entities=2)
    with pytest.raises(ValueError):
        sk.write_scores(s, base + "/s2", queries=2, entities=2)
    top = spark.createDataFrame([(0, 1, 5, 0.5), (0, 2, 3, 0.25)], "row_index long, place int, entity long, score double")
    sk.write_top_scores(top, base + "/t")
    assert spark.read.json(base + "/t").first().topk_ids == [5, 3]
    m = spark.createDataFrame([(0.5,)], "mrr double")
    sk.append_metrics(m, base + "/m")
    sk.append_metrics(m, base + "/m")
    assert spark.read.csv(base + "/m", header=True).count() == 2
    rows = spark.createDataFrame([(9, "n9"), (2, "n2")], "id long, name string")
    sk.write_index(rows, base + "/i")
    assert {(r.id, r.row_index) for r in spark.read.csv(base + "/i", sep="\t", header=True).collect()} == {("2", "0"), ("9", "1")}
    sk.write_descriptions(rows.withColumn("description", F.lit('a "b"')), base + "/d")
    assert spark.read.csv(base + "/d", header=True, escape='"').first().description == 'a "b"'
    sk.write_predictions(rows, m, base + "/p")
    coded = spark.createDataFrame([(1, "0-0")], "entity_id long, code string")
    sk.write_codes(coded, spark.createDataFrame([(0, 0, [1.0])], "level int, code int, centroid array<double>"), base + "/c")
    assert spark.read.parquet(base + "/c/tokens").first().token == "<z1_00>"


def test_link_dataset(spark, tmp_path):
    put(tmp_path / "L/entity2id.txt", "a\t0\nb\t1\n")
    put(tmp_path / "L/relation2id.txt", "r_x\t0\n")
    put(tmp_path / "L/train.txt", "0\t0\t1\t5\t9\n")
    put(tmp_path / "L/valid.txt", "0\t0\t1\n")
    folder = "file://" + str(tmp_path / "L")
    put(tmp_path / "L/test.txt", "1\t0\t7\t5\n")
    static = rd.read_link_dataset(spark, folder, timed=False)
    assert static["train"].columns == ["seq", "s", "r", "o"] and [(r.s, r.r, r.o) for r in static["valid"].collect()] == [(0, 0, 1)]
    assert {r.name for r in static["relations"].collect()} == {"r_x"}
    timed = rd.read_link_dataset(spark, folder)
    assert timed["train"].first().t == 5
    with pytest.raises(Exception, match="too few fields"):
        timed["valid"].collect()
    with pytest.raises(Exception, match="no name in entities for id 7"):
        timed["test"].collect()


def test_descriptions_with_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 'x, "y"'), (2, "b", None)], "id long, name string, description string").coalesce(1)
    sk.write_descriptions(rows, f"file://{tmp_path}/d", mark=True)
    assert next((tmp_path / "d").glob("part-*")).read_bytes().startswith("\ufeffid,name".encode())
    assert sorted(tuple(r) for r in rd.read_descriptions(spark, f"file://{tmp_path}/d").collect()) == [(1, "a", 'x, "y"'), (2, "b", None)]
