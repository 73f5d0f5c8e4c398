"""Text, score and vector expressions, graph layers, codes and training items."""

import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kairograph.functions import scores as sc
from kairograph.functions import text as tx
from kairograph.functions import vectors as v
from kairograph.operators import codes as co
from kairograph.operators import context as cx
from kairograph.operators import decode as de
from kairograph.operators import graph as gr
from kairograph.operators import training as tr


def one(spark, expr, **cols):
    return spark.range(1).select(*(F.lit(x).alias(k) for k, x in cols.items())).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "f, given, want",
    [
        (tx.normalize_text, "  A\t b\n C ", "a b c"),
        (tx.normalize_label, "<some_label>", "some label"),
        (tx.normalize_label, "<", "<"),
        (tx.normalize_entity_text, " The_Big  Name ", "the big name"),
        (lambda c: tx.normalize_description(c, 100), "One. Two!  Three? Four. Five.", "One. Two! Three? Four."),
        (lambda c: tx.normalize_description(c, 10), "abcdef ghijkl", "abcdef..."),
        (lambda c: tx.normalize_description(c, 10), "", ""),
        (tx.contains_cjk, "a 漢", True),
        (tx.contains_cjk, "a é", False),
        (tx.parse_code_tokens, "<z1_00><z2_11>", ["<z1_00>", "<z2_11>"]),
        (tx.parse_code_tokens, " a  b ", ["a", "b"]),
        (tx.looks_like_code, " <a> ", True),
        (lambda c: F.transform(tx.parenthesis_words(c), lambda w: w["word"]), "Name (Place)", ["Name", "Place"]),
        (lambda c: F.transform(tx.parenthesis_words(c), lambda w: w["word"]), "Plain", ["Plain"]),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f(F.col("c")), c=given) == want


def test_code_token(spark):
    assert one(spark, tx.code_token(F.lit(1), F.lit(7))) == "<z1_07>"
    assert one(spark, tx.code_token(F.lit(2), F.lit(123))) == "<z2_123>"


def test_prefix_fusion_golden(spark):
    codes = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)], "e long, z0 int, z1 int")
    scored = spark.createDataFrame([(0, k, x) for k, x in enumerate((-1.0, -2.0, -0.5, -3.0))], "query long, entity long, score double")
    table = de.prefix_table(codes, 2, "e")
    llm = lambda d: d.withColumn("llm_raw", F.when(F.col("token") == 0, F.log(F.lit(0.7))).otherwise(F.log(F.lit(0.3))))
    q = spark.createDataFrame([(0,)], "query long")
    got = {r.prefix: r for r in de.beam_decode(q, scored, table, 1, llm, alphas=[0.5], beams=5).where("mode = 'hybrid'").collect()}
    assert math.isclose(got["0"].graph_score, -0.974076984, abs_tol=1e-8) and math.isclose(got["0"].score, -0.618465895, abs_tol=1e-8)
    assert math.isclose(got["1"].graph_score, -0.474076984, abs_tol=1e-8) and math.isclose(got["1"].score, -0.773859170, abs_tol=1e-8)


def test_softmax_family(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("b", None), ("c", 2.0), ("c", 2.0)], "g string, x double")
    g = W.partitionBy("g")
    rows = d.select("g", sc.log_softmax(F.col("x"), g).alias("l"), sc.minmax_softmax(F.col("x"), g).alias("m"), sc.clipped_share(F.col("x"), g).alias("s")).collect()
    for k in "abc":
        assert math.isclose(sum(math.exp(r.l) for r in rows if r.g == k), 1)
    assert all(math.isclose(r.m, 0.5) and math.isclose(r.s, 0.5) for r in rows if r.g == "c")
    assert sorted(r.s for r in rows if r.g == "a") == [0.25, 0.75]


def test_mix(spark):
    mix = lambda a, b, k: one(spark, sc.mix_log_probs(F.lit(a).cast("double"), F.lit(b).cast("double"), F.lit(k)))
    assert mix(-1.0, -2.0, 0.0) == -1.0 and mix(-1.0, -2.0, 1.0) == -2.0
    assert math.isclose(mix(None, -2.0, 0.5), -2 + math.log(0.5)) and mix(None, -2.0, 0.0) is None
    assert sc.alpha_of_level(1, None, 0.5) == 0 and sc.alpha_of_level(3, None, 0.5) == 0.5 and sc.alpha_of_level(0, [0.1], 0) == 0.1


def test_relational_layer_matches_numpy(spark):
    rng = np.random.default_rng(0)
    h, rel, w, s, lone = rng.normal(size=(4, 3)), rng.normal(size=(2, 3)), *rng.normal(size=(3, 3, 3))
    edges = [(0, 0, 1), (2, 1, 1), (1, 0, 2), (0, 0, 1)]
    nodes = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(h)], "node long, h array<double>")
    rels = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rel)], "rel long, h array<double>")
    e = spark.createDataFrame(edges, "src long, rel long, dst long")
    for compose, op in (("add", np.add), ("sub", np.add), ("mult", np.multiply)):
        got = {r.node: r.h for r in gr.relational_layer(nodes, e, rels, w, s, lone, compose=compose).collect()}
        for k in range(4):
            into = [op(h[a], rel[r]) @ w for a, r, b in edges if b == k]
            want = np.maximum(sum(into) / len(into) + h[k] @ s if into else h[k] @ lone, 0)
            assert np.allclose(got[k], want)


def test_components_and_levels(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in gr.components(e, lambda d: d.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else d.persist()).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, 7: 7}
    assert gr.components(e.limit(0), lambda d: d).count() == 0
    lv = {r.node: r.level for r in gr.bfs_levels(e, spark.createDataFrame([(5,)], "node long"), 2).collect()}
    assert lv == {5: 0, 4: 1, 3: 2}


def test_fitted_codes_lower_the_residual(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(4, 5))
    rows = spark.createDataFrame([(k, [float(x) for x in centre[k % 4] + 0.01 * rng.normal(size=5)]) for k in range(60)], "id long, v array<double>")
    books = co.fit_codebooks(rows, 2, 4)
    enc = co.encode(rows, books, 2)
    assert enc.select("z0").distinct().count() == 4 and enc.agg(F.max("norm0")).first()[0] < 0.1
    plain = co.fit_codebooks(rows, 2, 4, normalize=False)
    dec = co.decode(co.encode(rows, plain, 2, normalize=False), plain, 2)
    assert dec.agg(F.max(v.squared_distance(F.col("v"), F.col("decoded")))).first()[0] < 0.01
    with pytest.raises(ValueError):
        old, co.MAX_CODEBOOK = co.MAX_CODEBOOK, 3
        try:
            co.codebook_row(books, 0)
        finally:
            co.MAX_CODEBOOK = old


def test_training_items(spark):
    d = spark.createDataFrame([(1, [5, 6], [7]), (2, [], [8])], "id long, p array<int>, o array<int>")
    rows = tr.items(d, F.col("p"), F.col("o"), end_id=1)
    got = {r.id: r for r in tr.padded(rows, F.lit(0), pad_id=0).collect()}
    assert got[1].input_ids == [5, 6, 7, 1, 0, 0, 0, 0] and got[1].labels == [-100, -100, 7, 1] + [-100] * 4
    assert got[2].attention_mask == [1, 1] + [0] * 6


def test_pending_and_messages(spark):
    items = spark.createDataFrame([("entity", 1, "A"), ("relation", 2, "B")], "kind string, id long, name string")
    done = spark.createDataFrame([("entity", 1, "text"), ("relation", 2, " ")], "kind string, id long, description string")
    assert [r.id for r in cx.pending(items, done).collect()] == [2] and cx.pending(items, done, force=True).count() == 2
    top = spark.createDataFrame([("entity", 1, 1, "x; freq=2")], "kind string, id long, place int, text string")
    got = {r.id: r.messages[1].content for r in cx.messages(items, top, system="s", task=F.lit("T.")).collect()}
    assert "- x; freq=2" in got[1] and "- NONE" in got[2] and "Relation name: B" in got[2]


def test_filters_resolve(spark):
    f = spark.createDataFrame([(1, " 12 "), (1, "<z1_00><z2_01>"), (1, "Some_Name"), (1, ""), (1, "nobody")], "id long, filter string")
    names = spark.createDataFrame([("some name", 5)], "name string, entity long")
    codes = spark.createDataFrame([("<z1_00><z2_01>", 7), ("<z1_00><z2_01>", 8)], "tokens string, entity long")
    assert {r.entity for r in de.resolve_filters(f, names, codes).collect()} == {12, 5, 7, 8}


def test_centroids_by_mini_batches(spark):
    import numpy as np

    from kairograph.operators import codes as co

    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.05, (60, 2)) for c in (0.0, 5.0, 10.0)])
    rows = spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>")
    book = co.fit_centroids(rows, 3, steps=4, share=0.5, seed=1).collect()
    assert sorted(round(b.centroid[0]) for b in book) == [0, 5, 10]
    assert 0 < sum(b.n for b in book) < 4 * 180
    with pytest.raises(ValueError, match="fewer than"):
        co.fit_centroids(rows.limit(2), 3)


def test_odd_names_and_coverage(spark):
    from kairograph.functions import text as tx
    from kairograph.operators import context as cx
    from kairograph.operators import ranking as rk

    row = spark.range(1).select(tx.embedding_input(F.lit("a"), F.lit("b "), "").alias("x"), tx.embedding_input(F.lit("a"), F.lit("b"), " do ").alias("y")).first()
    assert tuple(row) == ("a. b", "Instruct: do\nQuery: a. b")
    items = spark.createDataFrame([("entity", 1), ("entity", 2), ("relation", 1)], "kind string, id long")
    done = spark.createDataFrame([("entity", 1, "x"), ("entity", 1, "y"), ("entity", 2, " ")], "kind string, id long, description string")
    seen = spark.createDataFrame([("relation", 1), ("relation", 1)], "kind string, id long")
    assert sorted(map(tuple, cx.coverage(items, done, seen).collect())) == [("entity", 2, 1, 0), ("relation", 1, 0, 1)]
    listed = spark.createDataFrame([(1, 1, "B"), (1, 2, "b "), (1, 3, "c"), (1, 4, " A"), (2, 1, "z")], "id long, place int, item string")
    goal = spark.createDataFrame([(1, "a"), (2, "y")], "id long, item string")
    out = rk.metrics_by_name(listed, goal, spark.createDataFrame([(1, "C"), (1, "A")], "id long, item string")).first()
    assert (out.num_eval, out.mrr, out.hits_1, out.hits_3) == (2, 1 / 6, 0.0, 0.5)


def test_log_mass_in_one_pass(spark):
    from kairograph.operators import decode as de

    scored = spark.createDataFrame([(1, 1, 250.0), (1, 2, 249.0), (1, 3, -900.0), (1, 4, None), (2, 3, -900.0), (2, 4, -901.0), (3, 4, None)], "query long, entity long, score double")
    table = spark.createDataFrame([(1, "", 0, "0", e) for e in (1, 2, 3, 4)], "level int, parent string, token int, prefix string, entity long")
    out = de.prefix_log_mass(scored, table)
    got = {r.query: r.mass for r in out.collect()}
    assert abs(got[1] - 250.3132616875182) < 1e-9 and abs(got[2] + 899.6867383124818) < 1e-9 and got[3] is None
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
