"""Queries over all scores of the embedding table, on tables with many vectors a code, against SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.operators import dense as dn
from kairograph.plans.registry import ORACLE, QUERIES
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The embeddings four times with shifted numbers, so that a beam's codes hold more than 50 vectors."""
    path = str(tmp_path_factory.mktemp("repeated"))
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    e.crossJoin(spark.range(4).toDF("_k")).withColumn("vec_id", F.col("vec_id") + 500 * F.col("_k")).drop("_k").write.parquet(f"{path}/embeddings.parquet")
    return path


def rows_of(spark, path, name):
    df = QUERIES[name](spark, path)
    cols = sorted(df.columns)
    return cols, sorted(repr(plain(tuple(r))) for r in df.select(*cols).collect())


def sql_of(path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    result = con.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    return sorted(names), sorted(repr(plain(tuple(r[names.index(c)] for c in sorted(names)))) for r in result.fetchall())


@pytest.mark.parametrize("name", ["entity_ranking", "predictions_file", "metrics_by_mode"])
def test_ranked_entities_end_at_their_place(spark, repeated, name):
    assert rows_of(spark, repeated, name) == sql_of(repeated, name)


@pytest.mark.parametrize("name", ["mix_scores", "topk_mean", "group_log_softmax", "prefix_log_mass", "top_scores_file", "metrics_by_name", "scores_file", "bucketed_scores"])
def test_reduced_scores_match_sql(spark, repeated, name):
    assert rows_of(spark, repeated, name) == sql_of(repeated, name)


def vectors(spark):
    """Vectors with copies, missing components, a shorter one, none, and one that is not a number."""
    rng = np.random.default_rng(5)
    v = [[float(np.float32(x)) for x in r] for r in rng.normal(size=(40, 3))]
    v[7], v[8], v[20], v[21] = list(v[3]), list(v[3]), [1.0, None, 2.0], [1.0, 2.0]
    v[22], v[23] = None, [float("nan"), 1.0, 1.0]
    rows = [(i, x, f"{i % 3}", f"{i % 3}-{i % 5}") for i, x in enumerate(v)]
    return v, rows, spark.createDataFrame(rows, "id long, v array<double>, k0 string, k1 string")


def score(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    return float(f"{sum(x * y for x, y in zip(a, b)):.6f}")


def place(s):
    return (s is None, 0 if s is None else -(np.inf if np.isnan(s) else s))


def test_blocks_against_brute_force(spark):
    v, rows, df = vectors(spark)
    asked = [0, 3, 20, 21, 30]
    q = dn.blocks(df.where(F.col("id").isin(asked)).select("id", "v"), size=2)
    b = dn.blocks(df, ["k0", "k1"], size=8)
    near = lambda a, b: repr([None if x is None else round(x, 6) for x in a]) == repr([None if x is None else round(x, 6) for x in b])
    best = {(r["query"], r["key"]): r["best"] for r in dn.best_of_keys(q, b, [0, 1], 6).collect()}
    top = {(r["query"], r["key"]): r["top"] for r in dn.top_of_keys(q, b, [0, 1], 3, 6).collect()}
    mass = {(r["query"], r["key"]): r["mass"] for r in dn.log_mass_of_keys(q, b, [1], 6).collect()}
    assert len(best) == len(asked) * 18 and best.keys() == top.keys()
    for (i, key), got in best.items():
        own = sorted((score(v[i], r[1]) for r in rows if key in r[2:]), key=place)
        some = [s for s in own if s is not None]
        assert near([got], own[:1])
        assert near([s for s in top[i, key] if not np.isnan(s) and not np.isinf(s)], [s for s in some[:3] if not np.isnan(s)])
        if "-" in key and some and not any(np.isnan(some)):
            assert abs(mass[i, key] - np.log(sum(np.exp(some)))) < 1e-9
    first = {}
    for r in dn.best_of_queries(q, b, 4, 6).collect():
        first.setdefault(r["query"], []).append((place(r["score"]), r["entity"]))
    for i in asked:
        assert [e for _, e in sorted(first[i])[:4]] == [e for _, e in sorted((place(score(v[i], r[1])), r[0]) for r in rows)[:4]]


def test_members_against_brute_force(spark, tmp_path):
    v, rows, df = vectors(spark)
    dn.blocks(df, ["k0", "k1"], size=4).write.parquet(str(tmp_path / "b"))
    b = spark.read.parquet(str(tmp_path / "b"))
    asks = [(i, key, by_id, 2) for i in (0, 3, 20) for key in ("0-3", "1-1", "2-3") for by_id in (True, False)]
    wanted = spark.createDataFrame(asks, "query long, key string, by_id boolean, k long")
    got = {}
    for r in dn.members(wanted, df.where("id IN (0, 3, 20)").select("id", "v"), b, 1, 6).collect():
        got.setdefault((r["query"], r["key"], r["by_id"]), []).append((place(r["score"]) if not r["by_id"] else 0, r["entity"]))
    for i, key, by_id, k in asks:
        want = sorted((0 if by_id else place(score(v[i], r[1])), r[0]) for r in rows if r[3] == key)
        assert [e for _, e in sorted(got[i, key, by_id])[:k]] == [e for _, e in want[:k]]


def test_beams_look_at_codes_not_at_vectors(spark, repeated, monkeypatch):
    """What a beam search reads holds a row for each query and code, however many vectors have the code."""
    from kairograph.plans import codes as pc

    seen = {}
    real = pc.de.beam_decode
    monkeypatch.setattr(pc.de, "beam_decode", lambda queries, scored, *a, **k: seen.update(n=scored.count(), q=queries.count()) or real(queries, scored, *a, **k))
    pc._beams(spark, repeated)
    assert seen["n"] <= seen["q"] * 500


def test_score_lists_are_whole(spark, tmp_path):
    """Every pair is in a list, also where scores leave the short form; a missing list is noticed."""
    from kairograph.sources import sinks as sk

    v, rows, df = vectors(spark)
    df = df.withColumn("v", F.when(F.col("id") == 30, F.transform("v", lambda x: x * 1e9)).otherwise(F.col("v")))
    v[30] = [x * 1e9 for x in v[30]]
    asked = [0, 20, 30]
    lists = dn.score_lists(dn.blocks(df.where(F.col("id").isin(asked)).select("id", "v")), dn.blocks(df, size=8), 6)
    got = {(r["query"], r["entity"]): r["score"] for r in dn.flat_scores(lists, "query", 6).collect()}
    assert len(got) == 120
    for i in asked:
        for k in range(40):
            want, x = score(v[i], v[k]), got[i, k]
            assert (x is None) == (want is None) and (want is None or repr(x) == repr(want) or abs(x - want) <= 1e-6 + 1e-12 * abs(want))
    out = lists.select(F.lit("test").alias("split"), F.col("query").alias("row_index"), "ids", "units", "scores")
    sk.write_score_lists(out, str(tmp_path / "a"), queries=3, entities=40)
    with pytest.raises(ValueError):
        sk.write_score_lists(out.where("row_index < 30"), str(tmp_path / "b"), queries=3, entities=40)


def test_lists_are_looked_up_without_a_shuffle(spark, tmp_path):
    from kairograph.sources import score_store as ss

    lists = spark.range(60).select(F.col("id").alias("row_index"), F.array("id", F.col("id") + 1).alias("ids"))
    store = ss.write_lists(lists, f"file://{tmp_path}/lists", buckets=4)
    met = ss.lists_at(store, spark.range(20).select((F.col("id") * 3).alias("row_index")))
    assert "Exchange hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.ids[0] for r in met.collect()) == list(range(0, 60, 3))


def test_packed_scores_lose_nothing_and_are_small(spark, tmp_path):
    """Scores of vectors written in tiles take under a byte a pair (lists of them took three) and come back as they were,
    missing ones, ones that are no whole units, negative zeros and samples asked for twice included."""
    import os

    from kairograph.sources import sinks as sk

    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, r) for i, r in enumerate(rng.normal(size=(1500, 8)).tolist())], "id long, v array<double>")
    q = v.where("id % 3 = 0")
    tiles = dn.score_tiles(dn.blocks(q, size=256), dn.blocks(v, size=512), 6)
    path = f"file://{tmp_path}/tiles"
    sk.write_score_tiles(tiles.withColumn("split", F.lit("test")), path, queries=500, entities=1500)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "tiles") for f in names if f.endswith(".parquet"))
    assert size < 500 * 1500
    with pytest.raises(ValueError, match="not 501 x 1500"):
        sk.write_score_tiles(tiles.withColumn("split", F.lit("test")), f"{path}2", queries=501, entities=1500)
    asked = spark.createDataFrame([(0,), (3,), (3,), (4,), (1497,)], "id long")
    got = sorted((r["row_index"], r["entity"], r["score"]) for r in dn.unpacked_scores(sk.tiles_of(spark.read.parquet(path), asked), 6).collect())
    lists = dn.score_lists(dn.blocks(q), dn.blocks(v), 6).where("query IN (0, 3, 1497)")
    want = [(r["query"], e, s) for r in lists.select("query", "ids", dn.listed(6).alias("x")).collect() for e, s in zip(r["ids"], r["x"]) for _ in range(1 + (r["query"] == 3))]
    assert got == sorted(want) and len(got) == 4 * 1500


@pytest.mark.parametrize("kind", ["low", "full", "wide", "zero", "one"])
def test_packed_tiles_come_back(kind):
    rng = np.random.default_rng(3)
    s = {
        "low": np.round(rng.normal(size=(300, 5)) @ rng.normal(size=(5, 400)), 6), "full": np.round(rng.normal(size=(300, 400)), 6), "wide": rng.integers(-(2**31) + 1, 2**31, (3, 7)) / 1e6,
        "zero": np.zeros((9, 4)), "one": np.full((1, 1), -2.5),
    }[kind]
    there = (rng.random(s.shape) if kind != "low" else np.maximum.outer(np.ones(len(s)) * 0.05, rng.random(s.shape[1]))) > 0.1
    s[~there] = -np.inf
    if kind == "low":
        s[7, 0], s[8, 1], s[9, 2], s[10, 3] = np.nan, np.inf, -0.0, 1e300
        there[7:11] = True
        there[5] = False
        s[5] = -np.inf
    tiles = list(dn.pack_tile(np.arange(len(s)) * 2, s, there, np.arange(s.shape[1]), 6))
    assert any(t["left"] is not None for t in tiles) == (kind == "low") and sum(len(t["queries"]) for t in tiles) == len(s)
    for t in tiles:
        ids, x, own = dn.unpack_tile(t, np.arange(len(t["queries"])), 6)
        at = ids // 2
        assert (own == there[at]).all() and [repr(a) for a in x[own]] == [repr(a) for a in s[at][own]]
