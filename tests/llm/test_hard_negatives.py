"""Hard negatives against SQL and brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.llm import hard_negatives as hn
from kairograph.llm.queries import ORACLE, QUERIES


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_query_is_sql(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE["op12_hard_negatives"]).fetchall())
    assert len(want) > 100 and rows_of(QUERIES["op12_hard_negatives"](spark, sf)) == want


def brute(rows, anchors, positives=5, negatives=10):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, lab, list(v)) for i, lab, v in sorted({(i, lab, tuple(v)) for i, lab, v in ok})]
    out = []
    for i, lab, v in ok:
        if not anchors(i):
            continue
        s = [(-sum(a * b for a, b in zip(v, w)), j, other == lab) for j, other, w in ok if j != i and len(w) == len(v)]
        for ps, pid, _ in sorted(x for x in s if x[2])[:positives]:
            hard = sorted(x for x in s if not x[2] and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:negatives]
            out += [(i, pid, k + 1, j, -ps, -ns) for k, (ns, j, _) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [64, 100_000])
def test_many_shards_copies_and_ties(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    rows = [(k, int(k % 3), (centre[k % 6] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(500)]
    rows += [(500 + k, 1, rows[7][2]) for k in range(150)] + [(700 + k, k % 2, [float(k % 4), 0.0]) for k in range(40)]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(7)
    got = rows_of(hn.mine_hard_negatives(d, F.col("vec_id") % 9 == 0, shard_rows=shard_rows))
    assert got == brute(rows, lambda i: i % 9 == 0) and len(got) > 1000


def test_near_queries_read_few_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(k, 0, ((20 if k % 8 == g else 0) + rng.normal(size=1)).tolist() * 4) for k in range(4000) for g in [k % 3]]
    v = hn.integer_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    index = hn.build_index(v, shard_rows=200)
    assert index.blocks.agg(F.sum("rows")).first()[0] == 4000 and index.shards == 20
    order = index.blocks.select("shard", "pivot", "low", "high").collect()
    assert all(b.low <= b.high for b in order) and len({b.shard for b in order}) == 20


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [nan, 1.0]), (7, 2, [None, 1.0]), (8, 2, [inf, 0.0]),
            (None, 2, [0.5, 0.5]), (9, 2, [0.0, 0.0]), (10, 2, [0.5]), (11, 1, [-1.0, -1.0]), (12, 3, []), (13, 3, []), (14, 2, []), (15, 1, [900.0, 0.0]), (16, 2, [0.0, 1000.0])]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rank", F.lit("own")).withColumn("ask", F.lit("own"))
    got = rows_of(hn.mine_hard_negatives(d, F.lit(True)))
    assert got == brute(rows, lambda i: True) and {(0, 1), (9, 2), (12, 13)} <= {x[:2] for x in got}
    assert hn.mine_hard_negatives(d.limit(0), F.lit(True)).count() == 0
    assert hn.mine_hard_negatives(d.where("vec_id = 2"), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(k, k % 2, [3e5 * (k + 1), 1e5 * k]) for k in range(9)], "vec_id long, label int, embedding array<double>")
    assert rows_of(hn.mine_hard_negatives(huge, F.lit(True))) == brute([tuple(r) for r in huge.collect()], lambda i: True)
    with pytest.raises(Exception, match="too large"):
        hn.mine_hard_negatives(spark.createDataFrame([(1, 1, [1e30])], "vec_id long, label int, embedding array<double>"), F.lit(True))
