"""Message aggregation, layers, the classification dataset, allowed tokens, bucketed scores and seeding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.functions import vectors as v
from kairograph.operators import classification as cl
from kairograph.operators import codes as co
from kairograph.operators import graph as gr
from kairograph.operators import layers as ly
from kairograph.operators import messages as ms
from kairograph.operators import training as tr
from kairograph.operators.seeding import seed_centroids
from kairograph.sources import score_store as ss

EDGES = [(0, 0, 1), (0, 0, 1), (2, 1, 1), (1, 1, 0), (3, 0, 9), (7, 0, 1)]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(k, [float(k + 1), 2.0 - k, 0.5 * k, 1.0]) for k in range(4)], "node long, h array<double>")
    return nodes, spark.createDataFrame(EDGES, "src long, rel long, dst long")


def numpy_layer(weights, bias=None):
    """Sum of h W_rel over incoming edges, over the in-degree; relu."""
    h = {k: np.array([k + 1, 2 - k, 0.5 * k, 1.0]) for k in range(4)}
    out = {}
    for k in h:
        came = [(s, r) for s, r, d in EDGES if d == k]
        total = sum((h[s] @ weights[r] for s, r in came if s in h and r in weights), np.zeros(next(iter(weights.values())).shape[1]))
        out[k] = np.maximum(total / max(len(came), 1) + (0 if bias is None else bias), 0)
    return out


def close(df, want):
    got = {r.node: np.array(r.h) for r in df.collect()}
    return set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_messages_by_columns(spark, graph):
    nodes, edges = graph
    got = ms.aggregate_messages(edges, {"top": F.col("src_h")[0] * F.col("dst_h")[0], "n": F.lit(1), "h": F.col("src_h"), "w": (F.col("src_h"), F.col("rel") + 1)}, {"top": F.max, "n": F.count, "h": ms.VectorSum(4, mean=True), "w": ms.VectorSum(4)}, src=nodes, dst=nodes)
    rows = {r.dst: r for r in got.collect()}
    assert set(rows) == {0, 1} and rows[1].top == 6.0 and rows[1].n == 3 and rows[1].h[0] == pytest.approx(5 / 3) and rows[1].w[0] == 8.0
    assert ms.aggregate_messages(edges.limit(0), {"n": F.lit(1)}, {"n": F.sum}).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "partial_sum" in plan


@pytest.mark.parametrize("compose", ["add", "sub", "mult"])
def test_composed_sums_equal_messages(spark, graph, compose):
    nodes, edges = graph
    relations = spark.createDataFrame([(0, [1.0, -1.0, 2.0, 0.0]), (1, [0.5, 0.5, 0.5, 3.0])], "rel long, h array<double>")
    slow = gr.message_sum(gr.gather(edges, nodes, relations, compose), gr.node_norms(edges), 4)
    fast = gr.scaled_sum(ms.composed_sum(edges, nodes, relations, 4, compose), gr.node_norms(edges))
    assert close(fast, {r.node: np.array(r.h) for r in slow.collect()})


def test_basis_layer(spark, graph):
    nodes, edges = graph
    rng = np.random.default_rng(0)
    bases, a = rng.normal(size=(3, 4, 5)), rng.normal(size=(2, 3))
    coefficients = spark.createDataFrame([(r, k, float(a[r, k])) for r in range(2) for k in range(3) if (r, k) != (0, 2)], "rel long, basis int, a double")
    a[0, 2] = 0
    weights = {r: np.einsum("k,kij->ij", a[r], bases) for r in range(2)}
    bias = rng.normal(size=5)
    assert close(ly.basis_layer(nodes, edges, coefficients, bases, bias=bias), numpy_layer(weights, bias))
    one_hot = nodes.select("node", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i == F.col("node")).cast("double")).alias("h"))
    table = spark.createDataFrame([(n, k, bases[k, n].tolist()) for n in range(4) for k in range(3)], "node long, basis int, h array<double>")
    want = {r.node: np.array(r.h) for r in ly.basis_layer(one_hot, edges, coefficients, bases, relu=False).collect()}
    assert close(ly.basis_input_layer(nodes, edges, coefficients, table, 5, relu=False), want)


def test_block_layer(spark, graph):
    nodes, edges = graph
    rng = np.random.default_rng(1)
    blocks = rng.normal(size=(2, 2, 2, 3))
    weights = {r: np.block([[blocks[r, 0], np.zeros((2, 3))], [np.zeros((2, 3)), blocks[r, 1]]]) for r in range(2)}
    table = spark.createDataFrame([(r, blocks[r].ravel().tolist()) for r in range(2)], "rel long, weight array<double>")
    assert close(ly.block_layer(nodes, edges, table, 2, 4, 6), numpy_layer(weights))
    assert close(ly.block_layer(nodes, edges, table.where("rel = 1"), 2, 4, 6), numpy_layer({1: weights[1]}))
    assert ly.block_layer(nodes.limit(0), edges, table, 2, 4, 6).count() == 0


def test_components_of_large_ids(spark):
    rows = [(0, 0, 1_000_005), (0, 5, 7), (1, 5, 1_000_005)]
    e = spark.createDataFrame(rows, "t long, s long, o long").select(F.struct("t", F.col("s").alias("e")).alias("src"), F.struct("t", F.col("o").alias("e")).alias("dst"))
    got = {tuple(r.node): tuple(r.component) for r in gr.components(e, lambda d: d).collect()}
    assert got == {(0, 0): (0, 0), (0, 1_000_005): (0, 0), (0, 5): (0, 5), (0, 7): (0, 5), (1, 5): (1, 5), (1, 1_000_005): (1, 5)}


def test_components_send_no_labels_through_the_driver(spark, tmp_path):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        path = str(tmp_path / str(len(plans)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6)], "src long, dst long")
    got = {r.node: r.component for r in gr.components(e, cut).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert not any("Broadcast" in p for p in plans)


def test_classification_dataset(spark):
    edges = spark.createDataFrame([(10, 0, 20), (30, 0, 20), (20, 1, 10), (20, 0, 40), (40, 0, 50), (60, 0, 70)], "src long, rel long, dst long")
    labels = spark.createDataFrame([(10, "a"), (60, "b"), (99, "c")], "node long, label string")
    out = cl.classification_dataset(edges, labels, labels.where("node = 10"), labels.where("node >= 60"), levels=1)
    number = {r.old: r.node for r in out["nodes"].collect()}
    assert number == {10: 0, 20: 1, 60: 2, 70: 3}
    assert sorted(map(tuple, out["edges"].select("src", "rel", "dst", "norm").collect())) == [(0, 0, 1, 1.0), (1, 1, 0, 1.0), (2, 0, 3, 1.0)]
    assert sorted(map(tuple, out["labels"].collect())) == [(0, "a"), (2, "b")] and out["train"].first().node == 0 and [r.node for r in out["test"].collect()] == [2]
    whole = cl.classification_dataset(edges, labels, labels, labels, levels=0, relabel=False)
    assert whole["edges"].count() == 6 and "nodes" not in whole and whole["edges"].where("dst = 20").first().norm == 0.5


def test_allowed_labels(spark):
    paths = spark.createDataFrame([([1, 2],), ([1, 3],), ([1, 2, 5],), ([],), (None,)], "path array<int>")
    rows = spark.createDataFrame([(0, [-100, 1, 2, 9]), (1, [1, 4, 7]), (2, [-100]), (3, [])], "id long, labels array<int>")
    got = {(r.id, r.position): r.allowed for r in tr.allowed_labels(rows, "id", paths, 9).collect()}
    assert got == {(0, 0): [1], (0, 1): [2, 3], (0, 2): [5, 9], (1, 0): [1], (1, 1): [2, 3, 4], (1, 2): [9, 7]}
    padded = tr.pad_allowed(tr.allowed_labels(rows, "id", paths, 9), F.col("id")).where("id = 1 AND position = 0").first()
    assert padded.allowed == [1, 0, 0] and padded["mask"] == [True, False, False]


def test_bucketed_scores_are_not_shuffled(spark, tmp_path):
    scores = spark.range(600).select((F.col("id") % 60).alias("row_index"), F.floor(F.col("id") / 60).alias("entity_id"), F.col("id").cast("double").alias("score"))
    path = f"file://{tmp_path}/scores"
    store = ss.write_store(scores, path, buckets=8)
    rows = spark.range(20).select((F.col("id") * 3).alias("row_index"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = ss.scores_at(store, rows)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert met.count() == 200 and met.agg(F.sum("score")).first()[0] == sum(i for i in range(600) if i % 60 in range(0, 60, 3))
    ss.check_store(store, scores.select("row_index").distinct(), 10)
    with pytest.raises(ValueError, match="has"):
        ss.check_store(store, spark.range(61).select(F.col("id").alias("row_index")), 10)
    spark.sql(f"DROP TABLE {ss._name(path)}")
    assert ss.open_store(spark, path, buckets=8).count() == 600


def test_seeds_over_all_rows(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.05, (40, 2)) for c in (0.0, 5.0, 10.0, 40.0)])
    rows = spark.createDataFrame([(p.tolist(),) for p in points] + [(points[0].tolist(),)] * 200 + [(None,)], "v array<double>")
    assert sorted(round(c[0] / 5) for c in seed_centroids(rows, 4, seed=3)) == [0, 1, 2, 8]
    same = spark.createDataFrame([([float(k % 3)],) for k in range(90)], "v array<double>")
    assert sorted(c[0] for c in seed_centroids(same, 3)) == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError, match="fewer than"):
        seed_centroids(same, 4)


def test_residual_fit_by_mini_batches_is_as_good(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(rng.normal(size=6).tolist(),) for _ in range(200)], "v array<double>").cache()
    rest = lambda books: co.encode(rows, books, 2).agg(F.avg(v.norm(F.col("residual")))).first()[0]
    assert rest(co.fit_residual(rows, 2, 8, steps=3, share=1.0)) <= 1.1 * rest(co.fit_codebooks(rows, 2, 8))
