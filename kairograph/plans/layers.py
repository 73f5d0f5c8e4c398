"""Basis and block layers, and the entity-classification dataset, over the event facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classification as cl
from ..operators import layers as ly
from .common import BOTH, FACTS, query, table, written
from .graphs import _NODES, WIDTH, _edges, _nodes

BASES, BLOCKS = 3, 8
SIDE = WIDTH // BLOCKS
#: Fixed rules for the weights, the same in both engines.
BASIS_WEIGHTS = [[[((i * 3 + j * 5 + k) % 7 - 3) / 20 for j in range(WIDTH)] for i in range(WIDTH)] for k in range(BASES)]
BIAS = [(j % 5 - 2) / 10 for j in range(WIDTH)]


def _long(df):
    """One row for each component, away from halves so that both engines round alike."""
    return df.select("node", F.posexplode("h").alias("i", "x")).select("node", "i", F.round(F.col("x") + 1e-9, 6).alias("x"))


def _coefficients(edges):
    """(rel, basis, a) by a rule of both numbers."""
    rel = edges.select("rel").distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(BASES - 1))).alias("basis")
    return rel.select("rel", k).select("rel", "basis", ((F.col("rel") * 5 + F.col("basis") * 3) % 7 - 3).cast("double").alias("a"))


_IN = f"{FACTS}, {BOTH}, {_NODES}, nn AS (SELECT o AS node, count(*) AS degree FROM b GROUP BY o)"
_OUT = f"SELECT nd.node, j::INT AS i, round(greatest(coalesce(y / degree, 0) + (j % 5 - 2) / 10.0, 0.0) + 1e-9, 6) AS x FROM nd CROSS JOIN range({WIDTH}) w(j) LEFT JOIN su ON su.node = nd.node AND su.c = j LEFT JOIN nn ON nn.node = nd.node"


@query(
    f"{_IN}, sb AS MATERIALIZED (SELECT o AS node, k, i, sum(((r * 5 + k * 3) % 7 - 3) * a.h[i + 1]) AS x FROM b JOIN nd a ON a.node = b.s CROSS JOIN range({BASES}) ks(k) CROSS JOIN range({WIDTH}) w(i) GROUP BY o, k, i), "
    f"su AS MATERIALIZED (SELECT node, j AS c, sum(x * ((i * 3 + j * 5 + k) % 7 - 3) / 20.0) AS y FROM sb CROSS JOIN range({WIDTH}) w(j) GROUP BY node, j) {_OUT}"
)
def basis_layer(spark, sf_dir):
    e, _ = _edges(spark, sf_dir)
    e = written(e.drop("t"))
    return _long(ly.basis_layer(_nodes(spark, sf_dir), e, _coefficients(e), BASIS_WEIGHTS, bias=BIAS))


@query(
    f"{_IN}, su AS MATERIALIZED (SELECT o AS node, j AS c, sum(((r * 5 + k * 3) % 7 - 3) * ((s * 3 + j * 5 + k) % 7 - 3) / 20.0) AS y FROM b JOIN nd a ON a.node = b.s CROSS JOIN range({BASES}) ks(k) CROSS JOIN range({WIDTH}) w(j) GROUP BY o, j) {_OUT}"
)
def basis_input_layer(spark, sf_dir):
    """The input layer: a node sends its row of the bases."""
    e, _ = _edges(spark, sf_dir)
    e, nodes = written(e.drop("t")), _nodes(spark, sf_dir)
    row = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: ((F.col("node") * 3 + j * 5 + F.col("basis")) % 7 - 3) / F.lit(20.0))
    bases = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(BASES - 1))).alias("basis")).select("node", "basis", row.alias("h"))
    return _long(ly.basis_input_layer(nodes, e, _coefficients(e), bases, WIDTH, bias=BIAS))


@query(
    f"{_IN}, sr AS MATERIALIZED (SELECT o AS node, r, i, sum(a.h[i + 1]) AS x FROM b JOIN nd a ON a.node = b.s CROSS JOIN range({WIDTH}) w(i) GROUP BY o, r, i), "
    f"su AS MATERIALIZED (SELECT node, (i // {SIDE}) * {SIDE} + q AS c, sum(x * ((i * {SIDE} + q + r) % 9 - 4) / 20.0) AS y FROM sr CROSS JOIN range({SIDE}) w(q) GROUP BY ALL) {_OUT}"
)
def block_layer(spark, sf_dir):
    """A relation's blocks hold ((place in the blocks + relation) % 9 - 4) / 20."""
    e, _ = _edges(spark, sf_dir)
    e = written(e.drop("t"))
    weight = F.transform(F.sequence(F.lit(0), F.lit(WIDTH * SIDE - 1)), lambda p: ((p + F.col("rel")) % 9 - 4) / F.lit(20.0))
    weights = e.select("rel").distinct().select("rel", weight.alias("weight"))
    return _long(ly.block_layer(_nodes(spark, sf_dir), e, weights, BLOCKS, WIDTH, WIDTH, bias=BIAS))


#: Every fortieth vector's label is a node's class; every eightieth trains.
_CLASS = f"""{FACTS}, {BOTH}, e AS MATERIALIZED (SELECT DISTINCT s AS src, r AS rel, o AS dst FROM b), l0 AS MATERIALIZED (SELECT vec_id AS node, label FROM embeddings WHERE vec_id % 40 = 0),
near AS MATERIALIZED (SELECT node FROM l0 UNION SELECT dst FROM e JOIN l0 ON src = node), k AS MATERIALIZED (SELECT e.* FROM e WHERE src IN (FROM near) AND dst IN (FROM near)),
nu AS MATERIALIZED (SELECT old, row_number() OVER (ORDER BY old) - 1 AS node FROM (SELECT src AS old FROM k UNION SELECT dst FROM k))"""


def _dataset(spark, sf_dir):
    e, _ = _edges(spark, sf_dir)
    e = written(e.drop("t").distinct())
    labels = table(spark, sf_dir, "embeddings").where("vec_id % 40 = 0").select(F.col("vec_id").alias("node"), "label")
    return cl.classification_dataset(e, labels, labels.where("node % 80 = 0"), labels.where("node % 80 <> 0"), levels=1, cut=written)


@query(f"{_CLASS} SELECT a.node AS src, rel, d.node AS dst, round(1.0 / count(*) OVER (PARTITION BY d.node, rel), 9) AS norm FROM k JOIN nu a ON a.old = src JOIN nu d ON d.old = dst")
def classification_edges(spark, sf_dir):
    return _dataset(spark, sf_dir)["edges"].withColumn("norm", F.round("norm", 9))


@query(f"{_CLASS} SELECT nu.node, label FROM l0 JOIN nu ON old = l0.node")
def classification_labels(spark, sf_dir):
    return _dataset(spark, sf_dir)["labels"]


@query(f"{_CLASS} SELECT nu.node FROM l0 JOIN nu ON old = l0.node WHERE old % 80 = 0")
def classification_train(spark, sf_dir):
    return _dataset(spark, sf_dir)["train"]


@query(f"{_CLASS} SELECT nu.node FROM l0 JOIN nu ON old = l0.node WHERE old % 80 <> 0")
def classification_test(spark, sf_dir):
    return _dataset(spark, sf_dir)["test"]
