"""Graph operators over the event facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import facts as fa
from ..operators import graph as gr
from ..operators import layers as ly
from ..operators import messages as ms
from .common import BOTH, FACTS, TEST_FROM, facts, query, relation_total, table, written

#: Numbers of a vector, and time steps of a subgraph's past.
WIDTH, PAST = 64, 10


def _edges(spark, sf_dir) -> tuple[DataFrame, int]:
    f = facts(spark, sf_dir)
    n = relation_total(spark, sf_dir)
    return fa.both_directions(f, n).select(F.col("s").alias("src"), F.col("r").alias("rel"), F.col("o").alias("dst"), "t"), n


def _nodes(spark, sf_dir) -> DataFrame:
    """A vector for each entity that has an embedding of its number."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("h"))


_NODES = "nd AS MATERIALIZED (SELECT vec_id AS node, embedding::DOUBLE[] AS h FROM embeddings)"


@query(f"{FACTS}, {BOTH} SELECT s AS src, r AS rel, o AS dst, count(*) AS freq FROM b WHERE t < {TEST_FROM} GROUP BY s, r, o")
def edge_frequency(spark, sf_dir):
    f = facts(spark, sf_dir)
    return gr.edge_frequency(f.where(F.col("t") < TEST_FROM), relation_total(spark, sf_dir))


_DEG = "dg AS MATERIALIZED (SELECT t, o AS node, count(*) AS degree FROM b GROUP BY t, o)"


@query(f"{FACTS}, {BOTH}, {_DEG} SELECT t, node, degree, round(1.0 / degree, 9) AS norm FROM dg")
def degree_norm(spark, sf_dir):
    e, _ = _edges(spark, sf_dir)
    return gr.node_norms(e, ["t"]).withColumn("norm", F.round("norm", 9))


@query(f"{FACTS}, {BOTH}, {_DEG} SELECT b.t, s AS src, r AS rel, o AS dst, round((1.0::DOUBLE / x.degree) * (1.0::DOUBLE / y.degree), 9) AS norm FROM b JOIN dg x ON x.t = b.t AND x.node = b.s JOIN dg y ON y.t = b.t AND y.node = b.o")
def edge_norm(spark, sf_dir):
    e, _ = _edges(spark, sf_dir)
    return gr.edge_norms(e, ["t"]).withColumn("norm", F.round("norm", 9))


@query(f"{FACTS}, {BOTH} SELECT o AS dst, r AS rel, count(*) AS degree, round(1.0 / count(*), 9) AS norm FROM b GROUP BY o, r")
def degree_by_type(spark, sf_dir):
    e, _ = _edges(spark, sf_dir)
    return gr.typed_norms(e).withColumn("norm", F.round("norm", 9))


def _subgraph_sql(inverse: bool) -> str:
    pair = "SELECT DISTINCT t, o AS s, r + (SELECT n FROM nr) AS r FROM f" if inverse else "SELECT DISTINCT t, s, r FROM f"
    return f"""{FACTS}, {BOTH}, kn AS MATERIALIZED (SELECT s, r, o, min(t) AS first_t FROM b GROUP BY s, r, o), pr AS MATERIALIZED ({pair}),
al AS MATERIALIZED (SELECT t, s AS e FROM f UNION SELECT pr.t, kn.o FROM pr JOIN kn ON kn.s = pr.s AND kn.r = pr.r AND kn.first_t < pr.t)
SELECT al.t, b.s AS src, b.r AS rel, b.o AS dst, count(*) AS freq FROM al JOIN b ON b.s = al.e AND b.t < al.t AND b.t >= al.t - {PAST} GROUP BY ALL"""


def _subgraph(spark, sf_dir, inverse: bool) -> DataFrame:
    f = facts(spark, sf_dir)
    return gr.history_subgraphs(f, relation_total(spark, sf_dir), PAST, inverse=inverse)


@query(_subgraph_sql(False))
def history_subgraph(spark, sf_dir):
    return _subgraph(spark, sf_dir, False)


@query(_subgraph_sql(True))
def history_subgraph_inverse(spark, sf_dir):
    return _subgraph(spark, sf_dir, True)


def _long(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("h").alias("i", "x")).select(key, "i", (F.round("x", 6) + 0.0).alias("x"))  # no negative zero


_MSG = f"{FACTS}, {BOTH}, {_NODES}, nn AS (SELECT o AS node, count(*) AS degree FROM b GROUP BY o), ms AS (SELECT b.o AS node, unnest(range({WIDTH})) AS i, unnest(a.h) AS x, unnest(r.h) AS y FROM b JOIN nd a ON a.node = b.s JOIN nd r ON r.node = b.r)"


@query(f"{_MSG} SELECT ms.node, i::INT AS i, round(sum(x + y) / any_value(degree), 6) + 0.0 AS x FROM ms JOIN nn USING (node) GROUP BY ms.node, i")
def message_sum(spark, sf_dir):
    e, _ = _edges(spark, sf_dir)
    nodes = _nodes(spark, sf_dir)
    return _long(gr.scaled_sum(ms.composed_sum(e, nodes, nodes.withColumnRenamed("node", "rel"), WIDTH), gr.node_norms(e)), "node")


@query(f"{_MSG} SELECT ms.node, i::INT AS i, round(sum(x * y) / any_value(degree), 6) + 0.0 AS x FROM ms JOIN nn USING (node) GROUP BY ms.node, i")
def message_product(spark, sf_dir):
    e, _ = _edges(spark, sf_dir)
    nodes = _nodes(spark, sf_dir)
    return _long(gr.scaled_sum(ms.composed_sum(e, nodes, nodes.withColumnRenamed("node", "rel"), WIDTH, "mult"), gr.node_norms(e)), "node")


_ATT = f"""{FACTS}, {_NODES}, ed AS MATERIALIZED (SELECT f.s AS src, f.r AS rel, f.o AS dst, f.seq, greatest(list_inner_product(a.h, d.h), 0.01 * list_inner_product(a.h, d.h)) AS e FROM f JOIN nd a ON a.node = f.s JOIN nd d ON d.node = f.o),
at AS MATERIALIZED (SELECT *, exp(e - max(e) OVER (PARTITION BY dst)) AS x FROM ed), sm AS MATERIALIZED (SELECT src, rel, dst, seq, x / sum(x) OVER (PARTITION BY dst) AS attention FROM at)"""


def _attention(spark, sf_dir):
    f = facts(spark, sf_dir).select(F.col("s").alias("src"), F.col("r").alias("rel"), F.col("o").alias("dst"), "seq")
    return gr.attention(f, _nodes(spark, sf_dir), cut=written)


@query(f"{_ATT} SELECT seq, src, rel, dst, round(attention, 6) AS attention FROM sm".replace("at AS MAT", "ax AS MAT").replace("FROM at)", "FROM ax)"))
def edge_softmax(spark, sf_dir):
    return _attention(spark, sf_dir).select("seq", "src", "rel", "dst", F.round("attention", 6).alias("attention"))


@query((f"{_ATT}, lg AS (SELECT dst, attention, unnest(range({WIDTH})) AS i, unnest(nd.h) AS v FROM sm JOIN nd ON nd.node = sm.src) SELECT dst AS node, i::INT AS i, round(sum(attention * v), 6) + 0.0 AS x FROM lg GROUP BY dst, i").replace("at AS MAT", "ax AS MAT").replace("FROM at)", "FROM ax)"))
def attended_sum(spark, sf_dir):
    return _long(gr.attended_sum(_attention(spark, sf_dir), _nodes(spark, sf_dir), WIDTH), "node")


@query(f"{FACTS}, {_NODES}, lg AS (SELECT f.r AS rel, unnest(range({WIDTH})) AS i, unnest(nd.h) AS v FROM (SELECT DISTINCT r, s FROM f) f JOIN nd ON nd.node = f.s) SELECT rel, i::INT AS i, round(avg(v), 6) + 0.0 AS x FROM lg GROUP BY rel, i")
def mean_pool(spark, sf_dir):
    f = facts(spark, sf_dir).select(F.col("r").alias("rel"), F.col("s").alias("node")).distinct()
    return _long(gr.mean_pool(f.join(_nodes(spark, sf_dir), "node"), "rel", WIDTH), "rel")


@query(f"{FACTS} SELECT node, round(cos(0.5 * (30 - last) + 0.1), 6) AS c0, round(cos(0.25 * (30 - last) + 0.2), 6) AS c1 FROM (SELECT e AS node, max(t) AS last FROM (SELECT t, unnest([s, o]) AS e FROM f) GROUP BY e)")
def time_encoding(spark, sf_dir):
    f = facts(spark, sf_dir)
    last = f.select("t", F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.max("t").alias("last"))
    enc = v.time_encoding((30 - F.col("last")).cast("double"), F.array(F.lit(0.5), F.lit(0.25)), F.array(F.lit(0.1), F.lit(0.2)))
    return last.select("node", enc.alias("c")).select("node", F.round(F.col("c")[0], 6).alias("c0"), F.round(F.col("c")[1], 6).alias("c1"))


#: Fixed rules for the weights of the attention and of the layer, the same in both engines.
ATTENTION_WEIGHT = [((i * 7) % 11 - 5) / 50 for i in range(3 * WIDTH)]
LAYER_WEIGHTS = [[[((i * 3 + j * 5 + k) % 7 - 3) / 20 for j in range(WIDTH)] for i in range(WIDTH)] for k in range(3)]
_SHARE = "list_sum(list_transform(range({0}, {1}), lambda i: ((i * 7) % 11 - 5) / 50.0 * {2}.h[i - {0} + 1]))"


@query(
    f"{FACTS}, {_NODES}, pn AS MATERIALIZED (SELECT node, {_SHARE.format(0, WIDTH, 'nd')} AS ps, {_SHARE.format(WIDTH, 2 * WIDTH, 'nd')} AS pd, {_SHARE.format(2 * WIDTH, 3 * WIDTH, 'nd')} AS pr FROM nd), "
    "ed AS MATERIALIZED (SELECT f.s AS src, f.r AS rel, f.o AS dst, f.seq, a.ps + d.pd + r.pr AS z FROM f JOIN pn a ON a.node = f.s JOIN pn d ON d.node = f.o JOIN pn r ON r.node = f.r), "
    "ex AS MATERIALIZED (SELECT *, exp(greatest(z, 0.01 * z) - max(greatest(z, 0.01 * z)) OVER (PARTITION BY dst)) AS x FROM ed) SELECT seq, src, rel, dst, round(x / sum(x) OVER (PARTITION BY dst), 6) AS attention FROM ex"
)
def relational_attention(spark, sf_dir):
    f = facts(spark, sf_dir).select(F.col("s").alias("src"), F.col("r").alias("rel"), F.col("o").alias("dst"), "seq")
    nodes = _nodes(spark, sf_dir)
    out = gr.relational_attention(f, nodes, nodes.withColumnRenamed("node", "rel"), ATTENTION_WEIGHT)
    return out.select("seq", "src", "rel", "dst", F.round("attention", 6).alias("attention"))


def _product_sql(source: str, k: int) -> str:
    return f"SELECT {source}.node, j, sum({source}.x * ((i * 3 + j * 5 + {k}) % 7 - 3) / 20.0) AS y FROM {source} CROSS JOIN range({WIDTH}) w(j) GROUP BY {source}.node, j"


@query(
    f"{_MSG}, su AS MATERIALIZED (SELECT ms.node, i, sum(x + y) / any_value(degree) AS x FROM ms JOIN nn USING (node) GROUP BY ms.node, i), own AS MATERIALIZED (SELECT node, unnest(range({WIDTH})) AS i, unnest(h) AS x FROM nd), "
    f"a AS MATERIALIZED ({_product_sql('su', 0)}), s AS MATERIALIZED ({_product_sql('own', 1)}), l AS MATERIALIZED ({_product_sql('own', 2)}) "
    "SELECT s.node, s.j::INT AS i, round(greatest(CASE WHEN a.y IS NULL THEN l.y ELSE a.y + s.y END, 0.0), 6) AS x FROM s JOIN l USING (node, j) LEFT JOIN a USING (node, j)"
)
def relational_layer(spark, sf_dir):
    e, _ = _edges(spark, sf_dir)
    nodes = _nodes(spark, sf_dir)
    return _long(gr.relational_layer(nodes, e, nodes.withColumnRenamed("node", "rel"), *LAYER_WEIGHTS), "node")


@query(f"{FACTS.replace('WITH rel', 'WITH RECURSIVE rel')}, g AS MATERIALIZED (SELECT DISTINCT s, o FROM f), w AS (SELECT min(s) AS node, 0 AS level FROM g UNION SELECT g.o, w.level + 1 FROM w JOIN g ON g.s = w.node WHERE w.level < 12) SELECT node, min(level) AS level FROM w GROUP BY node")
def bfs_levels(spark, sf_dir):
    f = facts(spark, sf_dir)
    e = written(f.select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct())
    return gr.bfs_levels(e, e.agg(F.min("src").alias("node")).where("node IS NOT NULL"), None, written)


#: Components of every snapshot's graph; a node is (t, entity).
@query(f"{FACTS.replace('WITH rel', 'WITH RECURSIVE rel')}, g AS MATERIALIZED (SELECT DISTINCT t, s AS a, o AS b FROM f), u AS MATERIALIZED (SELECT t, a, b FROM g UNION SELECT t, b, a FROM g), w AS (SELECT DISTINCT t, a AS node, a AS reach FROM u UNION SELECT u.t, u.b, w.reach FROM w JOIN u ON u.t = w.t AND u.a = w.node WHERE w.reach < u.b) SELECT t, node, min(reach) AS component FROM w GROUP BY t, node")
def components(spark, sf_dir):
    f = facts(spark, sf_dir)
    of = lambda c: F.struct("t", F.col(c).alias("e"))
    found = gr.components(f.select(of("s").alias("src"), of("o").alias("dst")), written)
    return found.select("node.t", F.col("node.e").alias("node"), F.col("component.e").alias("component"))
