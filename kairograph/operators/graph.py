"""Graphs of facts: degrees and norms, message passing, subgraphs, levels and components."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as v
from .facts import both_directions, first_seen
from .messages import SMALL_VECTORS, VectorSum, aggregate_messages, attach, composed_sum
from .order import small


def edge_frequency(facts: DataFrame, n_rel: int) -> DataFrame:
    """(src, rel, dst, freq) of both directions."""
    b = both_directions(facts, n_rel)
    return b.groupBy(F.col("s").alias("src"), F.col("r").alias("rel"), F.col("o").alias("dst")).agg(F.count(F.lit(1)).alias("freq"))


def node_norms(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(…by, node, degree, norm): incoming edges of every node that has any edge, and 1 / max(degree, 1)."""
    into = edges.select(*by, F.col("dst").alias("node"), F.lit(1).alias("_in"))
    out = edges.select(*by, F.col("src").alias("node"), F.lit(0).alias("_in"))
    d = into.unionByName(out).groupBy(*by, "node").agg(F.sum("_in").alias("degree"))
    return d.withColumn("norm", 1.0 / F.greatest("degree", F.lit(1)))


def edge_norms(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``edges`` plus ``norm``: the product of both ends' norms."""
    n = node_norms(edges, by)
    src = n.select(*by, F.col("node").alias("src"), F.col("norm").alias("_s"))
    dst = n.select(*by, F.col("node").alias("dst"), F.col("norm").alias("_d"))
    return edges.join(src, [*by, "src"]).join(dst, [*by, "dst"]).withColumn("norm", F.col("_s") * F.col("_d")).drop("_s", "_d")


def typed_norms(edges: DataFrame) -> DataFrame:
    """(dst, rel, degree, norm): incoming edges of a node by relation."""
    return edges.groupBy("dst", "rel").agg(F.count(F.lit(1)).alias("degree")).withColumn("norm", 1.0 / F.col("degree"))


def history_subgraph(past: DataFrame, known: DataFrame, queries: DataFrame, n_rel: int, *, inverse: bool = False) -> DataFrame:
    """Edges (with frequency) of the past whose source is a query subject or was an answer to a query.

    ``known`` (s, r, o) holds answers of both directions; for the ``inverse`` queries the subjects
    are still those of the forward ones, as originally defined."""
    subjects = queries.select(F.col("s").alias("src"))
    pairs = queries.select(F.col("o").alias("s"), (F.col("r") + n_rel).alias("r")) if inverse else queries.select("s", "r")
    near = known.join(pairs.distinct(), ["s", "r"], "left_semi").select(F.col("o").alias("src"))
    return edge_frequency(past, n_rel).join(subjects.unionByName(near).distinct(), "src", "left_semi")


def history_subgraphs(facts: DataFrame, n_rel: int, past: int, *, inverse: bool = False) -> DataFrame:
    """(t, src, rel, dst, freq): the ``history_subgraph`` of every snapshot, over the ``past`` time
    steps before it, as one job. Answers count as known from the step after they were first seen."""
    pairs = facts.select("t", F.col("o").alias("s"), (F.col("r") + n_rel).alias("r")) if inverse else facts.select("t", "s", "r")
    near = pairs.distinct().join(first_seen(facts, n_rel), ["s", "r"]).where(F.col("first_t") < F.col("t")).select("t", F.col("o").alias("src"))
    wanted = facts.select("t", F.col("s").alias("src")).unionByName(near).distinct()
    shown = both_directions(facts, n_rel).select(F.explode(F.sequence(F.col("t") + 1, F.col("t") + past)).alias("t"), F.col("s").alias("src"), F.col("r").alias("rel"), F.col("o").alias("dst"))
    freq = shown.groupBy("t", "src", "rel", "dst").agg(F.count(F.lit(1)).alias("freq"))
    return freq.join(wanted, ["t", "src"], "left_semi")


def known_before(facts: DataFrame, t: int, n_rel: int) -> DataFrame:
    return first_seen(facts, n_rel).where(F.col("first_t") < t).select("s", "r", "o")


def _sum_vectors(x: DataFrame, by: Sequence[str], col: str, name: str, mean: bool = False, width: int | None = None) -> DataFrame:
    """Element-wise sums of vectors by group: partial sums of every component, no group is gathered.
    With a known ``width`` they are aggregates of one row, else a row for each component."""
    if width is not None:
        f = F.avg if mean else F.sum
        parts = x.groupBy(*by).agg(*(f(F.col(col)[i]).alias(f"_{i}") for i in range(width)))
        return parts.select(*by, F.array(*(f"_{i}" for i in range(width))).alias(name))
    long = x.select(*by, F.posexplode(col).alias("_i", "_x"))
    agg = F.avg("_x") if mean else F.sum("_x")
    parts = long.groupBy(*by, "_i").agg(agg.alias("_x")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_p"))
    return parts.select(*by, F.transform("_p", lambda p: p["_x"]).alias(name))


def gather(edges: DataFrame, nodes: DataFrame, relations: DataFrame, compose: str = "add") -> DataFrame:
    """``edges`` plus ``message``: source vector composed with the relation's (added or multiplied).
    ``nodes`` (node, h), ``relations`` (rel, h); the composition called ``sub`` is addition too."""
    joined = attach(edges, nodes.select("node", F.col("h").alias("hs")), "src", "").join(small(relations.select("rel", F.col("h").alias("_hr")), SMALL_VECTORS), "rel")
    op: Callable = {"add": v.add, "sub": v.add, "mult": lambda a, b: F.zip_with(a, b, lambda x, y: x * y)}[compose]
    return joined.withColumn("message", op(F.col("_hs"), F.col("_hr"))).drop("_hs", "_hr")


def message_sum(messages: DataFrame, norms: DataFrame, width: int | None = None) -> DataFrame:
    """(node, h): incoming messages summed and scaled by the node's norm."""
    return scaled_sum(_sum_vectors(messages, ["dst"], "message", "h", width=width).withColumnRenamed("dst", "node"), norms)


def scaled_sum(sums: DataFrame, norms: DataFrame) -> DataFrame:
    """(node, h): sums (node, h) scaled by the node's norm."""
    return sums.join(norms.select("node", "norm"), "node").select("node", v.scale(F.col("h"), F.col("norm")).alias("h"))


def attention(edges: DataFrame, nodes: DataFrame, slope: float = 0.01, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``edges`` plus ``attention``: softmax over each destination of the leaky dot product of its ends.
    ``cut`` writes the edges with their scores, which the softmax reads three times."""
    h = nodes.select("node", "h")
    scored = attach(attach(edges, h, "src", "_s"), h, "dst", "_d").withColumn("_e", v.dot(F.col("_s_h"), F.col("_d_h"))).drop("_s_h", "_d_h")
    return _softmax_by_end(cut(scored), slope)


def relational_attention(edges: DataFrame, nodes: DataFrame, relations: DataFrame, weight: Sequence[float], slope: float = 0.01) -> DataFrame:
    """``edges`` plus ``attention``: softmax over each destination of a learned score of source,
    destination and relation, leaky by ``slope``.

    ``weight`` (three times the vectors' length) scores the three vectors one after the other; two
    linear layers in a row are their product. A node's and a relation's share is one number, so
    edges are joined with numbers, not with vectors."""
    d = len(weight) // 3
    part = lambda k: F.lit([float(x) for x in weight[k * d : (k + 1) * d]])
    n = nodes.select("node", v.dot(F.col("h"), part(0)).alias("_s"), v.dot(F.col("h"), part(1)).alias("_d"))
    r = relations.select("rel", v.dot(F.col("h"), part(2)).alias("_r"))
    e = edges.join(n.select(F.col("node").alias("src"), "_s"), "src").join(n.select(F.col("node").alias("dst"), "_d"), "dst").join(r, "rel")
    return _softmax_by_end(e.withColumn("_e", F.col("_s") + F.col("_d") + F.col("_r")).drop("_s", "_d", "_r"), slope)


def _softmax_by_end(e: DataFrame, slope: float) -> DataFrame:
    e = e.withColumn("_e", F.greatest("_e", F.col("_e") * slope))
    top = aggregate_messages(e, {"_top": F.col("_e")}, {"_top": F.max})
    e = e.join(top, "dst").withColumn("_x", F.exp(F.col("_e") - F.col("_top")))
    return e.join(aggregate_messages(e, {"_sum": F.col("_x")}, {"_sum": F.sum}), "dst").withColumn("attention", F.col("_x") / F.col("_sum")).drop("_e", "_x", "_top", "_sum")


def attended_sum(edges: DataFrame, nodes: DataFrame, width: int | None = None) -> DataFrame:
    """(node, h): attention-weighted sum of the source vectors."""
    if width is None:
        m = attach(edges, nodes.select("node", "h"), "src", "src").select(F.col("dst").alias("node"), v.scale(F.col("src_h"), F.col("attention")).alias("_m"))
        return _sum_vectors(m, ["node"], "_m", "h")
    return aggregate_messages(edges, {"h": (F.col("src_h"), F.col("attention"))}, {"h": VectorSum(width)}, src=nodes.select("node", "h")).withColumnRenamed("dst", "node")


def mean_pool(members: DataFrame, by: str, width: int | None = None) -> DataFrame:
    """(by, h): mean of the members' vectors ``h``."""
    return _sum_vectors(members, [by], "h", "h", mean=True, width=width)


def linear(h: Column, weight: Sequence[Sequence[float]]) -> Column:
    """h W for a fixed matrix (rows: inputs), Arrow batches multiplied at once; null stays null."""
    w = np.asarray(weight, np.float64)

    @F.pandas_udf("array<double>")
    def product(batch: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(batch), dtype=object)
        known = np.flatnonzero(batch.notna())
        if len(known):
            out.iloc[known] = list(np.stack(batch.iloc[known].to_list()) @ w)
        return out

    return product(h)


def relational_layer(nodes: DataFrame, edges: DataFrame, relations: DataFrame, weight, self_weight, lone_weight, *, compose: str = "add") -> DataFrame:
    """(node, h) after one layer: messages through ``weight``, summed and scaled; plus the node's
    own vector through ``self_weight``, or ``lone_weight`` where nothing comes in; then relu.
    The matrix is applied to a node's sum, once, instead of to each of its messages."""
    came = scaled_sum(composed_sum(edges, nodes, relations, len(weight), compose), node_norms(edges)).select("node", linear(F.col("h"), weight).alias("_in"))
    out = nodes.join(came, "node", "left")
    h = F.when(F.col("_in").isNull(), linear(F.col("h"), lone_weight)).otherwise(v.add(F.col("_in"), linear(F.col("h"), self_weight)))
    return out.select("node", F.transform(h, lambda x: F.greatest(x, F.lit(0.0))).alias("h"))


def bfs_levels(edges: DataFrame, roots: DataFrame, max_level: int | None = None, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(node, level): least number of steps along ``edges`` (src, dst) from the ``roots`` (node), up
    to ``max_level`` or until nothing new is reached; ``cut`` writes a level's nodes."""
    seen = roots.select("node").distinct().withColumn("level", F.lit(0))
    front = seen
    for level in itertools.count(1):
        if max_level is not None and level > max_level or max_level is None and not front.limit(1).count():
            break
        step = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        seen = cut(seen.unionByName(front))
    return seen


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over undirected ``edges`` (src, dst).

    Least labels spread to neighbours, then each node takes its label's label, so paths halve
    every round; ``cut`` writes a round's labels. Written labels are so small as files that Spark
    would broadcast them, through the driver, at any number of nodes: they are merged instead."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("component")).select(F.col("src").alias("node"), "component"))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("node").alias("dst"), "component").hint("merge"), "dst").groupBy("src").agg(F.min("component").alias("_near"))
        step = label.join(near.withColumnRenamed("src", "node").hint("merge"), "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("_jump"))
        new = cut(step.join(jump.hint("merge"), "component").select("node", "_old", F.least("component", "_jump").alias("component")))
        label = new.select("node", "component")
        if not new.where("_old <> component").limit(1).count():
            return label
    raise RuntimeError(f"components are not final after {max_rounds} rounds")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct nodes one step along ``edges`` (src, dst) from ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node")).distinct()


def sorted_edges(edges: DataFrame, then: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` plus ``place`` from 0 in order of destination, source and relation."""
    from .order import number_rows

    return number_rows(edges, [], "dst", "place", then=("src", "rel", *then), width=16)
