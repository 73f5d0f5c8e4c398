"""Graphs for entity classification: edges near the labelled nodes, with dense ids shared by all tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import bfs_levels, typed_norms
from .order import number_rows


def near_edges(edges: DataFrame, labelled: DataFrame, levels: int, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Edges (src, rel, dst) whose both ends are at most ``levels`` steps along edges from a labelled node
    (node); all edges where ``levels`` is 0."""
    if levels <= 0:
        return edges
    kept = bfs_levels(edges.select("src", "dst").distinct(), labelled, levels, cut).select("node")
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")


def classification_dataset(edges: DataFrame, labels: DataFrame, train: DataFrame, test: DataFrame, *, levels: int = 2, relabel: bool = True, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> dict[str, DataFrame]:
    """Tables ``edges`` (src, rel, dst, norm), ``labels`` (node, label), ``train`` and ``test`` (node), and
    ``nodes`` (node, old) with ``relabel``.

    Edges far from the labelled nodes go; the nodes that are left are numbered from 0 in order of
    their ids, by one dictionary for all tables. Labels, train and test nodes without an edge that is left
    have no number and go too. ``norm`` is 1 over the node's incoming edges of the relation."""
    kept = cut(near_edges(edges.select("src", "rel", "dst"), labels.select("node").distinct(), levels, cut))
    out = {"labels": labels.select("node", "label"), "train": train.select("node"), "test": test.select("node")}
    if relabel:
        ends = kept.select(F.col("src").alias("old")).unionByName(kept.select(F.col("dst").alias("old"))).distinct()
        nodes = cut(number_rows(ends, [], "old", "node").select("node", "old"))
        by = lambda c: nodes.select(F.col("old").alias(c), F.col("node").alias(f"_{c}"))
        kept = kept.join(by("src"), "src").join(by("dst"), "dst").select(F.col("_src").alias("src"), "rel", F.col("_dst").alias("dst"))
        out = {k: t.join(by("node"), "node").drop("node").withColumnRenamed("_node", "node") for k, t in out.items()}
        out["nodes"] = nodes
    norms = typed_norms(kept).select("dst", "rel", "norm")
    out["edges"] = kept.join(norms, ["dst", "rel"]).select("src", "rel", "dst", "norm")
    return {k: t.select("node", "label") if k == "labels" else t for k, t in out.items()}
