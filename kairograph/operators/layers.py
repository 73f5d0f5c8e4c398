"""Relational layers whose relation matrices share bases or are block-diagonal."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import linear, node_norms
from .messages import SMALL_VECTORS, VectorSum, aggregate_messages
from .order import small


def _activated(nodes: DataFrame, came: DataFrame, norms: DataFrame, out_width: int, bias: Sequence[float] | None, relu: bool) -> DataFrame:
    """Every node's scaled sum (zero where nothing comes in) plus the bias, through relu."""
    zero = F.array_repeat(F.lit(0.0), out_width)
    h = nodes.select("node").join(came, "node", "left").join(norms.select("node", "norm"), "node", "left")
    b = F.lit([float(x) for x in bias]) if bias is not None else zero
    total = F.zip_with(F.coalesce("_in", zero), b, lambda x, y: x * F.coalesce("norm", F.lit(1.0)) + y)
    return h.select("node", (F.transform(total, lambda x: F.greatest(x, F.lit(0.0))) if relu else total).alias("h"))


def basis_layer(nodes: DataFrame, edges: DataFrame, coefficients: DataFrame, bases: Sequence, *, bias: Sequence[float] | None = None, relu: bool = True) -> DataFrame:
    """(node, h) of every node (node, h): incoming messages h W_rel, summed and scaled by 1 / in-degree,
    where W_rel is the sum of ``bases`` (matrices) with the relation's ``coefficients`` (rel, basis, a).

    The sum over a node's edges is taken for each basis before its matrix is applied: no relation's own
    matrix is formed, and an edge adds to as many sums as there are bases. Edges of a relation without
    coefficients send nothing; a coefficient that is missing is 0."""
    weight = np.concatenate([np.asarray(b, float) for b in bases])
    width, count = len(weight) // len(bases), len(bases)
    shares = edges.groupBy("src", "rel", "dst").agg(F.count(F.lit(1)).alias("_n")).join(small(coefficients, SMALL_VECTORS), "rel")
    shares = shares.groupBy("src", "dst", "basis").agg(F.sum(F.col("_n") * F.col("a")).alias("_a"))
    sums = aggregate_messages(shares, {"h": (F.col("src_h"), F.col("_a"))}, {"h": VectorSum(width)}, src=nodes, by=("dst", "basis"))
    whole = sums.groupBy(F.col("dst").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("basis", "h"))).alias("_m"))
    zero = F.array_repeat(F.lit(0.0), width)
    side = F.concat(*(F.coalesce(F.try_element_at("_m", F.lit(k)), zero) for k in range(count)))
    came = whole.select("node", linear(side, weight).alias("_in"))
    return _activated(nodes, came, node_norms(edges), weight.shape[1], bias, relu)


def basis_input_layer(nodes: DataFrame, edges: DataFrame, coefficients: DataFrame, bases: DataFrame, width: int, *, bias: Sequence[float] | None = None, relu: bool = True) -> DataFrame:
    """The same for nodes without vectors: a node's row of each basis matrix, ``bases`` (node, basis, h),
    is what it sends, as multiplying a one-hot vector would give."""
    shares = edges.groupBy("src", "rel", "dst").agg(F.count(F.lit(1)).alias("_n")).join(small(coefficients, SMALL_VECTORS), "rel")
    shares = shares.groupBy("src", "dst", "basis").agg(F.sum(F.col("_n") * F.col("a")).alias("_a"))
    rows = bases.select(F.col("node").alias("src"), "basis", F.col("h").alias("_h"))
    came = aggregate_messages(shares.join(rows, ["src", "basis"]), {"_in": (F.col("_h"), F.col("_a"))}, {"_in": VectorSum(width)}).withColumnRenamed("dst", "node")
    return _activated(nodes, came, node_norms(edges), width, bias, relu)


def block_product(h: Column, weight: Column, blocks: int) -> Column:
    """h times a block-diagonal matrix whose ``blocks`` square or oblong blocks stand one after the other in
    ``weight``, row by row; whole Arrow batches at once, null stays null."""

    @F.pandas_udf("array<double>")
    def product(vectors: pd.Series, weights: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        known = np.flatnonzero(vectors.notna() & weights.notna())
        for lo in range(0, len(known), 1024):
            at = known[lo : lo + 1024]
            x, w = np.stack(vectors.iloc[at].to_list()), np.stack(weights.iloc[at].to_list())
            x = x.reshape(len(at), blocks, -1)
            y = np.einsum("nbi,nbij->nbj", x, w.reshape(len(at), blocks, x.shape[2], -1))
            out.iloc[at] = list(y.reshape(len(at), -1))
        return out

    return product(h, weight)


def block_layer(nodes: DataFrame, edges: DataFrame, weights: DataFrame, blocks: int, width: int, out_width: int, *, bias: Sequence[float] | None = None, relu: bool = True) -> DataFrame:
    """(node, h) of every node: as ``basis_layer`` with a block-diagonal matrix for each relation, ``weights``
    (rel, weight). A destination's sources are summed by relation first, so a relation's blocks are
    applied once for each (destination, relation); edges of a relation without weights send nothing."""
    sums = aggregate_messages(edges, {"h": F.col("src_h")}, {"h": VectorSum(width)}, src=nodes, by=("dst", "rel"))
    met = sums.join(small(weights.select("rel", F.col("weight").alias("_w")), SMALL_VECTORS), "rel").select("dst", block_product(F.col("h"), F.col("_w"), blocks).alias("_y"))
    came = met.groupBy(F.col("dst").alias("node")).agg(*(F.sum(F.col("_y")[i]).alias(f"_{i}") for i in range(out_width)))
    came = came.select("node", F.array(*(f"_{i}" for i in range(out_width))).alias("_in"))
    return _activated(nodes, came, node_norms(edges), out_width, bias, relu)
