"""Messages along edges, made by column functions and reduced with partial aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import small

#: Rows of a node or relation table of vectors up to which it is sent to all tasks instead of shuffled.
SMALL_VECTORS = 20_000


@dataclass(frozen=True)
class VectorSum:
    """Reduces vectors of ``width`` numbers by element-wise sums (or means). The message is a vector
    column, or a pair of a vector column and the number it is multiplied with."""

    width: int
    mean: bool = False


def attach(edges: DataFrame, nodes: DataFrame | None, key: str, prefix: str, node_col: str = "node") -> DataFrame:
    """``edges`` with the columns of their end ``key`` as ``<prefix>_<column>``; edges whose end has no row go."""
    if nodes is None:
        return edges
    renamed = nodes.select(F.col(node_col).alias(key), *(F.col(c).alias(f"{prefix}_{c}") for c in nodes.columns if c != node_col))
    return edges.join(small(renamed, SMALL_VECTORS), key)


def aggregate_messages(edges: DataFrame, messages: dict[str, Column | tuple[Column, Column]], reduce: dict[str, Callable[[Column], Column] | VectorSum], *, src: DataFrame | None = None, dst: DataFrame | None = None, by: Sequence[str] = ("dst",)) -> DataFrame:
    """(…by, one column per message): the messages of all edges (src, dst, …) reduced by group.

    ``messages`` are columns over the edges' own columns and those of the node tables as ``src_<column>``
    and ``dst_<column>``. Sums and the like are formed where the edges are and only partial results travel,
    so an edge never carries a vector through a shuffle; nulls are left to the reducing function."""
    joined = attach(attach(edges, src, "src", "src"), dst, "dst", "dst")
    aggregates, results = [], []
    for name, how in reduce.items():
        message = messages[name]
        if isinstance(how, VectorSum):
            vector, weight = message if isinstance(message, tuple) else (message, None)
            f = F.avg if how.mean else F.sum
            aggregates += [f(vector[i] if weight is None else vector[i] * weight).alias(f"_{name}_{i}") for i in range(how.width)]
            results.append(F.array(*(f"_{name}_{i}" for i in range(how.width))).alias(name))
        else:
            aggregates.append(how(message).alias(name))
            results.append(F.col(name))
    return joined.groupBy(*by).agg(*aggregates).select(*by, *results)


def composed_sum(edges: DataFrame, nodes: DataFrame, relations: DataFrame, width: int, compose: str = "add") -> DataFrame:
    """(node, h): for every destination the sum of its incoming source vectors composed with their
    relation's (``add``, ``sub``, which is addition too, or ``mult``).

    Composition is linear in the source, so a relation's vector meets a destination once, not once an edge."""
    h = F.col("src_h")
    known = edges.join(small(relations.select("rel").distinct(), SMALL_VECTORS), "rel", "left_semi")
    by_relation = aggregate_messages(known, {"h": h, "n": F.lit(1.0)}, {"h": VectorSum(width), "n": F.sum}, src=nodes, by=("dst", "rel"))
    both = by_relation.join(small(relations.select("rel", F.col("h").alias("_r")), SMALL_VECTORS), "rel")
    one = (lambda i: F.col("h")[i] * F.col("_r")[i]) if compose == "mult" else (lambda i: F.col("h")[i] + F.col("n") * F.col("_r")[i])
    sums = both.groupBy(F.col("dst").alias("node")).agg(*(F.sum(one(i)).alias(f"_{i}") for i in range(width)))
    return sums.select("node", F.array(*(f"_{i}" for i in range(width))).alias("h"))
