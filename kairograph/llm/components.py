"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Nodes of more edges than this, and of more than this share of all edges, meet their edges by a broadcast;
#: there are never more than twice the share's inverse of them.
HUB_EDGES, HUB_SHARE = 256, 1 / 50_000


def _star(edges: DataFrame, large: bool, hub: int | None) -> DataFrame:
    """Large star: larger neighbours of u move to u's least neighbour. Small star: the others do.

    Nodes of more than ``hub`` edges (None: there is none) are few and broadcast, their edges stay
    where they are, so no task gathers the edges of one node."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    e = edges.unionByName(turned) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    if hub is None:
        j = e.join(least.drop("c"), "u")
    else:
        hubs = F.broadcast(least.where(F.col("c") > hub).select("u", "m"))  # at most 2 / HUB_SHARE rows
        both = e.join(hubs.withColumnRenamed("m", "h"), "u", "left")
        j = both.where("h IS NOT NULL").select("u", "v", F.col("h").alias("m")).unionByName(both.where("h IS NULL").select("u", "v").join(least.where(F.col("c") <= hub).select("u", "m"), "u"))
    if large:
        return j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _measure(e: DataFrame) -> tuple[int, int, int]:
    """Edges, a checksum of them, and the most edges of a node."""
    ends = e.select("u", F.xxhash64("u", "v").alias("x")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("x")))
    of = ends.groupBy("u").agg(F.count(F.lit(1)).alias("c"), F.bit_xor("x").alias("x"))
    n, x, most = of.agg(F.coalesce(F.sum("c"), F.lit(0)), F.bit_xor("x"), F.max("c")).first()
    return n // 2, x, most or 0


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``edges`` (u long, v long); the component is its least node.

    Self-loops and repeated edges change nothing; nulls are dropped; no edges give no rows. Every
    round is written, so lost executors never replay the whole chain. Rounds grow with the
    logarithm of the nodes; labels that are not final after ``max_rounds`` raise."""
    e = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct())
    before = None
    for k in range(max_rounds + 1):
        now = _measure(e)
        if now[:2] == before or not now[0]:
            break
        if k == max_rounds:
            raise RuntimeError(f"components are not final after {max_rounds} rounds")
        before, hub = now[:2], max(HUB_EDGES, int(now[0] * HUB_SHARE))
        if now[2] <= hub:  # the first star makes no node of more edges the second's key
            e = materialize(_star(_star(e, True, None), False, None))
        else:
            e = materialize(_star(materialize(_star(e, True, hub)), False, hub))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
