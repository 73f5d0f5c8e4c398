"""Snapshots: all facts of one time, their numbering, windows and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .order import number_rows


def segments(facts: DataFrame, *, width: int = 1 << 16) -> DataFrame:
    """(seq, t, segment): a new segment begins where ``t`` differs from the row before (0 before the first).

    Changes are counted within slices of ``seq``; the slices' ends and sums are joined in order."""
    f = facts.select("seq", "t").withColumn("_slice", F.floor(F.col("seq") / width))
    ends = f.groupBy("_slice").agg(F.min_by("t", "seq").alias("_first"), F.max_by("t", "seq").alias("_last"))
    own = W.partitionBy("_slice").orderBy("seq")
    f = f.withColumn("_step", F.coalesce((F.col("t") != F.lag("t").over(own)).cast("long"), F.lit(0)))
    steps = f.groupBy("_slice").agg(F.sum("_step").alias("_inner")).join(ends, "_slice")
    order = W.orderBy("_slice")
    edge = (F.col("_first") != F.lag("_last", 1, 0).over(order)).cast("long")
    steps = steps.withColumn("_edge", edge)
    before = F.coalesce(F.sum(F.col("_edge") + F.col("_inner")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select("_slice", (before + F.col("_edge")).alias("_base"))
    run = F.sum("_step").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    return f.withColumn("_run", run).join(steps, "_slice").select("seq", "t", (F.col("_base") + F.col("_run")).alias("segment"))


def snapshot_index(facts: DataFrame) -> DataFrame:
    """(t, idx): the distinct times numbered from 0; one row per time."""
    return facts.select("t").distinct().withColumn("idx", (F.row_number().over(W.orderBy("t")) - 1).cast("long"))


def with_index(facts: DataFrame) -> DataFrame:
    """``facts`` plus ``idx``. The times are left to the optimizer to broadcast: their number has no bound."""
    return facts.join(snapshot_index(facts), "t")


def per_snapshot(facts: DataFrame) -> DataFrame:
    ends = facts.select("t", F.col("s").alias("e")).unionByName(facts.select("t", F.col("o").alias("e")))
    nodes = ends.groupBy("t").agg(F.count_distinct("e").alias("nodes"))
    rest = facts.groupBy("t").agg(F.count(F.lit(1)).alias("edges"), (2 * F.count_distinct("r")).alias("rels"))
    return rest.join(nodes, "t").select("t", "nodes", "rels", "edges")


def statistics(facts: DataFrame) -> DataFrame:
    """One row: mean nodes and relations (both directions), number of snapshots, most and fewest edges."""
    return per_snapshot(facts).agg(F.avg("nodes").alias("avg_nodes"), F.avg("rels").alias("avg_rels"), F.count(F.lit(1)).alias("snapshots"), F.max("edges").alias("max_edges"), F.min("edges").alias("min_edges"))


def dilated(facts: DataFrame, k: int) -> DataFrame:
    """Snapshots merged k at a time: distinct (window, s, r, o)."""
    return with_index(facts).select(F.floor(F.col("idx") / k).cast("long").alias("window"), "s", "r", "o").distinct()


def sliding(facts: DataFrame, k: int) -> DataFrame:
    """(window, s, r, o): every run of k snapshots, one step apart."""
    f = with_index(facts)
    last = f.agg((F.max("idx") - (k - 1)).alias("_last"))
    start = F.explode(F.sequence(F.greatest(F.col("idx") - (k - 1), F.lit(0)), F.col("idx"))).alias("window")
    return f.select("s", "r", "o", start).crossJoin(F.broadcast(last)).where("window <= _last").drop("_last")


def trailing(facts: DataFrame, n: int) -> DataFrame:
    """(idx, s, r, o): the n snapshots before each snapshot, with repeats."""
    f = with_index(facts)
    top = f.agg(F.max("idx").alias("_top"))
    ahead = F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + n)).alias("at")
    return f.select("s", "r", "o", ahead).crossJoin(F.broadcast(top)).where("at <= _top").drop("_top")


def sample_ids(facts: DataFrame, n_rel: int, *, skip_first: bool = False) -> DataFrame:
    """Queries with their global id: by snapshot, forward ones before backward ones, in file order."""
    from .facts import queries_of

    if skip_first:
        first = facts.agg(F.min("t").alias("_t0"))
        facts = facts.crossJoin(F.broadcast(first)).where("t > _t0").drop("_t0")
    return number_rows(queries_of(facts, n_rel), ["t", "dir"], "seq", "id")
