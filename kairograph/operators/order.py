"""Numbering and looking up rows in one order without sending them all to one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def number_rows(df: DataFrame, major: list[str], minor: str, name: str, *, then: tuple[str, ...] = (), width: int = 1 << 16) -> DataFrame:
    """``df`` plus ``name``: the row's place from 0 in the order (``major``, ``minor``, ``then``).

    Rows are numbered within slices of ``width`` values of the integer column ``minor``; only
    the slices' sizes are ordered together, one small row for each."""
    df = df.withColumn("_slice", F.floor(F.col(minor) / F.lit(width)))
    keys = [*major, "_slice"]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, before.alias("_before"))
    out = df.join(sizes, keys)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(minor, *then)) - 1
    return out.withColumn(name, (F.col("_before") + place).cast("long")).drop("_slice", "_before")


def number_within(df: DataFrame, keys: list[str], minor: str, name: str, *, then: tuple[str, ...] = (), width: int = 1) -> DataFrame:
    """``df`` plus ``name``: the row's place from 0 among those of its ``keys``, by ``minor`` and ``then``.

    Rows are numbered within slices of ``width`` values of the integer column ``minor``, so a key
    with very many rows is spread over tasks; only the sizes of its slices come together."""
    df = df.withColumn("_slice", F.floor(F.col(minor) / F.lit(width)))
    sizes = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = df.join(sizes.select(*keys, "_slice", before.alias("_before")), [*keys, "_slice"])
    place = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(minor, *then)) - 1
    return out.withColumn(name, (F.col("_before") + place).cast("long")).drop("_slice", "_before")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast of ``df`` where it has at most ``rows`` rows, else ``df`` itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def as_of_sum(events: DataFrame, queries: DataFrame, keys: list[str], time: str, value: Column, name: str, total: Callable[[Column | str], Column] = F.sum) -> DataFrame:
    """Distinct (keys, time) of ``queries`` with the sum of ``value`` over events strictly before; or
    another ``total`` of values of 0 and more that starts at 0."""
    w = W.partitionBy(*keys).orderBy(time, "_is_event").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = events.groupBy(*keys, time).agg(total(value).alias("_v")).withColumn("_is_event", F.lit(1))
    q = queries.select(*keys, time).distinct().withColumn("_v", F.lit(0).cast("long")).withColumn("_is_event", F.lit(0))
    both = e.unionByName(q).withColumn(name, total("_v").over(w))
    return both.where("_is_event = 0").select(*keys, time, name)
