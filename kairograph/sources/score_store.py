"""Scores kept in buckets of their query row, so that lookups by row do not shuffle them."""

from __future__ import annotations

from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import small

SCHEMA = "row_index long, entity_id long, score double"
BUCKETS = 64


def _name(path: str) -> str:
    return f"scores_{sha1(path.encode()).hexdigest()[:16]}"


def write_store(scores: DataFrame, path: str, *, buckets: int = BUCKETS) -> DataFrame:
    """Scores (row_index, entity_id, score) in ``buckets`` files of rows, sorted by row and entity."""
    plain = scores.select(F.col("row_index").cast("long"), F.col("entity_id").cast("long"), F.col("score").cast("double"))
    dealt = plain.repartition(buckets, "row_index")  # one file a bucket, not one for each task and bucket
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "row_index").sortBy("row_index", "entity_id").option("path", path).saveAsTable(_name(path))
    return scores.sparkSession.table(_name(path))


def open_store(spark: SparkSession, path: str, *, buckets: int = BUCKETS) -> DataFrame:
    """A store that is there, also one of another session; ``buckets`` as it was written."""
    columns = ", ".join(f"`{c.split()[0]}` {c.split()[1].replace('long', 'bigint')}" for c in SCHEMA.split(", "))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({columns}) USING parquet CLUSTERED BY (row_index) SORTED BY (row_index, entity_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path))


def check_store(store: DataFrame, rows: DataFrame, entities: int) -> None:
    """Raises unless every row (row_index) has a score for each of ``entities`` entities, and no other row any."""
    n = store.groupBy("row_index").agg(F.count_distinct("entity_id").alias("n"), F.count(F.lit(1)).alias("m"))
    odd = n.join(rows.select("row_index", F.lit(1).alias("_asked")).distinct(), "row_index", "full").where(f"_asked IS NULL OR n IS NULL OR n <> {int(entities)} OR m <> n").limit(1).collect()
    if odd:
        raise ValueError(f"row {odd[0]['row_index']} has {odd[0]['n']} of {entities} scores")


def scores_at(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The scores of ``rows`` (row_index, …): a bucketed join, in which only ``rows`` are shuffled."""
    return store.join(rows.hint("merge"), "row_index")


def write_lists(lists: DataFrame, path: str, *, buckets: int = BUCKETS) -> DataFrame:
    """A store of rows (row_index, …) that hold the scores of many entities each. Tasks write their own
    rows of each bucket: rows are not shuffled, so a bucket has several files."""
    lists.write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(buckets, "row_index").option("path", path).saveAsTable(_name(path))
    return lists.sparkSession.table(_name(path))


def lists_at(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The lists of ``rows`` (row_index, …): of few, which are broadcast, none of the store is shuffled."""
    return store.join(small(rows), "row_index")
