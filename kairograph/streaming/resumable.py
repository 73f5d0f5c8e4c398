"""Incremental work that can be killed at any time: numbered batches, each written once and then marked.

Rows are dealt to files once; a stream takes some files a batch. A batch's result goes to a folder of its
number, which a repeated batch overwrites, and a mark with the number follows when it is whole. Readers
see marked batches only, and a marked batch is never worked on again, so a table that was interrupted any
number of times equals the table of one run, and costly work (a remote service) is done once a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS = "number long, rows long"


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_MARKS).parquet(f"{folder}/marks")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MARKS)


def _mark(spark: SparkSession, folder: str, number: int, rows: int) -> None:
    spark.createDataFrame([(number, rows)], _MARKS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")


def finished(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all whole batches below ``folder``; none where nothing is finished."""
    done = _marks(spark, folder).where("number >= 0").select(F.col("number").alias("batch"))
    try:
        out = spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    names = [c for c in out.columns if c != "batch"]
    return out.withColumn("batch", F.col("batch").cast("long")).join(F.broadcast(done), "batch", "left_semi").select(*names)


def deal(rows: DataFrame, folder: str, *, id_col: str, batches: int, files: int = 1) -> DataFrame:
    """``rows`` as a stream of about ``batches`` batches of ``files`` files each, dealt by a hash of the id.
    They are written once: a later call finds the mark and takes the files that are there."""
    spark = rows.sparkSession
    if not _marks(spark, folder).where("number = -1").count():
        rows.repartition(batches * files, id_col).write.mode("overwrite").parquet(f"{folder}/pending")
        _mark(spark, folder, -1, 0)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/pending")


def append_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str) -> None:
    """Run ``work`` on every batch that is there and not yet finished. An error or a kill leaves the
    finished batches; calling again goes on after them. A mark holds the number of rows written."""
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        if _marks(spark, folder).where(F.col("number") == number).count():
            return
        to = f"{folder}/out/batch={number}"
        made = work(batch)
        made.write.mode("overwrite").parquet(to)
        _mark(spark, folder, number, spark.read.schema(made.schema).parquet(to).count())

    q = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(one).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def complete(rows: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, schema, *, id_col: str, batches: int, files: int = 1) -> DataFrame:
    """``work`` over all of ``rows`` in batches, from where an earlier call stopped; the finished table."""
    append_batches(deal(rows, folder, id_col=id_col, batches=batches, files=files), work, folder)
    return finished(rows.sparkSession, folder, schema)
