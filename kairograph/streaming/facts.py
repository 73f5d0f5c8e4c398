"""Streams of facts: answers known so far, windowed snapshots, and each entity's rolling history."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(stream: DataFrame) -> DataFrame:
    """(s, r, o, first_t): the dictionary of answers as it grows; for update or complete mode."""
    return stream.groupBy("s", "r", "o").agg(F.min("t").alias("first_t"))


def windowed_snapshots(stream: DataFrame, time: str, size: str, *, step: str | None = None, late: str = "1 day") -> DataFrame:
    """(window_start, r, facts, subjects) of tumbling or sliding windows; facts later than ``late`` are dropped.
    Subjects are counted approximately, since exact distinct sets have no bounded state."""
    w = F.window(time, size, step) if step else F.window(time, size)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), "r").agg(F.count(F.lit(1)).alias("facts"), F.approx_count_distinct("s").alias("subjects"))
    return g.select(F.col("w.start").alias("window_start"), "r", "facts", "subjects")


_ROLLING = "e long, seq long, t long, s long, r long, o long, n_before long, newest_t long"


def rolling_history(stream: DataFrame, limit: int) -> DataFrame:
    """Each fact under its subject with what its history would show: how many of the entity's
    ``limit`` newest facts lie strictly before it, and the time of the newest of these.

    State per entity: the times of its ``limit`` newest facts before the latest time and of those
    at it. Facts must arrive in order of time for each entity, as files of a day do."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old, now = state.get if state.exists else ([], [])
        parts = list(batches)
        seq, t, s, r, o = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("seq", "t", "s", "r", "o"))
        order = np.lexsort((seq, t))
        times = np.concatenate([np.array(old, np.int64), np.array(now, np.int64), t[order]])
        fresh = np.zeros(len(times), np.int64)  # where the facts of a row's time begin
        at = np.flatnonzero(times[1:] > times[:-1]) + 1
        at = at[at > len(old)]
        fresh[len(old) :], fresh[at] = len(old), at
        fresh = np.maximum.accumulate(fresh)
        last, begins = int(fresh[-1]), fresh[len(times) - len(order) :]
        state.update((times[max(last - limit, 0) : last].tolist(), times[last:][-limit:].tolist()))
        newest = pd.arrays.IntegerArray(times[np.maximum(begins, 1) - 1], begins == 0)
        yield pd.DataFrame({"e": key[0], "seq": seq[order], "t": t[order], "s": s[order], "r": r[order], "o": o[order], "n_before": np.minimum(begins, limit), "newest_t": newest})

    return stream.select(F.col("s").alias("e"), "seq", "t", "s", "r", "o").groupBy("e").applyInPandasWithState(run, _ROLLING, "old array<long>, now array<long>", "append", GroupStateTimeout.NoTimeout)


def stream_folder(spark: SparkSession) -> str:
    """A new folder for a stream's checkpoint and result: below ``spark.checkpoint.dir`` where it is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="kairograph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str, write: Callable[[DataFrame, int, str], None] | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result as a written table.

    In complete mode each batch replaces the one before; in append mode its rows are added.
    A restarted batch writes to the same place, so nothing is doubled."""
    spark, folder = stream.sparkSession, stream_folder(stream.sparkSession)
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        to = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(to)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write or keep).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(schema).parquet(f"{folder}/out").select(*schema.names)
