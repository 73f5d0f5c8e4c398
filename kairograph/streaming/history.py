"""Each entity's newest facts before every day, kept while facts stream in.

State of an entity: its ``limit`` newest facts of the days that are closed, and the ``limit`` newest of
each day still open. A day closes when the watermark has passed its end, by a timer; its history rows
are emitted then, so the order in which a day's facts come, in one batch or in many, does not matter.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_DAY_MS = 86_400_000
_FACT = ["t", "seq", "role", "s", "r", "o"]
_STATE = "t long, seq long, role int, s long, r long, o long"
HISTORY = "e long, q long, rank int, seq long, t long, s long, r long, o long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestFacts(StatefulProcessor):
    def __init__(self, limit: int, epoch_ms: int):
        self.limit, self.epoch_ms = limit, epoch_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getListState("closed", _STATE)
        self.open = handle.getListState("open", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self._table(self.open.get())
        waits = len(kept) > 0
        for pdf in rows:  # one Arrow batch at a time; what is kept of a day is bounded by the limit
            kept = self._newest(np.concatenate([kept, pdf[_FACT].to_numpy(np.int64)]))
        self.open.put(list(map(tuple, kept.tolist())))
        first = int(kept[0, 0])
        if not waits:
            self._wait(first)
        else:  # an older day than those waited for: its timer comes first, later ones find nothing to do
            self._wait(first, only_if_new=True)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """One timer stands for all days that the watermark has passed; the next open day gets its own."""
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        upto = (mark - self.epoch_ms) // _DAY_MS - 1
        waiting = self._table(self.open.get())
        ready, later = waiting[waiting[:, 0] <= upto], waiting[waiting[:, 0] > upto]
        if len(ready):
            old = self._table(self.closed.get())
            known, k = np.concatenate([old, ready]), len(old)
            days, sizes = np.unique(ready[:, 0], return_counts=True)
            before = k + np.concatenate([[0], np.cumsum(sizes)[:-1]])  # facts known before each day
            shown = np.minimum(before, self.limit)
            rank = np.arange(shown.sum()) - np.repeat(np.cumsum(shown) - shown, shown)
            f = known[np.repeat(before, shown) - 1 - rank]
            self.closed.put(list(map(tuple, known[-self.limit :].tolist())))
            if len(later):
                self.open.put(list(map(tuple, later.tolist())))
            else:
                self.open.clear()
        if len(later):
            self._wait(int(later[0, 0]), only_if_new=True)
        if len(ready) and len(f):
            yield pd.DataFrame({"e": key[0], "q": np.repeat(days, shown), "rank": (rank + 1).astype(np.int32), "seq": f[:, 1], "t": f[:, 0], "s": f[:, 3], "r": f[:, 4], "o": f[:, 5]})
        else:
            yield pd.DataFrame()

    @staticmethod
    def _table(facts) -> np.ndarray:
        return np.array([tuple(f) for f in facts], np.int64).reshape(-1, len(_FACT))

    def _newest(self, facts: np.ndarray) -> np.ndarray:
        """The ``limit`` newest facts of each day, in order of day, number and role."""
        facts = facts[np.lexsort((facts[:, 2], facts[:, 1], facts[:, 0]))]
        ends = np.searchsorted(facts[:, 0], facts[:, 0], side="right")
        return facts[ends - np.arange(len(facts)) <= self.limit]

    def _wait(self, day: int, only_if_new: bool = False) -> None:
        at = self.epoch_ms + (day + 1) * _DAY_MS
        if not only_if_new or at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def newest_facts(stream: DataFrame, limit: int, *, time: str = "ts", first_day: str = "2024-01-01", late: str = "0 seconds") -> DataFrame:
    """(e, q, rank, seq, t, s, r, o): for every entity and every closed day on which it has facts, its
    ``limit`` newest facts of earlier days, rank 1 the newest; a self-loop counts twice.

    ``stream`` has seq, s, r, o, the day ``t`` counted from ``first_day`` (UTC) and the time ``time``;
    facts later than ``late`` behind the newest are dropped. Run it by ``run_rolling``."""
    epoch = int(datetime.datetime.fromisoformat(first_day).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    ends = F.explode(F.array(F.struct(F.col("s").alias("e"), F.lit(0).alias("role")), F.struct(F.col("o").alias("e"), F.lit(1).alias("role"))))
    facts = stream.withWatermark(time, late).select(time, "seq", "s", "r", "o", "t", ends.alias("x")).select(time, "x.e", "t", "seq", "x.role", "s", "r", "o")
    return facts.groupBy("e").transformWithStateInPandas(NewestFacts(limit, epoch), HISTORY, "Append", "EventTime")


def run_rolling(stream: DataFrame) -> DataFrame:
    """Run a stream of ``newest_facts`` over what is there now; the written result. List states and
    timers need the RocksDB state store, which is set for this run."""
    from .facts import run_to_table

    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return run_to_table(stream, "append")
    finally:
        spark.conf.set(_PROVIDER, before)
