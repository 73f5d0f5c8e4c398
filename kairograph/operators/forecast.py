"""Forecasting over several steps, each step's answers being part of the history of the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import predicted_triples, top_k

FACT = ("t", "s", "r", "o")


def snapshot_times(facts: DataFrame) -> list[int]:
    """The times at which there are facts, in order: as many as snapshots."""
    return [r.t for r in facts.select("t").where("t IS NOT NULL").distinct().orderBy("t").collect()]


def window_frequency(window: DataFrame, asked: DataFrame) -> DataFrame:
    """(e, r, t, entity, score): how often the window's facts answer each query."""
    seen = window.groupBy(F.col("s").alias("e"), "r", F.col("o").alias("entity")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return asked.join(seen, ["e", "r"])


def forecast(facts: DataFrame, first: int, *, window: int, k: int, n_rel: int, cut: Callable[[DataFrame], DataFrame], steps: int | None = None, feedback: bool = True, score: Callable[[DataFrame, DataFrame], DataFrame] = window_frequency) -> DataFrame:
    """(t, e, r, place, entity, score): the ``k`` best answers of every distinct query (s, r) of each
    snapshot from time ``first`` on, for ``steps`` snapshots (None: all).

    The history of a step is the ``window`` snapshots before it. With ``feedback`` the step's own answers
    stand in it afterwards instead of its true facts (several steps ahead), else the facts do (one
    step ahead); a step without answers leaves the window as it is. ``score`` (window, queries) gives the
    scored answers; ``cut`` writes what a step adds, so a step's plan does not hold the steps before."""
    times = snapshot_times(facts)
    past, coming = [t for t in times if t < first][-window:], [t for t in times if t >= first][:steps]
    true = facts.select(*FACT)
    held = [(t, true.where(F.col("t") == t)) for t in past]
    out = None
    for t in coming:
        asked = true.where(F.col("t") == t).select(F.col("s").alias("e"), "r", "t").distinct()
        answers = None
        if held:
            history = held[0][1]
            for _, snapshot in held[1:]:
                history = history.unionByName(snapshot)
            answers = cut(top_k(score(history, asked), ["e", "r", "t"], k).select("t", "e", "r", "place", "entity", "score"))
            out = answers if out is None else out.unionByName(answers)
        new = true.where(F.col("t") == t)
        if feedback:
            new = None if answers is None else cut(predicted_triples(answers, n_rel).select(*FACT))
            if new is None or not new.limit(1).count():
                continue
        held = [*held, (t, new)][-window:]
    if out is None:
        return score(true.limit(0), true.limit(0).select(F.col("s").alias("e"), "r", "t")).select("t", "e", "r", F.lit(0).alias("place"), "entity", "score")
    return out
