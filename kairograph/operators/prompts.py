"""Prompt rows: history, query and answer texts of every sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact_line
from .history import entity_queries, history, in_history
from .snapshots import sample_ids

#: The instruction and the headings of a prompt.
INSTRUCTION = (
    "Given the historical interactions of a subject entity, predict the missing entity in the query. "
    "output only its semantic code. Do not output the entity name or explanation."
)
HEADINGS = ("Instruction", "Subject", "History", "Query", "Answer")


def prompt_text(subject: Column, past: Column, query: Column) -> Column:
    parts = [F.lit(INSTRUCTION), subject, past, query, F.lit("")]
    return F.concat(*(x for h, p in zip(HEADINGS, parts) for x in (F.lit(f"### {h} ###\n"), p, F.lit("\n" if h != "Answer" else ""))))


def _named(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``df`` plus ``<key>_name``; an id without a name raises when its row is used."""
    n = names.select(F.col("id").alias(key), F.col("name").alias("_n"))
    missing = F.raise_error(F.concat(F.lit(f"no name for {key} "), F.col(key).cast("string"))).cast("string")
    return df.join(n, key, "left").withColumn(f"{key}_name", F.coalesce("_n", missing)).drop("_n")


def prompt_rows(facts: DataFrame, names: DataFrame, relations: DataFrame, n_rel: int, split: str, *, limit: int = 50, skip_first: bool = False, with_history: bool = True, lookback: DataFrame | None = None) -> DataFrame:
    """(id, input, output, filters, in_history, dir, e, r, answer, t) of the samples of one split.

    ``facts`` are the split's, ``lookback`` all facts (history and filters see every split);
    ``names`` (id, name) and ``relations`` (id, name) must cover all ids: a missing one raises."""
    seen = lookback if lookback is not None else facts
    samples = sample_ids(facts, n_rel, skip_first=skip_first)
    hist = history(seen, entity_queries(facts), limit)
    if not with_history:
        hist = hist.where("false")
    lines = _named(_named(_named(hist, names, "s"), names, "o"), relations, "r")
    line = fact_line(F.col("t"), F.col("s_name"), F.col("r_name"), F.col("o_name"))
    # at most ``limit`` lines for each query
    past = lines.groupBy("e", "q").agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), line.alias("line")))).alias("lines"))
    past = past.select("e", F.col("q").alias("t"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("past"))
    base_r = F.when(F.col("dir") == 1, F.col("r") - n_rel).otherwise(F.col("r"))
    samples_shown = in_history(samples, seen, limit) if with_history else samples.withColumn("in_history", F.lit(False))
    q = samples_shown.withColumn("full_r", F.col("r")).withColumn("r", base_r)
    q = _named(_named(_named(q, relations, "r"), names, "e"), names, "answer")
    q = q.join(past, ["e", "t"], "left")
    from .facts import answers

    # the answers of a query's key are gathered once and met last, so no row of theirs is dealt to a query before
    other = answers(seen, n_rel).select("e", F.col("r").alias("full_r"), "t", F.col("answer").alias("x"))
    other = other.join(samples.select("e", F.col("r").alias("full_r"), "t").distinct(), ["e", "full_r", "t"], "left_semi")
    other = _named(other, names, "x").groupBy("e", "full_r", "t").agg(F.sort_array(F.collect_list(F.struct("x", "x_name"))).alias("f"))
    filters = F.transform(F.filter("f", lambda x: x["x"] != F.col("answer")), lambda x: x["x_name"])
    mark = F.lit("?")
    query = F.when(F.col("dir") == 0, fact_line(F.col("t"), F.col("e_name"), F.col("r_name"), mark)).otherwise(fact_line(F.col("t"), mark, F.col("r_name"), F.col("e_name")))
    text = prompt_text(F.col("e_name"), F.coalesce("past", F.lit("")), query)
    out = q.join(other, ["e", "full_r", "t"], "left").withColumn("filters", filters).withColumn("split", F.lit(split))
    return out.select(
        "id", text.alias("input"), F.col("answer_name").alias("output"), F.coalesce("filters", F.array().cast("array<string>")).alias("filters"),
        F.struct(F.col("e").alias("s_id"), F.col("full_r").alias("r_id"), F.col("answer").alias("o_id"), "t", "split", F.when(F.col("dir") == 0, "forward").otherwise("backward").alias("direction"), "in_history").alias("meta"),
    )
