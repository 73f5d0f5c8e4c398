"""Evidence for descriptions: counted contexts, the most frequent of them, and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalize_label


def _name(df: DataFrame, names: DataFrame, side: str) -> DataFrame:
    """``df`` plus the label of an id column, the id itself where it has no name."""
    n = names.select(F.col("id").alias(side), F.col("name").alias("_n"))
    return df.join(n, side, "left").withColumn(f"{side}_name", normalize_label(F.coalesce("_n", F.col(side).cast("string")))).drop("_n")


def context_counts(facts: DataFrame, names: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id, text, count, first): what each entity and relation occurs with, and where first.

    Facts are counted by ids before names are joined, so texts are made once per distinct context."""
    f = facts.groupBy("s", "r", "o").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    f = _name(_name(_name(f, names, "s"), names, "o"), relations, "r")

    def of(kind, i, text):
        return F.struct(F.lit(kind).alias("kind"), F.col(i).alias("id"), text.alias("text"))

    r, s, o = F.col("r_name"), F.col("s_name"), F.col("o_name")
    # fixed values: the wording of the evidence
    out = F.concat(F.lit("OUT relation="), r, F.lit("; counterpart="), o)
    into = F.concat(F.lit("IN relation="), r, F.lit("; counterpart="), s)
    rows = F.array(of("entity", "s", out), of("entity", "o", into), of("relation", "r", F.concat(s, F.lit(" -> "), o)))
    long = f.select(F.posexplode(rows).alias("_k", "x"), "n", "seq").select("x.*", "n", (F.col("seq") * 3 + F.col("_k")).alias("at"))
    return long.groupBy("kind", "id", "text").agg(F.sum("n").alias("count"), F.min("at").alias("first"))


def context_top(counts: DataFrame, most: int, least_count: int) -> DataFrame:
    """(kind, id, place, text): the most frequent contexts with their frequency, ties by first sight."""
    place = F.row_number().over(W.partitionBy("kind", "id").orderBy(F.desc("count"), "first"))
    c = counts.where(F.col("count") >= least_count).withColumn("place", place).where(F.col("place") <= most)
    return c.select("kind", "id", "place", F.concat("text", F.lit("; freq="), F.col("count").cast("string")).alias("text"))


def messages(items: DataFrame, top: DataFrame, *, system: str, task: Column, most_words: int = 120) -> DataFrame:
    """(kind, id, messages): a system and a user message for each item (kind, id, name).

    ``system`` and ``task`` are the caller's instructions; the user message names the item and
    lists its evidence, or NONE."""
    lines = top.groupBy("kind", "id").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("e"))
    block = F.coalesce(F.array_join(F.transform("e", lambda x: F.concat(F.lit("- "), x["text"])), "\n"), F.lit("- NONE"))
    user = F.concat(task, F.lit("\n"), F.initcap("kind"), F.lit(" name: "), F.col("name"), F.lit("\nEvidence:\n"), block, F.lit(f"\nAt most {most_words} words.\n"))
    made = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return items.join(lines, ["kind", "id"], "left").select("kind", "id", made.alias("messages"))


def pending(items: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Items (kind, id) that have no description yet."""
    return items if force else items.join(done.where("description IS NOT NULL AND trim(description) <> ''"), ["kind", "id"], "left_anti")


def coverage(items: DataFrame, described: DataFrame, contexts: DataFrame) -> DataFrame:
    """(kind, total, filled, covered): items (kind, id), those with a description, those with evidence."""
    has = described.where("description IS NOT NULL AND trim(description) <> ''").select("kind", "id").distinct().withColumn("_d", F.lit(1))
    seen = contexts.select("kind", "id").distinct().withColumn("_c", F.lit(1))
    i = items.join(has, ["kind", "id"], "left").join(seen, ["kind", "id"], "left")
    return i.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count("_d").alias("filled"), F.count("_c").alias("covered"))
