"""Facts (seq, s, r, o, t): projections, answer sets and dictionaries of what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def relation_count(facts: DataFrame) -> int:
    """Number of distinct relations: the step from a relation's id to its inverse's."""
    return facts.agg(F.count_distinct("r")).first()[0]


def inverse(facts: DataFrame, n_rel: int) -> DataFrame:
    """(o, r + n_rel, s): the same facts read backwards."""
    others = [c for c in facts.columns if c not in ("s", "r", "o")]
    return facts.select(F.col("o").alias("s"), (F.col("r") + n_rel).alias("r"), F.col("s").alias("o"), *others)


def both_directions(facts: DataFrame, n_rel: int) -> DataFrame:
    return facts.unionByName(inverse(facts, n_rel))


def split_by_time(facts: DataFrame, valid_from: int, test_from: int) -> DataFrame:
    return facts.withColumn("split", F.when(F.col("t") < valid_from, "train").when(F.col("t") < test_from, "valid").otherwise("test"))


#: Most ids that are put into one text; a larger set has none, only its size, and its members are rows elsewhere.
MAX_LISTED = 100_000


def listed(rows: DataFrame, keys: list[str], item: str, name: str) -> DataFrame:
    """(keys, ``name``, n): the distinct items of each group as text, sorted, by commas, and their number.

    Items are deduplicated as rows and numbered in their group's order, so no cell holds more than
    ``MAX_LISTED`` of them whatever the group; nulls are no items."""
    distinct = rows.select(*keys, F.col(item).alias("_x")).distinct()
    place = F.count("_x").over(W.partitionBy(*keys).orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow))
    g = distinct.withColumn("_p", place).groupBy(*keys).agg(F.count("_x").alias("n"), F.collect_list(F.when(F.col("_p") <= MAX_LISTED, F.col("_x"))).alias("_l"))
    text = F.array_join(F.transform(F.sort_array("_l"), lambda x: x.cast("string")), ",")
    return g.select(*keys, F.when(F.col("n") <= MAX_LISTED, text).alias(name), "n")


def queries_of(facts: DataFrame, n_rel: int) -> DataFrame:
    """Two queries per fact: (seq, dir, e, r, answer, t); dir 1 asks for the subject and has the inverse relation."""
    forward = facts.select("seq", F.lit(0).alias("dir"), F.col("s").alias("e"), "r", F.col("o").alias("answer"), "t")
    backward = facts.select("seq", F.lit(1).alias("dir"), F.col("o").alias("e"), (F.col("r") + n_rel).alias("r"), F.col("s").alias("answer"), "t")
    return forward.unionByName(backward)


def answers(facts: DataFrame, n_rel: int) -> DataFrame:
    """True answers of every query at its own time: (e, r, t, answer), distinct."""
    return queries_of(facts, n_rel).select("e", "r", "t", "answer").distinct()


def answer_sets(facts: DataFrame, n_rel: int) -> DataFrame:
    """Answers of every query at its time; ``answers`` has them as rows of any number."""
    return listed(queries_of(facts, n_rel), ["e", "r", "t", "dir"], "answer", "answers")


def static_answer_sets(facts: DataFrame, n_rel: int) -> DataFrame:
    """Answers whatever the time: objects, subjects (inverse relation) and relations of a pair."""

    def of(kind, a, b, x):
        return facts.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), x.alias("x"))

    s, r, o = F.col("s"), F.col("r"), F.col("o")
    rows = of("object", s, r, o).unionByName(of("subject", o, r + n_rel, s)).unionByName(of("relation", s, o, r))
    return listed(rows, ["kind", "a", "b"], "x", "answers").drop("n")


def first_seen(facts: DataFrame, n_rel: int) -> DataFrame:
    """(s, r, o, first_t) of both directions: the dictionary of answers known before t has first_t < t."""
    return both_directions(facts, n_rel).groupBy("s", "r", "o").agg(F.min("t").alias("first_t"))


def known_answers(facts: DataFrame, queries: DataFrame, n_rel: int) -> DataFrame:
    """(e, r, t, n): how many answers each distinct query has been seen with before its time."""
    from .order import as_of_sum

    seen = first_seen(facts, n_rel).select(F.col("s").alias("e"), "r", F.col("first_t").alias("t"))
    return as_of_sum(seen, queries, ["e", "r"], "t", F.lit(1).cast("long"), "n")


def relation_entities(facts: DataFrame, n_rel: int) -> DataFrame:
    """Entities of each relation of a snapshot. As in the original definition, the inverse relation has the subjects too."""
    by = listed(facts, ["t", "r"], "s", "entities")
    both = F.explode(F.array(F.col("r"), F.col("r") + n_rel)).alias("r")
    return by.select("t", both, "entities", "n")


def entity_relations(facts: DataFrame) -> DataFrame:
    """Relations of each subject of a snapshot."""
    return listed(facts, ["t", "s"], "r", "relations")


def predicate_frequency(facts: DataFrame) -> DataFrame:
    """Relations by falling frequency, with their place."""
    n = facts.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "r")))


def relabel(facts: DataFrame) -> DataFrame:
    """Entities of each snapshot with dense ids from 0: (t, e, node)."""
    e = facts.select("t", F.col("s").alias("e")).unionByName(facts.select("t", F.col("o").alias("e"))).distinct()
    from .order import number_within

    return number_within(e, ["t"], "e", "node", width=1 << 16)
