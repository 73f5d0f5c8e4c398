"""Scores of candidate entities, raw and filtered ranks, MRR and Hits@k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalize_text
from .facts import answers, both_directions, queries_of
from .order import as_of_sum, number_rows

HITS = (1, 3, 10, 50)


def entities(facts: DataFrame) -> DataFrame:
    """(entity, pos): every entity, numbered from 0 by id."""
    e = facts.select(F.col("s").alias("entity")).unionByName(facts.select(F.col("o").alias("entity"))).distinct()
    return number_rows(e, [], "entity", "pos")


def candidates_seen(facts: DataFrame, queries: DataFrame, n_rel: int) -> DataFrame:
    """(e, r, t, entity, n): entities seen as answers of (e, r) before each queried time, and how often."""
    past = both_directions(facts, n_rel).select(F.col("s").alias("e"), "r", F.col("o").alias("entity"), "t")
    first = past.groupBy("e", "r", "entity").agg(F.min("t").alias("_first"))
    # a row for each result; how often follows from running counts, not from a join with all that happened
    pairs = queries.select("e", "r", "t").distinct().join(first, ["e", "r"]).where(F.col("_first") < F.col("t")).drop("_first")
    return as_of_sum(past, pairs, ["e", "r", "entity"], "t", F.lit(1).cast("long"), "n").select("e", "r", "t", "entity", "n")


def frequency_score(n: Column, total: Column, n_entities: Column) -> Column:
    """Smoothed log share of an answer among the answers so far."""
    return F.log((n + 1) / (total + n_entities))


def ranks(facts: DataFrame, queries: DataFrame, n_rel: int, all_facts: DataFrame | None = None) -> DataFrame:
    """``queries`` (seq, dir, e, r, answer, t) plus ``raw_rank`` and ``filtered_rank`` by falling
    frequency score, ties to the smaller id. Filtered ranks leave out the other true answers of the time.

    Entities never seen tie at the lowest score, so their places follow from how many there are
    below an id; no query is crossed with all entities."""
    pool = all_facts if all_facts is not None else facts
    pos = entities(pool)
    seen = candidates_seen(facts, queries, n_rel).join(pos, "entity")
    true = answers(pool, n_rel).withColumnRenamed("answer", "entity").join(pos, "entity").withColumn("true", F.lit(1))
    options = seen.select("e", "r", "t", "entity", "pos", "n").join(true.select("e", "r", "t", "entity", F.col("pos").alias("_pos"), "true"), ["e", "r", "t", "entity"], "full")
    options = options.select("e", "r", "t", "entity", F.coalesce("pos", "_pos").alias("pos"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("true", F.lit(0)).alias("true"))
    q = queries.join(pos.select(F.col("entity").alias("answer"), F.col("pos").alias("answer_pos")), "answer")
    mine = q.select("e", "r", "t", F.col("answer").alias("entity"), F.col("answer_pos").alias("_at")).distinct()
    # answers stand in one order with the options of their query, so counts before them are running counts
    both = options.withColumn("_is", F.lit(1)).join(mine, ["e", "r", "t", "entity"], "full")
    both = both.select("e", "r", "t", "entity", F.coalesce("pos", "_at").alias("pos"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("true", F.lit(0)).alias("true"), F.coalesce("_is", F.lit(0)).alias("_is"), F.col("_at").isNotNull().alias("_asked"))
    group = W.partitionBy("e", "r", "t")
    before = lambda c, *order: F.coalesce(F.sum(c).over(group.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    best = (F.desc("n"), F.asc("pos"))
    g = both.withColumn("ahead", before("_is", *best)).withColumn("ahead_true", before("true", *best)).withColumn("below", before("_is", "pos")).where("_asked").withColumnRenamed("entity", "answer")
    unseen = F.when(F.col("n") == 0, F.col("pos") - F.col("below")).otherwise(0)
    g = g.withColumn("raw_rank", (1 + F.col("ahead") + unseen).cast("long")).withColumn("filtered_rank", (F.col("raw_rank") - F.col("ahead_true")).cast("long"))
    return queries.join(g.select("e", "r", "t", "answer", "raw_rank", "filtered_rank"), ["e", "r", "t", "answer"])


def summary(ranked: DataFrame, rank: str, by: Sequence[str] = (), hits: Sequence[int] = HITS) -> DataFrame:
    """MRR, Hits@k and the number of queries; a null rank counts as a miss."""
    r = F.col(rank)
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_eval"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), *(F.avg((F.coalesce(r <= k, F.lit(False))).cast("double")).alias(f"hits_{k}") for k in hits)
    )


def list_rank(predicted: DataFrame, targets: DataFrame, filters: DataFrame, *, distinct: bool = True) -> DataFrame:
    """Rank of each target in its list: (id, rank), null where absent.

    ``predicted`` (id, place, item), ``targets`` (id, item), ``filters`` (id, item): filtered
    items other than the target are passed over; with ``distinct`` repeats of an item are too."""
    p = predicted.select("id", "place", "item")
    if distinct:
        p = p.groupBy("id", "item").agg(F.min("place").alias("place"))
    t = targets.select("id", F.col("item").alias("_target"))
    drop = filters.select("id", "item").distinct().withColumn("_f", F.lit(1))
    p = p.join(t, "id").join(drop, ["id", "item"], "left").where("_f IS NULL OR item = _target")
    hit = p.where("item = _target").groupBy("id").agg(F.min("place").alias("_at"))
    rank = p.join(hit, "id").where("place <= _at").groupBy("id").agg(F.count(F.lit(1)).alias("rank"))
    return targets.select("id").distinct().join(rank, "id", "left")


def top_k(scored: DataFrame, by: list[str], k: int, score: str = "score", item: str = "entity") -> DataFrame:
    """The ``k`` best rows of each group, ``place`` from 1, ties to the smaller item."""
    return scored.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), item))).where(F.col("place") <= k)


def predicted_triples(top: DataFrame, n_rel: int) -> DataFrame:
    """Top answers of queries (e, r, entity) as facts: inverse queries are turned round."""
    forward = F.col("r") < n_rel
    return top.select(
        F.when(forward, F.col("e")).otherwise(F.col("entity")).alias("s"), F.when(forward, F.col("r")).otherwise(F.col("r") - n_rel).alias("r"),
        F.when(forward, F.col("entity")).otherwise(F.col("e")).alias("o"), "t",
    ).distinct()


def queries_of_test(facts: DataFrame, n_rel: int) -> DataFrame:
    return queries_of(facts.where("split = 'test'"), n_rel)


def totals_before(facts: DataFrame, queries: DataFrame, n_rel: int) -> DataFrame:
    """(e, r, t, total): earlier facts of each queried (entity, relation)."""
    past = both_directions(facts, n_rel).select(F.col("s").alias("e"), "r", "t")
    return as_of_sum(past, queries, ["e", "r"], "t", F.lit(1).cast("long"), "total")


#: Lengths of the hit lists of the metrics by name.
NAME_HITS = (1, 3, 10, 30, 50)


def metrics_by_name(predicted: DataFrame, targets: DataFrame, filters: DataFrame, hits: Sequence[int] = NAME_HITS) -> DataFrame:
    """One row: MRR and Hits@k of lists of names, compared without case and odd spaces. Repeats of a
    name each take a place. Columns as in ``list_rank``."""
    plain = lambda d: d.withColumn("item", normalize_text(F.coalesce("item", F.lit(""))))
    return summary(list_rank(plain(predicted), plain(targets), plain(filters), distinct=False), "rank", hits=hits)
