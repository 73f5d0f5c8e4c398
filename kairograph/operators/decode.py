"""Prefix-constrained beam decoding over a prefix table, fusing two score sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scores

MODES = ("graph", "hybrid", "llm")
#: Places to which scores are rounded where they decide an order, so that ties are ties everywhere.
TIE = 9


def prefix_table(coded: DataFrame, levels: int, id_col: str) -> DataFrame:
    """(level from 1, parent, token, prefix, entity): every prefix of every entity's code; the root is ''."""
    z = [F.col(f"z{k}").cast("string") for k in range(levels)]
    rows = [F.struct(F.lit(k + 1).alias("level"), F.concat_ws("-", *z[:k]).alias("parent"), F.col(f"z{k}").cast("int").alias("token"), F.concat_ws("-", *z[: k + 1]).alias("prefix")) for k in range(levels)]
    return coded.select(F.explode(F.array(*rows)).alias("x"), F.col(id_col).alias("entity")).select("x.*", "entity")


def prefix_counts(table: DataFrame) -> DataFrame:
    """(prefix, level, entities): entities below each prefix, the root included."""
    below = table.groupBy("prefix", "level").agg(F.count_distinct("entity").alias("entities"))
    root = table.where("level = 1").agg(F.lit("").alias("prefix"), F.lit(0).alias("level"), F.count_distinct("entity").alias("entities"))
    return below.unionByName(root)


def allowed_tokens(table: DataFrame) -> DataFrame:
    """(parent, level, tokens): next tokens of each prefix, sorted, as text."""
    return table.groupBy("parent", "level").agg(F.array_join(F.transform(F.sort_array(F.collect_set("token")), lambda x: x.cast("string")), ",").alias("tokens"))


def next_token_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("parent", "level", "token").agg(F.count_distinct("entity").alias("entities"))


def prefix_max_scores(scored: DataFrame, table: DataFrame) -> DataFrame:
    """(query, level, parent, token, prefix, best): highest entity score below each child prefix."""
    return scored.join(table, "entity").groupBy("query", "level", "parent", "token", "prefix").agg(F.max("score").alias("best"))


def prefix_log_mass(scored: DataFrame, table: DataFrame) -> DataFrame:
    """(query, prefix, mass): log-sum-exp of the entity scores below each prefix.

    Scores are summed up by hundreds, relative to the hundred, so no exponential overflows and the
    greatest score is not joined back to every row."""
    hundred = F.floor(F.col("score") / 100).cast("double")
    s = scored.join(table, "entity").withColumn("_h", hundred)
    parts = s.groupBy("query", "prefix", "_h").agg(F.sum(F.exp(F.col("score") - 100 * F.col("_h"))).alias("_sum"), F.max("_h").alias("_top"))
    own = F.sort_array(F.collect_list(F.when(F.col("_h").isNotNull(), F.struct("_h", "_sum"))), False)
    return parts.groupBy("query", "prefix").agg(F.max("_top").alias("_top"), own.alias("_p")).select("query", "prefix", (100 * F.col("_top") + F.log(F.aggregate("_p", F.lit(0.0), lambda a, x: a + x["_sum"] * F.exp(100 * (x["_h"] - F.col("_top")))))).alias("mass"))


def topk_mean(scored: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Mean of the ``k`` highest scores of each group."""
    best = scored.withColumn("_p", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score")))).where(F.col("_p") <= k)
    return best.groupBy(*by).agg(F.avg("score").alias("mean"))


def step_scores(step: DataFrame, topk: int) -> DataFrame:
    """``step`` (query, parent, token, llm_raw, graph_raw) plus ``llm`` (renormalised over the
    ``topk`` best allowed tokens, null for the others) and ``graph`` (over all allowed tokens)."""
    group = W.partitionBy("query", "parent")
    place = F.row_number().over(group.orderBy(F.round("llm_raw", TIE).desc_nulls_last(), "token"))
    step = step.withColumn("_raw", F.when(place <= topk, F.col("llm_raw")))
    llm = F.when(F.col("_raw").isNotNull(), scores.log_softmax(F.col("_raw"), group))
    return step.withColumn("llm", llm).withColumn("graph", scores.log_softmax(F.col("graph_raw"), group)).drop("_raw")


def beam_decode(queries: DataFrame, scored: DataFrame, table: DataFrame, levels: int, llm: Callable[[DataFrame], DataFrame], *, alphas: Sequence[float] | None = None, final_alpha: float = 0.5, beams: int = 64, topk: int = 128, modes: Sequence[str] = MODES, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query, mode, prefix, score, llm_score, graph_score, rank_score, place): the beams after the last level.

    ``llm`` adds ``llm_raw`` to (query, level, parent, token); every distinct parent is asked
    once for all modes. A null hybrid score is minus infinity. ``cut`` may write a level's
    beams to cut their lineage (the default persists nothing)."""
    now = queries.select("query", F.explode(F.array(*map(F.lit, modes))).alias("mode"), F.lit("").alias("prefix"), *(F.lit(0.0).alias(c) for c in ("score", "llm_score", "graph_score")))
    for level in range(levels):
        parents = now.select("query", F.col("prefix").alias("parent")).distinct()
        below = table.where(F.col("level") == level + 1).join(parents.select("parent").distinct(), "parent", "left_semi")
        # scores below parents that no beam holds any more are not looked at
        met = scored.join(below, "entity").join(parents, ["query", "parent"], "left_semi")
        step = met.groupBy("query", "level", "parent", "token", "prefix").agg(F.max("score").alias("graph_raw"))
        step = step_scores(llm(step), topk).where("llm IS NOT NULL OR graph IS NOT NULL")
        alpha = scores.alpha_of_level(level, alphas, final_alpha)
        step = step.withColumn("mixed", scores.mix_log_probs(F.col("llm"), F.col("graph"), F.lit(alpha)))
        ahead = now.withColumnRenamed("prefix", "parent").join(step.select("query", "parent", "prefix", "llm", "graph", "mixed"), ["query", "parent"])
        plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(scores.NO_SCORE))
        ahead = ahead.select("query", "mode", "prefix", (F.col("score") + F.col("mixed")).alias("score"), plus("llm_score", "llm").alias("llm_score"), plus("graph_score", "graph").alias("graph_score"))
        ahead = ahead.withColumn("rank_score", mode_score())
        place = F.row_number().over(W.partitionBy("query", "mode").orderBy(F.round("rank_score", TIE).desc_nulls_last(), "prefix"))
        now = ahead.withColumn("place", place).where(F.col("place") <= beams)
        if cut is not None:
            now = cut(now)
        if level < levels - 1:
            now = now.drop("rank_score", "place")
    return now


def mode_score() -> Column:
    return F.when(F.col("mode") == "hybrid", F.col("score")).when(F.col("mode") == "llm", F.col("llm_score")).otherwise(F.col("graph_score"))


def list_lengths(filters: DataFrame, topk: int, hits: Sequence[int]) -> DataFrame:
    """(query, topk): how many entities a query's metric needs, that filtered ones (query, entity) leave enough places."""
    return filters.groupBy("query").agg(F.greatest(F.lit(topk), F.lit(max(hits)) + F.count_distinct("entity")).alias("topk"))


def rank_entities(beams: DataFrame, table: DataFrame, scored: DataFrame, levels: int, topk: int, lengths: DataFrame | None = None) -> DataFrame:
    """(query, mode, place, entity, code, rank_score, entity_score): entities of the beams' codes,
    ``topk`` of each query, or as many as ``lengths`` (query, topk) says.

    Codes go by their rank score; entities of one code by graph score (by id in mode llm)."""
    code = table.where(F.col("level") == levels).select("prefix", "entity")
    own = scored.select("query", "entity", F.col("score").alias("score_entity"))
    c = beams.join(code, "prefix").join(own, ["query", "entity"])
    return rank_candidates(c.select("query", "mode", "prefix", "entity", "rank_score", "score_entity"), topk, lengths)


def rank_candidates(c: DataFrame, topk: int, lengths: DataFrame | None = None) -> DataFrame:
    """``rank_entities`` of candidates (query, mode, prefix, entity, rank_score, score_entity) at hand."""
    inside = F.when(F.col("mode") == "llm", F.lit(0.0)).otherwise(F.round("score_entity", TIE))
    c = c.select("query", "mode", "prefix", "entity", "rank_score", "score_entity")
    order = [F.round("rank_score", TIE).desc_nulls_last(), inside.desc()]
    first = F.row_number().over(W.partitionBy("query", "mode", "entity").orderBy(*order, "prefix"))
    c = c.withColumn("_first", first).where("_first = 1")
    place = F.row_number().over(W.partitionBy("query", "mode").orderBy(*order, "entity"))
    c = c.withColumn("place", place)
    if lengths is not None:
        c = c.join(lengths.select("query", F.col("topk").alias("_topk")), "query", "left").where(F.col("place") <= F.coalesce("_topk", F.lit(topk)))
    else:
        c = c.where(F.col("place") <= topk)
    return c.select("query", "mode", "place", "entity", F.col("prefix").alias("code"), "rank_score", F.col("score_entity").alias("entity_score"))


def resolve_filters(filters: DataFrame, names: DataFrame, codes: DataFrame) -> DataFrame:
    """(id, entity): what filter texts mean: digits are an id, code tokens all entities of the
    code, anything else a name. ``names`` (entity, name), ``codes`` (entity, tokens)."""
    from ..functions.text import normalize_entity_text, squeeze

    f = filters.select("id", squeeze(F.col("filter")).alias("filter")).where("filter <> ''")
    digits, token = F.col("filter").rlike("^-*[0-9]+$"), F.col("filter").rlike("<[^>]+>")
    ids = f.where(digits).select("id", F.expr("try_cast(filter AS BIGINT)").alias("entity")).where("entity IS NOT NULL")
    asked = f.where(~digits & token).select("id", F.regexp_replace("filter", "[^<>0-9a-z_]+", "").alias("tokens")).distinct()
    own = names.select(normalize_entity_text(F.col("name")).alias("name"), "entity").groupBy("name").agg(F.max("entity").alias("entity"))
    by_name = f.where(~digits & ~token).select("id", normalize_entity_text(F.col("filter")).alias("name")).join(own, "name").select("id", "entity")
    single, held = ids.unionByName(by_name).distinct(), codes.select("tokens", "entity").distinct()
    # an id that asks for one code only, and nothing else, gets each of its entities once: these rows, by
    # far the most, are not compared with each other
    kinds = asked.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).join(single.select("id").distinct().withColumn("_more", F.lit(1)), "id", "left")
    plain = kinds.where("_n = 1 AND _more IS NULL").select("id")
    met = lambda a: a.join(held, "tokens").select("id", "entity")
    mixed = met(asked.join(plain, "id", "left_anti")).unionByName(single).distinct()
    return met(asked.join(plain, "id", "left_semi")).unionByName(mixed)


def allowed_with_end(table: DataFrame, levels: int, end: int) -> DataFrame:
    """(parent, tokens): next tokens of every prefix, the ``end`` token after a whole code."""
    inside = table.groupBy("parent").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    whole = table.where(F.col("level") == levels).select(F.col("prefix").alias("parent")).distinct().withColumn("tokens", F.array(F.lit(end)))
    return inside.unionByName(whole)


def code_rows(beams: DataFrame, topk: int) -> DataFrame:
    """The best codes of every query and mode with their scores."""
    return beams.where(F.col("place") <= topk).select("query", "mode", "place", F.col("prefix").alias("code"), "score", "llm_score", "graph_score", "rank_score")
