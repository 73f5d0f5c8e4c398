"""Training items from token lists: lengths, labels with masks, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def items(rows: DataFrame, prompt: Column, output: Column, *, end_id: int | None = None) -> DataFrame:
    """``rows`` plus input_ids, labels (the prompt is masked), attention_mask and total_len."""
    out = output if end_id is None else F.concat(output, F.array(F.lit(end_id)))
    rows = rows.withColumn("_p", prompt).withColumn("_o", out)
    ids = F.concat("_p", "_o")
    rows = rows.withColumn("input_ids", ids).withColumn("labels", F.concat(F.transform("_p", lambda _: F.lit(IGNORED)), F.col("_o")))
    return rows.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1))).withColumn("total_len", F.size("input_ids")).drop("_p", "_o")


def length_histogram(rows: DataFrame, length: Column, bin_size: int, max_len: int) -> DataFrame:
    """(bin, label, n, over): items by length; ``over`` marks bins that reach beyond ``max_len``."""
    b = F.greatest(F.floor((length - 1) / bin_size), F.lit(0)).cast("long")
    n = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    label = F.concat((F.col("bin") * bin_size + 1).cast("string"), F.lit("-"), ((F.col("bin") + 1) * bin_size).cast("string"))
    return n.select("bin", label.alias("label"), "n", ((F.col("bin") + 1) * bin_size > max_len).alias("over"))


def padded(rows: DataFrame, batch: Column, *, pad_id: int, multiple: int = 8) -> DataFrame:
    """Items padded to their batch's greatest length, rounded up to a multiple."""
    rows = rows.withColumn("_batch", batch)
    most = rows.groupBy("_batch").agg(F.max(F.size("input_ids")).alias("_most"))
    rows = rows.join(most, "_batch")
    gap = F.ceil(F.col("_most") / multiple) * multiple - F.size("input_ids")
    for col, value in (("input_ids", pad_id), ("labels", IGNORED), ("attention_mask", 0)):
        rows = rows.withColumn(f"_{col}", F.concat(F.col(col), F.array_repeat(F.lit(value), gap.cast("int"))))
    for col in ("input_ids", "labels", "attention_mask"):
        rows = rows.drop(col).withColumnRenamed(f"_{col}", col)
    return rows.drop("_batch", "_most")


def targets_as_codes(samples: DataFrame, names: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples whose ``output`` is a code, or a name turned into its entity's code; and one row of
    counts (kept, missing). ``names`` (entity, name), ``codes`` (entity, tokens)."""
    from ..functions.text import looks_like_code, normalize_entity_name

    known = names.join(codes, "entity").select(normalize_entity_name(F.col("name")).alias("_name"), "tokens").groupBy("_name").agg(F.max("tokens").alias("_tokens"))
    s = samples.withColumn("_name", normalize_entity_name(F.col("output"))).join(known, "_name", "left")
    s = s.withColumn("output", F.when(looks_like_code(F.col("output")), F.trim("output")).otherwise(F.col("_tokens"))).drop("_name", "_tokens")
    counts = s.agg(F.count("output").alias("kept"), (F.count(F.lit(1)) - F.count("output")).alias("missing"))
    return s.where("output IS NOT NULL"), counts


def _mark(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def shuffled(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Rows in a reproducible random order: of a hash of seed and id."""
    return rows.orderBy(_mark(id_col, seed), id_col)


def shuffle_places(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """``rows`` with an id plus ``place`` from 0 in the order of ``shuffled``; only the sizes of 4,096 ranges
    of the hash are ordered together."""
    from .order import number_rows

    head = F.conv(F.substring(_mark(id_col, seed), 1, 15), 16, 10).cast("long")
    marked = rows.where(F.col(id_col).isNotNull()).withColumn("_mark", head)
    return number_rows(marked, [], "_mark", "place", then=(id_col,), width=1 << 48).drop("_mark")


def first_rows(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """The first ``most`` rows in order of their id: a limit of a trial run."""
    return rows.orderBy(id_col).limit(most)


def next_tokens(paths: DataFrame, end: int) -> DataFrame:
    """(prefix, tokens): the tokens that continue each prefix (ids joined by commas, the root is '') of the
    token lists ``paths`` (path), sorted; ``end`` comes last where a whole path ends."""
    at = F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.struct(F.slice("path", 1, k).alias("head"), F.try_element_at("path", k + 1).alias("token")))
    rows = paths.where(F.size("path") > 0).select(F.explode(at).alias("x")).select(_key(F.col("x.head")).alias("prefix"), "x.token").distinct()
    inside = F.sort_array(F.collect_set("token"))  # nulls, the ends, are not collected
    ends = F.max(F.col("token").isNull())
    return rows.groupBy("prefix").agg(F.when(ends, F.concat(inside, F.array(F.lit(end)))).otherwise(inside).alias("tokens"))


def _key(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def allowed_labels(rows: DataFrame, id_col: str, paths: DataFrame, end: int) -> DataFrame:
    """(id, position from 0, token, allowed): for every label of a sample that is not masked the tokens
    that may stand there after the labels before it. A prefix of no path allows only ``end``; the label
    itself is always allowed, last where the paths do not have it."""
    target = F.filter("labels", lambda x: x != IGNORED)
    at = F.transform(F.sequence(F.lit(0), F.size("_t") - 1), lambda k: F.struct(k.alias("position"), F.element_at("_t", k + 1).alias("token"), _key(F.slice("_t", 1, k)).alias("prefix")))
    spots = rows.select(F.col(id_col).alias("id"), target.alias("_t")).where(F.size("_t") > 0).select("id", F.explode(at).alias("x")).select("id", "x.*")
    met = spots.join(next_tokens(paths, end), "prefix", "left").withColumn("tokens", F.coalesce("tokens", F.array(F.lit(end))))
    own = F.when(F.array_contains("tokens", F.col("token")), F.col("tokens")).otherwise(F.concat("tokens", F.array("token")))
    return met.select("id", "position", "token", own.alias("allowed"))


def pad_allowed(allowed: DataFrame, batch: Column) -> DataFrame:
    """``allowed`` with its lists padded by 0 to the longest of their batch, and ``mask`` of what is real."""
    rows = allowed.withColumn("_batch", batch).withColumn("_n", F.size("allowed"))
    most = rows.groupBy("_batch").agg(F.max("_n").alias("_most"))
    fill = lambda x, n: F.array_repeat(F.lit(x), n.cast("int"))
    gap = F.col("_most") - F.col("_n")
    rows = rows.join(most, "_batch").withColumn("mask", F.concat(fill(True, F.col("_n")), fill(False, gap)))
    return rows.withColumn("allowed", F.concat("allowed", fill(0, gap))).drop("_batch", "_n", "_most")
