"""Residual-quantised semantic codes: fitting, encoding, decoding and quality measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.text import code_string, code_token
from .graph import mean_pool
from .seeding import seed_centroids

#: Most numbers in a level's codebook that are sent to every task.
MAX_CODEBOOK = 4_000_000


def codebook_row(codebooks: DataFrame, level: int) -> DataFrame:
    """One row: the level's centroids in the order of their codes (``book``)."""
    own = codebooks.where(F.col("level") == level)
    numbers = own.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()[0]
    if numbers > MAX_CODEBOOK:
        raise ValueError(f"codebook of level {level} has {numbers} numbers, more than {MAX_CODEBOOK}")
    return own.agg(F.sort_array(F.collect_list(F.struct("code", "centroid"))).alias("book"))


def encode(rows: DataFrame, codebooks: DataFrame, levels: int, *, vec_col: str = "v", normalize: bool = True) -> DataFrame:
    """``rows`` plus ``z0..`` (nearest centroid of each level's residual, ties to the lower code),
    ``residual`` of the last level and the levels' residual norms ``norm0..``.

    No shuffle: each level's codebook, of a checked size, is one broadcast row."""
    out = rows.withColumn("residual", F.transform(vec_col, lambda x: x.cast("double")))
    for level in range(levels):
        book = codebook_row(codebooks, level)
        cur = v.l2_normalize(F.col("residual")) if normalize else F.col("residual")
        out = out.withColumn("_cur", cur).crossJoin(F.broadcast(book))
        out = out.withColumn("_best", F.array_min(F.transform("book", lambda c: F.struct(v.squared_distance(F.col("_cur"), c["centroid"]).alias("d"), c["code"].alias("code"), c["centroid"].alias("c")))))
        out = out.withColumn(f"z{level}", F.col("_best.code")).withColumn("residual", v.subtract(F.col("_cur"), F.col("_best.c"))).drop("book", "_cur", "_best")
        out = out.withColumn(f"norm{level}", v.norm(F.col("residual")))
    return out


def z_columns(levels: int) -> list[str]:
    return [f"z{k}" for k in range(levels)]


def with_code(rows: DataFrame, levels: int) -> DataFrame:
    """``rows`` plus ``code`` (a-b-c) and ``tokens`` (one per level, counted from 1)."""
    z = z_columns(levels)
    tokens = F.concat_ws("", *(code_token(F.lit(k + 1), F.col(c)) for k, c in enumerate(z)))
    return rows.withColumn("code", code_string(F.array(*z))).withColumn("tokens", tokens)


def decode(rows: DataFrame, codebooks: DataFrame, levels: int) -> DataFrame:
    """``rows`` plus ``decoded``: the sum of their codes' centroids."""
    out = rows
    for level in range(levels):
        part = codebooks.where(F.col("level") == level).select(F.col("code").alias(f"z{level}"), F.col("centroid").alias(f"_c{level}"))
        out = out.join(part, f"z{level}")
    total = F.col("_c0")
    for level in range(1, levels):
        total = v.add(total, F.col(f"_c{level}"))
    return out.withColumn("decoded", total).drop(*(f"_c{k}" for k in range(levels)))


def level_metrics(encoded: DataFrame, levels: int, sizes: int) -> DataFrame:
    """(level, coverage, entropy, mean_residual_norm) of an encoding."""
    long = encoded.select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"z{k}").alias("code"), F.col(f"norm{k}").alias("norm")) for k in range(levels)))).alias("x")).select("x.*")
    per = long.groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("norm").alias("norms"))
    # H = ln N - sum(n ln n) / N, so one aggregation suffices
    n, total = F.col("n"), F.sum("n")
    return per.groupBy("level").agg(
        (F.count(F.lit(1)) / F.lit(sizes)).alias("coverage"), (F.log(total) - F.sum(n * F.log(n)) / total).alias("entropy"), (F.sum("norms") / total).alias("mean_residual_norm")
    )


def unique_code_rate(coded: DataFrame) -> DataFrame:
    return coded.agg((F.count_distinct("code") / F.count(F.lit(1))).alias("rate"))


def code_to_entities(coded: DataFrame, id_col: Column) -> DataFrame:
    """(code, entity): one row for each, as a join key rather than a list that grows with the group."""
    return coded.select("code", id_col.alias("entity"))


def token_table(codebooks: DataFrame) -> DataFrame:
    """(token, level from 1, code_index) in order of level, code and token."""
    return codebooks.select(code_token(F.col("level") + 1, F.col("code")).alias("token"), (F.col("level") + 1).alias("level"), F.col("code").alias("code_index"))


def fit_codebooks(rows: DataFrame, levels: int, size: int, *, vec_col: str = "v", normalize: bool = True, max_iter: int = 20, seed: int = 0) -> DataFrame:
    """(level, code, centroid) by k-means on each level's residuals."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark, books = rows.sparkSession, []
    current = rows.select(F.transform(vec_col, lambda x: x.cast("double")).alias("residual"))
    schema = "level int, code int, centroid array<double>"
    for level in range(levels):
        cur = v.l2_normalize(F.col("residual")) if normalize else F.col("residual")
        points = current.select(cur.alias("residual")).withColumn("features", array_to_vector("residual")).persist()
        model = KMeans(k=size, seed=seed + level, maxIter=max_iter).fit(points.select("features"))
        books += [(level, k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
        book = spark.createDataFrame(books, schema)
        current = encode(current.withColumnRenamed("residual", "v"), book.where(F.col("level") == level).withColumn("level", F.lit(0)), 1, normalize=normalize).select("residual")
        points.unpersist()
    return spark.createDataFrame(books, schema)


def move_centroids(book: DataFrame, batch: DataFrame) -> DataFrame:
    """``book`` (code, centroid, n) after a batch of rows (v): each centroid moves towards the mean of
    the batch's rows nearest to it, by their share of all rows it has met (``n``)."""
    level = book.select(F.lit(0).alias("level"), "code", "centroid")
    met = encode(batch.select("v"), level, 1, normalize=False).select(F.col("z0").alias("code"), F.col("v").alias("h"))
    counts = met.groupBy("code").agg(F.count(F.lit(1)).alias("_n"))
    means = mean_pool(met, "code").withColumnRenamed("h", "_mean")
    b = book.join(counts, "code", "left").join(means, "code", "left")
    total = F.col("n") + F.coalesce("_n", F.lit(0))
    moved = v.add(F.col("centroid"), v.scale(v.subtract(F.col("_mean"), F.col("centroid")), F.col("_n") / total))
    return b.select("code", F.coalesce(moved, "centroid").alias("centroid"), total.alias("n"))


def fit_centroids(rows: DataFrame, size: int, *, steps: int = 20, share: float = 0.1, seed: int = 0, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(code, centroid, n) by mini-batches: ``steps`` batches of a ``share`` of the rows (v), from
    centroids seeded over all rows. A step's book is as small as the centroids; ``cut`` writes
    what the seeding reads again."""
    spark = rows.sparkSession
    rows = rows.select(F.transform("v", lambda x: x.cast("double")).alias("v"))
    first = seed_centroids(rows, size, seed=seed, cut=cut)
    schema, book = "code int, centroid array<double>, n long", [(k, c.tolist(), 0) for k, c in enumerate(first)]
    for step in range(steps):
        batch = rows.where(F.pmod(F.xxhash64(F.lit(f"{seed} {step}"), "v"), F.lit(1_000_000)) < int(share * 1_000_000))
        book = [tuple(r) for r in move_centroids(spark.createDataFrame(book, schema), batch).collect()]
    return spark.createDataFrame(book, schema)


def fit_residual(rows: DataFrame, levels: int, size: int, *, vec_col: str = "v", normalize: bool = True, steps: int = 10, share: float = 0.3, seed: int = 0, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(level, code, centroid): ``fit_centroids`` on each level's residuals, one level after the other;
    ``cut`` writes a level's residuals."""
    spark, books = rows.sparkSession, []
    schema = "level int, code int, centroid array<double>"
    current = rows.where(F.col(vec_col).isNotNull()).select(F.transform(vec_col, lambda x: x.cast("double")).alias("residual"))
    for level in range(levels):
        points = cut(current.select((v.l2_normalize(F.col("residual")) if normalize else F.col("residual")).alias("v")))
        fitted = fit_centroids(points, size, steps=steps, share=share, seed=seed + level, cut=cut)
        own = [(r.code, r.centroid) for r in fitted.orderBy("code").collect()]
        books += [(level, code, centroid) for code, centroid in own]
        book = spark.createDataFrame([(0, code, centroid) for code, centroid in own], schema)
        current = encode(points, book, 1, normalize=False).select("residual")
    return spark.createDataFrame(books, schema)
