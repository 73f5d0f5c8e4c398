"""Starting centroids drawn over all rows in a few rounds, many at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import hash_uniform

#: Rounds, and candidates of a round for each centroid wanted.
ROUNDS, PER_CENTROID = 5, 2.0


def _nearest(vectors: Column, centres: np.ndarray) -> Column:
    """(gap, code) of the nearest centre by squared distance, Arrow batches at once."""

    @F.pandas_udf("gap double, code int")
    def near(batch: pd.Series) -> pd.DataFrame:
        gap, code = np.zeros(len(batch)), np.zeros(len(batch), np.int32)
        for lo in range(0, len(batch), 1024):
            x = np.stack(batch.iloc[lo : lo + 1024].to_list())
            d = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
            gap[lo : lo + 1024], code[lo : lo + 1024] = d.min(1), d.argmin(1)
        return pd.DataFrame({"gap": gap, "code": code})

    return near(vectors)


def _reduce(points: np.ndarray, weight: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """``size`` centroids of the weighted candidates: drawn far from each other, then averaged."""
    first = rng.choice(len(points), p=weight / weight.sum())
    chosen, gap = [first], ((points - points[first]) ** 2).sum(1)
    for _ in range(size - 1):
        far = weight * gap
        far = far if far.sum() > 0 else weight * ~np.isin(np.arange(len(points)), chosen)
        chosen.append(rng.choice(len(points), p=far / far.sum()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    centre = points[chosen]
    for _ in range(10):
        near = np.stack([((points - c) ** 2).sum(1) for c in centre], 1).argmin(1)
        mass = np.bincount(near, weight, size)
        sums = np.stack([np.bincount(near, weight * points[:, j], size) for j in range(points.shape[1])], 1)
        centre = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centre)
    return centre


def seed_centroids(rows: DataFrame, size: int, *, seed: int = 0, rounds: int = ROUNDS, per_centroid: float = PER_CENTROID, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> np.ndarray:
    """``size`` starting centroids of the vectors ``v`` of all rows.

    Each round draws every distinct vector by its share (how often it occurs times its squared distance to
    the candidates so far) of the sum over all rows, times ``size * per_centroid``; draws are hashes, so a
    task that runs again draws the same. Only the candidates, about ``rounds * size * per_centroid`` vectors
    whatever the number of rows, come to the driver, where they are weighted by the rows nearest to them
    and reduced. ``cut`` writes the distances of a round. Raises where fewer distinct vectors than ``size`` are there."""
    points = cut(rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    if points.limit(size).count() < size:
        raise ValueError(f"{points.count()} distinct rows are fewer than {size} centroids")
    mark = F.xxhash64(F.lit(seed), "v")
    centres = np.array([points.orderBy(mark, "v").select("v").first()[0]], float)
    held = cut(points.withColumn("gap", _nearest(F.col("v"), centres)["gap"]))
    every = [centres]
    for k in range(rounds):
        total = held.agg(F.sum(F.col("n") * F.col("gap"))).first()[0]
        if not total:
            break
        share = F.col("n") * F.col("gap") / total * (size * per_centroid)
        drawn = held.where(hash_uniform(F.xxhash64(F.lit(k), mark), seed=seed) < share).select("v").collect()
        if not drawn:
            continue
        new = np.array([r.v for r in drawn], float)
        every.append(new)
        held = cut(held.withColumn("gap", F.least("gap", _nearest(F.col("v"), new)["gap"])))
    candidates = np.concatenate(every)
    if len(candidates) < size:  # few rows, or many equal ones: the farthest that are left
        rest = held.where("gap > 0").orderBy(F.desc("gap"), "v").select("v").limit(size - len(candidates)).collect()
        candidates = np.concatenate([candidates, np.array([r.v for r in rest], float)]) if rest else candidates
    mass = points.select("n", _nearest(F.col("v"), candidates)["code"].alias("code")).groupBy("code").agg(F.sum("n").alias("n")).collect()
    weight = np.zeros(len(candidates))
    for r in mass:  # one row for each candidate
        weight[r.code] = r.n
    return _reduce(candidates, np.maximum(weight, 1e-9), size, np.random.default_rng(seed))
