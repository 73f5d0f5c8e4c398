"""Hard negatives by one-dimensional distance keys.

Every vector x of the table gets one more component, sqrt(M² - |x|²) for the largest norm M, and a query
q gets a zero: then |q' - x'|² = |q|² + M² - 2 q·x, so the largest inner products are the nearest points.
Points are stored sorted by (nearest pivot, distance to it) in blocks, blocks in shards of even size. A
query at distance D from a pivot can meet a point at distance r from it only at |D - r| or more, so a
block's key interval bounds the scores in it. A search begins with the shard of the best bound and
widens in rounds over shards, and over blocks inside a shard, until no interval left can hold a score
as good as the last one kept: results are exact, the pivots only decide how much is read.

A shard's rows and the queries it is to answer meet in one partition, the rows first: a task holds one
shard and one batch of queries, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

#: Pivots, the rows (chosen by hash) that they are fitted on, and the steps of the fit.
PIVOTS, SAMPLE_ROWS, FIT_STEPS = 64, 4096, 8
#: Rows of a block and of a shard; queries scanned together.
BLOCK_ROWS, SHARD_ROWS, ASK_BATCH = 1024, 16_384, 128
#: Shards that a query has been sent to after each round; the last round sends it to all that may still matter.
WIDEN = (1, 8)
#: Share of M² by which bounds are loosened against rounding.
SLACK = 1e-9


def _pack(scale: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vec, dim, sq = [], [], []
            for v in pdf["v"]:
                q = np.floor(scale * np.asarray(v, np.float64))
                if (q * q).sum() >= 2.0**62:
                    raise ValueError("components are too large: inner products must fit 64-bit integers")
                q = q.astype(np.int64)
                vec.append(q.astype("<i2" if len(q) and np.abs(q).max() < 1 << 15 else "<i8").tobytes())
                dim.append(len(q))
                sq.append(int((q * q).sum()))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "dim": np.array(dim, np.int32), "sq": np.array(sq, np.int64), "vec": vec})

    return run


def integer_vectors(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", scale: float = 256.0) -> DataFrame:
    """(vec_id, label, dim, sq, vec): the usable rows with components floor(scale * x), packed. Rows with a
    null id, label or vector or a null or non-finite component are left out; other columns are dropped."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col(label) if isinstance(label, str) else label
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    picked = picked.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    return picked.mapInPandas(_pack(scale), "vec_id long, label long, dim int, sq long, vec binary")


def _vectors(vec, dim: int) -> np.ndarray:
    """Packed vectors of one length as rows of integers."""
    vec = list(vec)
    if not dim:
        return np.zeros((len(vec), 0), np.int64)
    short = np.fromiter((len(v) == 2 * dim for v in vec), bool, len(vec))
    out = np.empty((len(vec), dim), np.int64)
    out[short] = np.frombuffer(b"".join(v for v, s in zip(vec, short) if s), "<i2").reshape(-1, dim)
    out[~short] = np.frombuffer(b"".join(v for v, s in zip(vec, short) if not s), "<i8").reshape(-1, dim)
    return out


def fit_pivots(vectors: np.ndarray, m2: float, pivots: int = PIVOTS, steps: int = FIT_STEPS) -> np.ndarray:
    """Centres of the augmented sample: farthest points first, then a few averaging steps."""
    x = _augmented(vectors, m2)
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    gap = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    centre = x[chosen]
    for _ in range(steps):
        near = _distances(x, centre).argmin(1)
        held = np.bincount(near, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centre)
    return centre


def _augmented(vectors: np.ndarray, m2: float) -> np.ndarray:
    x = vectors.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))[:, None]], 1)


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centre * centre).sum(1) - 2 * x @ centre.T, 0))


def _assign(pivots: dict[int, np.ndarray], m2: float):
    """mapInPandas body: adds the nearest pivot and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pivot, dist = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for dim, at in pdf.groupby("dim").indices.items():
                gap = _distances(_augmented(_vectors(pdf["vec"].iloc[at], dim), m2), pivots.get(dim, np.zeros((1, dim + 1))))
                pivot[at], dist[at] = gap.argmin(1), gap.min(1)
            yield pdf.assign(pivot=pivot, dist=dist)

    return run


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas body over one shard's rows in key order: runs of up to ``BLOCK_ROWS`` rows of one pivot."""
    held = None
    names = ["shard", "dim", "pivot", "low", "high", "rows", "ids", "labels", "vecs"]

    def packed(part: pd.DataFrame):
        part = part.sort_values(["vec_id", "label"], kind="stable")  # equal scores are told apart by place
        x = _vectors(part["vec"], int(part["dim"].iloc[0]))
        wide = "<i2" if x.size and np.abs(x).max() < 1 << 15 else "<i8"
        first = part.iloc[0]
        return (first["shard"], first["dim"], first["pivot"], part["dist"].min(), part["dist"].max(), len(part), part["vec_id"].to_numpy("<i8").tobytes(), part["label"].to_numpy("<i8").tobytes(), x.astype(wide).tobytes())

    for pdf in batches:
        held, out = pdf if held is None else pd.concat([held, pdf], ignore_index=True), []
        cut = np.flatnonzero((held[["shard", "dim", "pivot"]].diff().iloc[1:] != 0).any(axis=1)) + 1
        runs = np.concatenate([[0], cut, [len(held)]])
        for lo, hi in zip(runs[:-1], runs[1:]):
            stop = hi if hi < len(held) else lo + (hi - lo) // BLOCK_ROWS * BLOCK_ROWS
            out += [packed(held.iloc[k : min(k + BLOCK_ROWS, stop)]) for k in range(lo, stop, BLOCK_ROWS)]
            rest = stop
        held = held.iloc[rest:] if len(held) else None
        if out:
            yield pd.DataFrame(out, columns=names)
    if held is not None and len(held):
        yield pd.DataFrame([packed(held.iloc[k : k + BLOCK_ROWS]) for k in range(0, len(held), BLOCK_ROWS)], columns=names)


class DistanceIndex:
    """A written index: ``blocks`` (shard, dim, pivot, low, high, rows, ids, labels, vecs), the pivots by
    vector length, M² and the number of shards."""

    def __init__(self, blocks: DataFrame, pivots: dict[int, np.ndarray], m2: float, shards: int):
        self.blocks, self.pivots, self.m2, self.shards = blocks, pivots, m2, shards


def build_index(vectors: DataFrame, *, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> DistanceIndex:
    """Index every row of ``integer_vectors``; repeated rows count once. The pivots are fitted on
    ``sample_rows`` rows chosen by hash; a vector length without a sampled row gets the origin."""
    rows = materialize(vectors.dropDuplicates(["vec_id", "label", "dim", "vec"]))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max("sq").alias("m2")).first()
    m2, shards = float(whole["m2"] or 0), max(1, -(-whole["n"] // shard_rows))
    sample = rows.select("dim", "vec", F.xxhash64("vec_id", "vec").alias("h")).orderBy("h", "vec").limit(sample_rows).toPandas()
    fitted = {int(dim): fit_pivots(_vectors(part["vec"], int(dim)), m2, pivots) for dim, part in sample.groupby("dim")}
    keyed = rows.mapInPandas(_assign(fitted, m2), "vec_id long, label long, dim int, sq long, vec binary, pivot int, dist double")
    order = ["dim", "pivot", "dist", "vec_id", "label"]
    ranged = materialize(keyed.drop("sq")).repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id().cast("long"))
    blocks = ranged.mapInPandas(_blocks, "shard long, dim int, pivot int, low double, high double, rows int, ids binary, labels binary, vecs binary")
    return DistanceIndex(materialize(blocks), fitted, m2, shards)


def _pivot_distances(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [None] * len(pdf)
            for dim, at in pdf.groupby("dim").indices.items():
                q = _vectors(pdf["vec"].iloc[at], dim).astype(np.float64)
                gap = _distances(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots.get(dim, np.zeros((1, dim + 1))))
                for i, g in zip(at, gap):
                    out[i] = g
            yield pdf[["ask"]].assign(gaps=out)

    return run


def _top(scores: np.ndarray, valid: np.ndarray, k: int, m2: float) -> np.ndarray:
    """Places of each row's k best valid scores, equal scores by place; rows may be padded with invalid places."""
    k, n = min(k, scores.shape[1]), scores.shape[1]
    if m2 * n < 2.0**52:  # score and place fit one double exactly
        key = np.where(valid, scores * float(n) - np.arange(n), -np.inf)
        return np.argpartition(key, n - k, axis=1)[:, n - k :]
    order = np.argsort(np.where(valid, -scores.astype(np.int64), np.iinfo(np.int64).max), axis=1, kind="stable")
    return order[:, :k]


class _Shard:
    """One shard's blocks and the scan of a batch of queries over them."""

    def __init__(self, blocks: pd.DataFrame, pivots: dict[int, np.ndarray], m2: float):
        self.blocks, self.pivots, self.m2, exact = {}, pivots, m2, m2 < 2.0**53
        for b in blocks.itertuples():
            x = _vectors([b.vecs[i * (len(b.vecs) // b.rows) : (i + 1) * (len(b.vecs) // b.rows)] for i in range(b.rows)], b.dim)
            self.blocks.setdefault(b.dim, []).append((b.pivot, b.low, b.high, np.frombuffer(b.ids, "<i8"), np.frombuffer(b.labels, "<i8"), x.astype(np.float64) if exact else x))

    def scan(self, asks: pd.DataFrame, k: int, same: bool) -> Iterator[pd.DataFrame]:
        for dim, part in asks.groupby("dim"):
            if dim in self.blocks:
                for lo in range(0, len(part), ASK_BATCH):
                    yield self._scan(self.blocks[dim], part.iloc[lo : lo + ASK_BATCH], int(dim), k, same)

    def _scan(self, blocks, asks: pd.DataFrame, dim: int, k: int, same: bool) -> pd.DataFrame:
        q = _vectors(asks["vec"], dim).astype(blocks[0][5].dtype)
        own, label = asks["vec_id"].to_numpy(np.int64), asks["label"].to_numpy(np.int64)
        units = [(i, u["u"], u["low"], u["high"]) for i, us in enumerate(asks["units"]) for u in us]
        at, name, low, high = (np.array(c) for c in zip(*units))
        bound, top = low.copy(), high.astype(np.int64)
        best, ids = np.full((len(at), k), np.iinfo(np.int64).min), np.full((len(at), k), np.iinfo(np.int64).max)
        reach = (q.astype(np.float64) ** 2).sum(1) + self.m2
        gap = np.stack(list(asks["gaps"]))
        pivot, near, far = (np.array([b[j] for b in blocks]) for j in range(3))
        least, most = np.maximum(np.maximum(gap[:, pivot] - far, near - gap[:, pivot]), 0), gap[:, pivot] + far
        over, under = (reach[:, None] - least**2) / 2 + SLACK * (1 + reach[:, None]), (reach[:, None] - most**2) / 2 - SLACK * (1 + reach[:, None])
        for b in np.argsort(-over.max(0), kind="stable"):
            use = np.flatnonzero((over[at, b] >= bound) & (under[at, b] <= top))
            if not len(use):
                continue
            _, _, _, vec_id, of, x = blocks[b]
            some, back = np.unique(at[use], return_inverse=True)
            scores = (q[some] @ x.T)[back]
            match = of == label[at[use], None]
            valid = (match if same else ~match) & (vec_id != own[at[use], None]) & (scores >= bound[use, None]) & (scores <= top[use, None])
            hit = valid.any(1)
            use, scores, valid = use[hit], scores[hit], valid[hit]
            if not len(use):
                continue
            pick = _top(scores, valid, k, self.m2)
            good = np.take_along_axis(valid, pick, 1)
            new = np.where(good, np.take_along_axis(scores, pick, 1), np.iinfo(np.int64).min).astype(np.int64)
            new_ids = np.where(good, vec_id[pick], np.iinfo(np.int64).max)
            both, both_ids = np.concatenate([best[use], new], 1), np.concatenate([ids[use], new_ids], 1)
            order = np.lexsort((both_ids, ~both), axis=1)[:, :k]  # ~x sorts the largest first, without overflow
            best[use], ids[use] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
            bound[use] = np.maximum(bound[use], best[use, k - 1])
        has = best > np.iinfo(np.int64).min
        row, _ = np.nonzero(has)
        return pd.DataFrame({"ask": asks["ask"].to_numpy()[at[row]], "u": name[row].astype(np.int64), "score": best[has], "vec_id": ids[has]})


def _scan_partition(index_pivots: dict[int, np.ndarray], m2: float, k: int, same: bool):
    """mapInPandas body: rows sorted by shard, each shard's blocks before its queries."""
    block_cols = ["dim", "pivot", "low", "high", "rows", "ids", "labels", "vecs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, parts, shard = None, [], None
        for pdf in batches:
            for number, here in pdf.groupby("shard", sort=True):
                if number != current:
                    current, parts, shard = number, [], None
                stored, asks = here[here["turn"] == 0], here[here["turn"] > 0]
                if len(stored):
                    parts.append(stored[block_cols])
                if len(asks) and parts:
                    shard = shard or _Shard(pd.concat(parts), index_pivots, m2)
                    yield from shard.scan(asks, k, same)

    return run


def search(index: DistanceIndex, asks: DataFrame, *, k: int, same_label: bool) -> DataFrame:
    """(ask, u, score, vec_id, rank): for each unit of each ask its ``k`` best rows by inner product, ties to
    the smaller vec_id, among rows of another vec_id and the same (or another) label with low <= score <= high.

    ``asks``: ask (distinct), vec_id, label, dim, sq, vec, units (array of u, low, high)."""
    asks = materialize(asks.where(F.size("units") > 0))
    gaps = asks.select("ask", "dim", "vec").mapInPandas(_pivot_distances(index.pivots), "ask long, gaps array<double>")
    asks = materialize(asks.join(gaps, "ask"))
    d, reach = F.col("d"), F.col("sq") + F.lit(index.m2)
    least = F.greatest(d - F.col("high"), F.col("low") - d, F.lit(0.0))
    over, under = (reach - least * least) / 2 + SLACK * (1 + reach), (reach - (d + F.col("high")) * (d + F.col("high"))) / 2 - SLACK * (1 + reach)
    wanted = asks.select("ask", "dim", "sq", F.array_min("units.low").alias("least"), F.array_max("units.high").alias("most"), F.posexplode("gaps").alias("pivot", "d"))
    directory = index.blocks.select("shard", "dim", "pivot", "low", "high")
    met = wanted.join(directory, ["dim", "pivot"]).where((over >= F.col("least")) & (under <= F.col("most")))
    routes = met.groupBy("ask", "shard").agg(F.max(over).alias("over"))
    routes = materialize(routes.withColumn("turn", F.row_number().over(W.partitionBy("ask").orderBy(F.desc("over"), "shard"))))
    best = F.row_number().over(W.partitionBy("ask", "u").orderBy(F.desc("score"), "vec_id"))
    found, done = None, 0
    for upto in [*(w for w in WIDEN if w < index.shards), index.shards]:
        units, send = asks, routes.where((F.col("turn") > done) & (F.col("turn") <= upto))
        if found is not None:
            full = found.groupBy("ask", "u").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            full = full.where(F.col("kth").isNotNull()).groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("u", "kth"))).alias("kth"))
            kth = lambda u: F.coalesce(F.try_element_at("kth", u["u"]), u["low"])
            tight = F.transform("units", lambda u: F.struct(u["u"].alias("u"), F.greatest(u["low"], kth(u)).alias("low"), u["high"].alias("high")))
            units = asks.join(full, "ask", "left").withColumn("units", tight).drop("kth")
        send = send.join(units, "ask").where(F.col("over") >= F.array_min("units.low"))
        stored = index.blocks.join(send.select("shard").distinct(), "shard", "left_semi")
        # no nulls in integer columns: they would reach the task as doubles
        rows = stored.select("*", *(F.lit(0).cast("long").alias(c) for c in ("ask", "vec_id", "label")), F.lit(0).alias("turn"))
        sent = send.select("shard", "ask", "vec_id", "label", "dim", "vec", "units", "gaps", "turn", F.lit(0).alias("pivot"), F.lit(0).alias("rows"))
        rows = rows.unionByName(sent, allowMissingColumns=True)
        rows = rows.repartition(4 * index.shards, "shard").sortWithinPartitions("shard", "turn")
        more = rows.mapInPandas(_scan_partition(index.pivots, index.m2, k, same_label), "ask long, u long, score long, vec_id long")
        more = more if found is None else found.select("ask", "u", "score", "vec_id").unionAll(more)
        found, done = materialize(more.withColumn("rank", best).where(F.col("rank") <= k)), upto
    return found


def mine_hard_negatives(rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, label: Column | str = "label", id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row for which
    ``anchors`` (over vec_id) holds: its best ``positives`` rows of its label, and for each the best
    ``negatives`` rows of another label with low/100 to high/100 of the positive's score, by the integer
    inner product of floor(scale * x); ties go to the smaller vec_id.

    Unusable rows (``integer_vectors``) take no part; a zero vector does. Repeated rows count once; rows of
    the anchor's own vec_id are neither positives nor negatives; only vectors of one length are compared. A
    negative positive score leaves no negatives, a score of 0 those of score 0; empty tables give no rows."""
    vectors = materialize(integer_vectors(rows, id_col=id_col, vec_col=vec_col, label=label, scale=scale))
    index = build_index(vectors, shard_rows=shard_rows)
    asking = materialize(vectors.where(anchors).dropDuplicates(["vec_id", "label", "dim", "vec"]).withColumn("ask", F.xxhash64("vec_id", "label", "dim", "vec")))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("u"), F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high")))
    near = search(index, asking.withColumn("units", everything), k=positives, same_label=True).select("ask", F.col("rank").cast("long").alias("u"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    hundreds, rest, per = F.call_function("div", p, F.lit(100)), p % 100, lambda x: F.call_function("div", x, F.lit(100))  # in parts, against overflow
    unit = F.struct("u", (hundreds * low + per(rest * low + 99)).alias("low"), (hundreds * high + per(rest * high)).alias("high"))
    units = near.where(p >= 0).groupBy("ask").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    found = search(index, asking.join(units, "ask"), k=negatives, same_label=False).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    named = near.join(asking.select("ask", F.col("vec_id").alias("anchor_id")), "ask")
    return named.join(found, ["ask", "u"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
