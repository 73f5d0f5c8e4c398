"""Quality by compression: a text is good when a dictionary of good text packs it better.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. Every
text is compressed with both, chunk by chunk over its whole length so that a long text
cannot teach the compressor its own style; the difference of the compressed sizes per
byte becomes a probability by a logistic calibration on labelled texts set aside. The
calibration also sees the mean compressed size per byte, since the same difference means
something else in a text that repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_with
from .sampling import labelled_texts

CHUNK_BYTES = 1024
DICT_BYTES = 64 << 10
LEVEL = 1
#: Bound of the labelled rows a fit reads, and of one such text's characters.
FIT_ROWS, FIT_CHARS = 6000, 20_000


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


def _chunks(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[k : k + CHUNK_BYTES] for k in range(0, len(raw), CHUNK_BYTES)]


def _compressor(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if d is not None:
        d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def sizes(texts, good: bytes, bad: bytes) -> np.ndarray:
    """Compressed bytes per byte of each text with the good and with the bad dictionary; NaN for empty texts."""
    with_good, with_bad, out = _compressor(good), _compressor(bad), np.full((len(texts), 2), np.nan)
    for k, text in enumerate(texts):
        if text:
            chunks = _chunks(text)
            total = sum(map(len, chunks))
            out[k] = sum(len(with_good(c)) for c in chunks) / total, sum(len(with_bad(c)) for c in chunks) / total
    return out


def _features(per_byte: np.ndarray) -> np.ndarray:
    """The normalised difference, and with it the text's compressibility."""
    d, r = per_byte[:, 1] - per_byte[:, 0], per_byte.mean(1)
    return np.column_stack([d, r, r * r, d * r, np.ones_like(d)])


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; where the samples are too few to train one, their raw bytes."""
    import zstandard

    samples = [c for t in texts for c in _chunks(t)]
    total = sum(map(len, samples))
    size = min(DICT_BYTES, max(256, total // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _own_lines(texts: list[str]) -> list[str]:
    """Distinct lines in order: a line that many texts share says nothing of their quality."""
    return list(dict.fromkeys(line for t in texts for line in t.split("\n")))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit (Newton, small ridge on standardised columns); the last column is constant."""
    m, s = x.mean(0), x.std(0)
    m[-1], s[s == 0] = 0, 1
    z, w = (x - m) / s, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    w = w / s
    w[-1] -= m[:-1] @ w[:-1]
    return w


def _probability(per_byte: np.ndarray, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(per_byte) @ np.array(weights), -30, 30)))


def fit_quality(sample: pd.DataFrame) -> QualityModel:
    """Fit on rows (text, label 1 good / 0 bad): two of three texts build the dictionaries,
    the third calibrates. Without rows of both labels every score is the labels' mean."""
    y = sample["label"].to_numpy(float)
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    if not len(y) or y.min() == y.max():
        return QualityModel(b"", b"", (), prior)
    turn = sample.groupby("label").cumcount().to_numpy() % 3
    texts = sample["text"].to_numpy()
    good, bad = _own_lines(list(texts[(y == 1) & (turn < 2)])), _own_lines(list(texts[(y == 0) & (turn < 2)]))
    both = set(good) & set(bad)
    good, bad = (_dictionary(["\n".join(x for x in lines if x not in both)]) for lines in (good, bad))
    rest = turn == 2 if len(set(y[turn == 2])) == 2 else np.ones(len(y), bool)
    weights = _logistic(_features(sizes(texts[rest], good, bad)), y[rest])
    return QualityModel(good, bad, tuple(map(float, weights)), prior)


def train_quality(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, train_rows: Column | None = None, label_col: str = "quality") -> QualityModel:
    """Fit from labelled documents (at most about ``fit_rows``); ``train_rows`` filters labels."""
    keep = labels if train_rows is None else labels.where(train_rows)
    return fit_quality(labelled_texts(docs, keep, label_col, fit_rows, fit_chars))


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``score`` (probability of good) and ``predicted``.

    Empty or null texts score the labels' mean; equal texts score alike; an empty table
    stays empty; existing columns of the two names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            if not m.good:
                yield pd.Series(np.full(len(texts), m.prior))
                continue
            per_byte = sizes(list(texts), m.good, m.bad)
            yield pd.Series(np.where(np.isnan(per_byte[:, 0]), m.prior, _probability(per_byte, m.weights)))

    kept = docs.select(*columns_with(docs, "score", "predicted"))
    return kept.withColumn("score", score(F.col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least ``threshold``, with their own columns."""
    scored = score_quality(docs.withColumnsRenamed({"score": "_score", "predicted": "_predicted"}), train_quality(docs, labels))
    return scored.where(F.col("score") >= threshold).drop("score", "predicted").withColumnsRenamed({"_score": "score", "_predicted": "predicted"}).select(*docs.columns)
