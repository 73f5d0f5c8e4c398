"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of 1 to 4 characters of the lower-cased text (runs of non-letters are one space)
are hashed; the model is trained by follow-the-regularised-leader with elastic-net
penalties, which leaves most weights exactly zero, and calibrated by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_with, release_memory, text_groups
from .sampling import excerpt, first_by_hash, sample_by_class

ORDERS = (1, 2, 3, 4)
BITS = 15
SCALE = 20.0
#: Bound of the rows a fit reads, and of one such text's characters.
FIT_ROWS, FIT_CHARS = 4000, 20_000
UNKNOWN = "und"
#: Stands before each text, so that no n-gram reaches into the text before; never counted.
BETWEEN = "\ue000" * (max(ORDERS) - 1)
#: Characters scored at a time; longer batches and texts are scored in pieces.
PIECE = 1 << 19


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    weights: np.ndarray  # (features, languages), inverse document frequency included
    bias: np.ndarray
    temperature: float


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each behind ``BETWEEN`` and between spaces, runs of other
    non-letters as one space; and where each text starts, with one more entry at the end."""
    low = [f"{BETWEEN} {t.lower() if isinstance(t, str) else ''} " for t in texts]
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c] | (c == ord(BETWEEN[0])), c, np.uint32(32))
    starts = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=starts[1:])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    at = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], at[starts]


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Feature of the n-gram that ends at each position (positions before the first are 0)."""
    h = np.full(len(codes), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h[n - 1 :] = (h[n - 1 :] ^ codes[n - 1 - k : len(codes) - k]) * np.uint32(0x85EBCA6B)
        h[n - 1 :] ^= h[n - 1 :] >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.int64) + ((n - 1) << BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of one text and their share of all its n-grams."""
    codes, _ = _codes([text])
    ids = np.concatenate([_grams(codes, n)[len(BETWEEN) :] for n in ORDERS])
    f, count = np.unique(ids, return_counts=True)
    return f.astype(np.int32), count / max(1, len(ids))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_language(texts: list[str], langs: list[str], *, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> LanguageModel:
    """FTRL-proximal over the rows in order; every fourth row is set aside for the temperature."""
    names = tuple(sorted(set(langs)))
    size, y = len(ORDERS) << BITS, np.array([names.index(x) for x in langs])
    rows = [features(t) for t in texts]
    seen = np.zeros(size)
    for f, _ in rows:
        seen[f] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    idf[seen == 0] = 0
    z, n, bias = np.zeros((size, len(names))), np.zeros((size, len(names))), np.zeros(len(names))

    def weight(f):
        zf, nf = z[f], n[f]
        w = -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2)
        return np.where(np.abs(zf) <= l1, 0.0, w)

    aside = np.arange(len(rows)) % 4 == 3 if len(rows) >= 16 else np.zeros(len(rows), bool)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(np.flatnonzero(~aside)):
            f, tf = rows[i]
            x, w = (tf * idf[f] * SCALE)[:, None], weight(f)
            p = _softmax((x * w).sum(0) + bias)
            p[y[i]] -= 1
            g = x * p
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
            bias -= 0.02 * p
    w = weight(np.arange(size)) * (idf * SCALE)[:, None]
    hold = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
    logits = np.array([(rows[i][1][:, None] * w[rows[i][0]]).sum(0) + bias for i in hold])
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(hold)), y[hold]], 1e-12)).mean() for t in grid]
    return LanguageModel(names, w.astype(np.float32), bias, float(grid[int(np.argmin(loss))]))


def train_language(docs: DataFrame, *, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, train_rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on at most about ``fit_rows`` rows with a language, evenly by language, texts of any length
    (of those longer than ``fit_chars`` as many characters, spread over the whole); None without any."""
    rows = docs if train_rows is None else docs.where(train_rows)
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND id IS NOT NULL")
    rows = rows.where(F.length("text") > 0).withColumn("text", excerpt(F.col("text"), fit_chars))
    pdf = first_by_hash(sample_by_class(rows, "id", "lang", fit_rows), 2 * fit_rows, "id", "lang", "text").toPandas().sort_values(["id", "text"], ignore_index=True)
    model = fit_language(list(pdf["text"]), list(pdf["lang"])) if len(pdf) else None
    del pdf
    release_memory()
    return model


def logits(texts, model: LanguageModel) -> np.ndarray:
    """Class logits of every text, one pass over the characters of all of them."""
    return np.concatenate([_group_logits(g, model) for g in text_groups(texts, PIECE)])


def _group_logits(texts, model: LanguageModel) -> np.ndarray:
    codes, starts = _codes(texts)
    sums = np.zeros((len(starts) - 1, len(model.langs)))
    for lo in range(0, len(codes), PIECE):
        hi = min(lo + PIECE, len(codes))
        back = min(lo, max(ORDERS) - 1)
        piece = codes[lo - back : hi]
        value = np.zeros((hi - lo, len(model.langs)), np.float32)
        for n in ORDERS:
            value += model.weights[_grams(piece, n)[back:]]
        value[codes[lo:hi] == ord(BETWEEN[0])] = 0
        first, last = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
        cut = np.maximum(starts[first:last], lo) - lo
        docs = np.arange(first, last)
        full = np.diff(np.append(cut, hi - lo)) > 0
        if full.any():
            sums[docs[full]] += np.add.reduceat(value, cut[full], axis=0, dtype=np.float64)
    total = np.maximum((np.diff(starts) - len(BETWEEN)) * len(ORDERS), 1)
    return sums / total[:, None] + model.bias


def predict_language(docs: DataFrame, model: LanguageModel | None, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (its calibrated probability).

    Null texts and texts without a letter are ``und`` with score 0, as is every text where
    nothing could be learned; equal texts are predicted alike; an empty table stays empty;
    existing columns of the two names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, p double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            known = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in texts], bool)
            lang, p = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if m is not None and known.any():
                q = _softmax(logits(list(texts[known]), m) / m.temperature)
                lang[known], p[known] = np.array(m.langs, object)[q.argmax(1)], q.max(1)
            yield pd.DataFrame({"lang": lang, "p": p})

    kept = docs.select(*columns_with(docs, "lang_pred", "score"))
    out = kept.withColumn("_pred", predict(F.col(text_col).cast("string")))
    return out.withColumn("lang_pred", F.col("_pred.lang")).withColumn("score", F.col("_pred.p")).drop("_pred")


def keep_identified(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least ``threshold``, with their own columns.

    Null texts and texts without a letter go; where no row has a language there is nothing to
    know, and all others stay. Repeated rows share their fate; an empty table stays empty."""
    own, model = {"lang_pred": "_lang_pred", "score": "_score"}, train_language(docs)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike("\\p{L}"))
    pred = predict_language(docs.withColumnsRenamed(own), model)
    return pred.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= threshold)).drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
