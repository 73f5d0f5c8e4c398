"""Toxicity by a bidirectional gated recurrent network over overlapping word windows.

Every word enters as two learned vectors: one by its hashed spelling (word input), one as
the mean over hashed character n-grams (character input). A small GRU reads each window
of ``WINDOW`` words in both directions, attention pools its states, and a logistic unit
scores the window. All windows of a text, half a window apart, are scored; a text is as
toxic as its worst window. Training is in numpy: labels are known only by text, so every
step learns from a text's highest-scoring window (multiple-instance learning).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_with, lower_bytes, mix64, text_groups
from .sampling import labelled_texts

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 8
WORD_BITS, CHAR_BITS = 14, 16
CHAR_ORDERS = (3, 5)
#: Bytes of a word that its character input reads; a longer word is cut into such words.
MAX_WORD = 24
#: Bound of the labelled rows a fit reads, and of one such text's characters.
FIT_ROWS, FIT_CHARS = 3000, 20_000
#: Least training steps of a round, by smaller batches where there are few rows.
LEAST_STEPS = 40
#: Weight decay of a training step, per unit of its rate.
DECAY = 0.05
#: Characters of texts scored together, and windows at once.
GROUP_CHARS = 1 << 22
BLOCK = 4096


@dataclass
class ToxicityModel:
    params: dict[str, np.ndarray]
    slope: float = 1.0
    bias: float = 0.0
    prior: float = 0.5


def words_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as rows of MAX_WORD letters' bytes, the word at each place, and the
    place at which each text starts (one more entry at the end). A word is a run of bytes
    other than ASCII white space, punctuation and digits."""
    data, starts = lower_bytes(texts)
    solid = ((data >= 97) & (data <= 122)) | (data >= 128)
    if len(data):
        solid[starts[1:] - 1] = False
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(first) and (stop - first).max() > MAX_WORD:
        parts = -(-(stop - first) // MAX_WORD)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, stop = np.repeat(first, parts) + k * MAX_WORD, np.repeat(stop, parts)
        stop = np.minimum(stop, first + MAX_WORD)
    at = np.searchsorted(first, starts)
    size = stop - first
    padded = np.concatenate([data, np.zeros(MAX_WORD, np.uint8)])
    key = np.zeros(len(first), np.uint64)
    lanes = np.lib.stride_tricks.sliding_window_view(padded, MAX_WORD)
    rows = lanes[first] * (np.arange(MAX_WORD) < size[:, None]).astype(np.uint8) if len(first) else np.zeros((0, MAX_WORD), np.uint8)
    for part in np.ascontiguousarray(rows).view(np.uint64).reshape(len(first), MAX_WORD // 8).T:
        key = mix64(key ^ part)
    _, index, place = np.unique(key, return_index=True, return_inverse=True)
    return rows[index], place.reshape(-1), at


def word_ids(rows: np.ndarray) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for part in np.ascontiguousarray(rows).view(np.uint64).reshape(len(rows), MAX_WORD // 8).T:
        key = mix64(key ^ part)
    return (key >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def char_ids(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of words (with a mark before and after) and the word of each."""
    size = (rows != 0).sum(1) + 2
    stop = np.cumsum(size)
    flat = np.ones(int(stop[-1]) if len(stop) else 0, np.uint32)
    flat[stop - 1] = 2
    inner = np.ones(len(flat), bool)
    inner[stop - 1] = inner[stop - size] = False
    flat[inner] = rows[rows != 0]
    of, left = np.repeat(np.arange(len(rows)), size), np.repeat(stop, size) - np.arange(len(flat))
    ids, word = [], []
    for n in CHAR_ORDERS:
        h = np.full(max(0, len(flat) + 1 - n), n, np.uint32)
        for k in range(n):
            h = (h ^ flat[k : k + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        fits = left[: len(h)] >= n
        ids.append((h[fits] >> np.uint32(32 - CHAR_BITS)).astype(np.int64))
        word.append(of[: len(h)][fits])
    return np.concatenate(ids), np.concatenate(word)


def _inputs(rows: np.ndarray, p: dict[str, np.ndarray], drop: np.random.Generator | None = None) -> tuple[np.ndarray, tuple]:
    """Input vectors of distinct words, and what their gradient needs. With ``drop`` (training)
    half of the n-grams are left out at random and half of the words lose their word input,
    so that spelling patterns rather than single words are learned."""
    ids, (grams, word) = word_ids(rows), char_ids(rows)
    if drop is not None:
        kept = drop.random(len(grams)) < 0.5
        grams, word = grams[kept], word[kept]
    count = np.maximum(np.bincount(word, minlength=len(rows)), 1).astype(np.float32)
    chars = np.column_stack([np.bincount(word, p["char"][:, j][grams], len(rows)) for j in range(CHAR_DIM)]) / np.sqrt(count)[:, None]
    own = p["word"][ids]
    if drop is not None:
        own = own * (drop.random(len(rows)) < 0.5)[:, None]
    return np.concatenate([own, chars], 1).astype(np.float32), (ids, grams, word, count)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _gru(proj: np.ndarray, place: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States of one direction, (windows, WINDOW, HIDDEN). ``proj``: the words' projected
    inputs, with a last row for padding; masked places leave the state as it is."""
    n, steps = place.shape
    h, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x = proj[place[:, t]]
        zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        rh = r * h
        c = np.tanh(x[:, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
        z = z * mask[:, t : t + 1]
        if keep is not None:
            keep.append((t, h, z, r, rh, c))
        h = h + z * (c - h)
        out[:, t] = h
    return out


def _gru_back(grad: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs (windows, WINDOW, 3 * HIDDEN) and of ``u``."""
    n, steps = mask.shape
    dx, du, dh = np.zeros((n, steps, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t, h, z, r, rh, c in reversed(kept):
        dh = dh + grad[:, t]
        m = mask[:, t : t + 1]
        dc = dh * z * (1 - c * c)
        raw = np.where(m > 0, z, 0)
        dz = dh * (c - h) * raw * (1 - raw)
        drh = dc @ u[:, 2 * HIDDEN :].T
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], 1)
        dx[:, t] = np.concatenate([dzr, dc], 1)
        du[:, : 2 * HIDDEN] += h.T @ dzr
        du[:, 2 * HIDDEN :] += rh.T @ dc
        dh = dh * (1 - z) + drh * r + dzr @ u[:, : 2 * HIDDEN].T
    return dx, du


def windows_of(place: np.ndarray, at: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as word places (padded with ``pad``), and the text of each:
    starts are STRIDE apart until a window reaches the end; texts without words have none."""
    count = np.diff(at)
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(count)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = (at[:-1][doc] + k * STRIDE)[:, None] + np.arange(WINDOW)
    inside = pos < at[1:][doc][:, None]
    return np.where(inside, place[np.minimum(pos, max(0, len(place) - 1))] if len(place) else pad, pad), doc


def _forward(x: np.ndarray, win: np.ndarray, p: dict[str, np.ndarray], keep: bool = False):
    """Scores of windows (logits). ``x``: input vectors of the distinct words."""
    mask = (win < len(x)).astype(np.float32)
    proj = [np.concatenate([x @ p["w" + d] + p["b" + d], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"]
    kept = ([], []) if keep else (None, None)
    h = np.concatenate([_gru(proj[i], win, mask, p["u" + d], d == "b", kept[i]) for i, d in enumerate("fb")], 2)
    e = np.tanh(h @ p["att"]) @ p["attv"]
    e = np.where(mask > 0, e, np.float32(-1e9))
    a = np.exp(e - e.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    pooled = (a[:, :, None] * h).sum(1)
    score = pooled @ p["out"] + p["outb"][0]
    return score, (mask, kept, h, a, pooled)


def _backward(dscore: np.ndarray, x: np.ndarray, win: np.ndarray, p: dict[str, np.ndarray], state, words) -> dict[str, np.ndarray]:
    mask, kept, h, a, pooled = state
    g = {"out": pooled.T @ dscore, "outb": np.array([dscore.sum()], np.float32)}
    dpool = dscore[:, None] * p["out"]
    da = (dpool[:, None, :] * h).sum(2)
    de = a * (da - (a * da).sum(1, keepdims=True))
    th = np.tanh(h @ p["att"])
    g["attv"] = np.einsum("nta,nt->a", th, de)
    dth = de[:, :, None] * p["attv"] * (1 - th * th)
    g["att"] = np.einsum("nth,nta->ha", h, dth)
    dh = a[:, :, None] * dpool[:, None, :] + dth @ p["att"].T
    dx, flat = np.zeros_like(x), win.reshape(-1)
    real = flat < len(x)
    for i, d in enumerate("fb"):
        dproj, g["u" + d] = _gru_back(dh[:, :, i * HIDDEN : (i + 1) * HIDDEN], mask, p["u" + d], kept[i])
        dproj = dproj.reshape(-1, 3 * HIDDEN)[real]
        per_word = np.column_stack([np.bincount(flat[real], dproj[:, j], len(x)) for j in range(3 * HIDDEN)]).astype(np.float32)
        g["w" + d], g["b" + d] = x.T @ per_word, per_word.sum(0)
        dx += per_word @ p["w" + d].T
    ids, grams, word, count = words
    dchar = (dx[:, WORD_DIM:] / np.sqrt(count)[:, None])[word]
    g["word"] = np.column_stack([np.bincount(ids, dx[:, j], 1 << WORD_BITS) for j in range(WORD_DIM)]).astype(np.float32)
    g["char"] = np.column_stack([np.bincount(grams, dchar[:, j], 1 << CHAR_BITS) for j in range(CHAR_DIM)]).astype(np.float32)
    return g


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    n, d = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"word": rng.normal(0, 0.05, (1 << WORD_BITS, WORD_DIM)), "char": rng.normal(0, 0.3, (1 << CHAR_BITS, CHAR_DIM)), "att": rng.normal(0, 0.3, (2 * d, d)), "attv": rng.normal(0, 0.3, d), "out": rng.normal(0, 0.3, 2 * d), "outb": np.zeros(1)}
    for k in "fb":
        p |= {"w" + k: rng.normal(0, n**-0.5, (n, 3 * d)), "u" + k: rng.normal(0, d**-0.5, (d, 3 * d)), "b" + k: np.zeros(3 * d)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def text_logits(texts, p: dict[str, np.ndarray]) -> np.ndarray:
    """The highest window logit of every text; NaN for texts without words."""
    rows, place, at = words_of(texts)
    out = np.full(len(at) - 1, -np.inf)
    if len(rows):
        x, (win, doc) = _inputs(rows, p)[0], windows_of(place, at, len(rows))
        for k in range(0, len(win), BLOCK):
            np.maximum.at(out, doc[k : k + BLOCK], _forward(x, win[k : k + BLOCK], p)[0])
    return np.where(np.isinf(out), np.nan, out)


def _calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic fit, kept near slope 1 by a ridge;
    Newton steps are halved until they help. The slope stays positive: it must not turn the order."""
    a, w = np.column_stack([z, np.ones_like(z)]), np.array([1.0, 0.0])

    def loss(w):
        x = a @ w
        return (np.logaddexp(0, x) - y * x).sum() + 0.5 * ((w[0] - 1) ** 2 + 0.05 * w[1] ** 2)

    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (q - y) + np.array([w[0] - 1, 0.05 * w[1]])
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + np.diag([1, 0.05]), slope)
        while loss(w - step) > loss(w) and abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.05), float(w[1])


def fit_toxicity(sample: pd.DataFrame, *, rounds: int = 9, batch: int = 128, rate: float = 0.01, seed: int = 0) -> ToxicityModel:
    """Fit on rows (text, label 1 toxic / 0 not); a quarter is set aside for the calibration.
    Without rows of both labels every score is the labels' mean."""
    y = sample["label"].to_numpy(float)
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    rng = np.random.default_rng(seed)
    p = _start(rng)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(p, 0.0, float(np.log(prior / (1 - prior))), prior)
    aside = sample.groupby("label").cumcount().to_numpy() % 4 == 3
    rows, place, at = words_of(list(sample["text"]))
    win, doc = windows_of(place, at, len(rows))
    keep = ~aside[doc]
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for r in range(rounds):
        x = _inputs(rows, p)[0]
        score = np.concatenate([_forward(x, win[k : k + BLOCK], p)[0] for k in range(0, len(win), BLOCK)])
        if r == 0:
            score = -np.arange(len(win)) * 1e-9 - (np.bincount(doc, minlength=len(y))[doc] > 6)  # short texts first: their label says most of each window
        order = np.lexsort((-score, doc))
        top = order[np.concatenate([[True], np.diff(doc[order]) > 0])]
        top = top[keep[top]]
        if r == 0:
            top = np.flatnonzero(keep & (np.bincount(doc, minlength=len(y))[doc] <= 6))
            top = top if len(top) else np.flatnonzero(keep)
        else:
            clean = np.flatnonzero(keep & (y[doc] == 0))
            top = np.concatenate([top, rng.choice(clean, min(len(clean), 2 * len(top)), replace=False)]) if len(clean) else top
        for pick in np.array_split(rng.permutation(top), max(1, len(top) // batch, min(LEAST_STEPS, len(top) // 8))):
            used, local = np.unique(win[pick], return_inverse=True)
            local = local.reshape(len(pick), WINDOW)
            real = used[used < len(rows)]
            local = np.where(win[pick] < len(rows), local, len(real))
            xs, words = _inputs(rows[real], p, rng)
            s, state = _forward(xs, local, p, keep=True)
            d = ((_sigmoid(s) - y[doc[pick]]) * balance[doc[pick]] / len(pick)).astype(np.float32)
            g, step = _backward(d, xs, local, p, state, words), step + 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                now = rate * (0.2 if r >= rounds - 3 else 1)
                p[k] -= now / (1 - 0.9**step) * m[k] / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6) + now * DECAY * p[k]
    model = ToxicityModel(p, prior=prior)
    z = text_logits(list(sample["text"][aside]), p)
    yz = y[aside][~np.isnan(z)]
    z = z[~np.isnan(z)]
    if len(set(yz)) == 2:
        model.slope, model.bias = _calibration(z, yz)
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, train_rows: Column | None = None, label_col: str = "toxic") -> ToxicityModel:
    """Fit from labelled documents (at most about ``fit_rows``); ``train_rows`` filters labels."""
    keep = labels if train_rows is None else labels.where(train_rows)
    return fit_toxicity(labelled_texts(docs, keep, label_col, fit_rows, fit_chars))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``score`` (probability of toxic) and ``predicted``.

    Null texts and texts without a letter score 0; equal texts score alike; an empty table
    stays empty; existing columns of the two names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            out = []
            for group in text_groups(texts, GROUP_CHARS):
                z = text_logits(group, m.params)
                out.append(np.where(np.isnan(z), 0.0, 1 / (1 + np.exp(-np.clip(m.slope * np.nan_to_num(z) + m.bias, -30, 30)))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    kept = docs.select(*columns_with(docs, "score", "predicted"))
    return kept.withColumn("score", score(F.col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
