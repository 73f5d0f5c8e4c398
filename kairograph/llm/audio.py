"""Chroma audio fingerprints of media columns, and alignment of recordings by them.

A recording is cut into overlapping frames; a frame's spectrum is folded into 12 pitch
classes, smoothed over time and normalised. Filters over rectangles of this image, read
from its integral image, are quantised to two bits each; 16 of them make the packed
integer of a place. Two recordings are aligned where most of their equal key bits agree on
one offset (a histogram of offsets), if few enough bits differ over the overlap there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATE, FRAME, HOP = 4000, 2048, 512
#: Lowest and highest frequency that counts, and the pitch of class 0.
LOW, HIGH, BASE = 55.0, 1760.0, 55.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Frames that a packed integer looks at.
SPAN = 16
#: Filters: kind (0 pitch halves, 1 time halves, 2 quadrants, 3 pitch thirds, 4 time thirds), first class, classes, frames.
FILTERS = (
    (0, 0, 12, 4), (0, 0, 6, 8), (0, 6, 6, 8), (0, 3, 6, 16), (1, 0, 12, 4), (1, 0, 4, 8), (1, 4, 4, 8), (1, 8, 4, 16),
    (2, 0, 12, 8), (2, 0, 6, 8), (2, 6, 6, 16), (3, 0, 12, 4), (3, 0, 6, 8), (3, 6, 6, 16), (4, 0, 12, 6), (4, 3, 6, 12),
)
#: A filter's value is a log ratio; these cut it into four classes, coded so that neighbours differ in one bit.
CUTS, GRAY = np.array([-0.25, 0.0, 0.25]), np.array([0, 1, 3, 2], np.uint32)
#: Key bits of a packed integer; least equal keys and overlapping places; most differing bits.
KEY_BITS, MIN_VOTES, MIN_OVERLAP, MAX_ERROR = 20, 3, 16, 0.15
#: Packed integer of silence, all filters being even: it tells nothing, so it neither votes nor counts in an overlap.
SILENT = np.uint32(0xFFFFFFFF)
#: Frames transformed at once; recordings of a shard, a 64th of all within these bounds; pairs of runs met at once.
BLOCK_FRAMES, SHARD_RECORDINGS, PAIRS = 256, (4096, 65_536), 1 << 19


def pcm16(raw: bytes | None) -> np.ndarray:
    """Samples of little-endian 16-bit mono PCM; an odd last byte is ignored."""
    return np.frombuffer(raw or b"", "<i2", len(raw or b"") // 2).astype(np.float32) / 32768


def _folding() -> np.ndarray:
    """(spectrum bins, 12): which pitch class a bin counts for."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(f), 12), np.float32)
    used = np.flatnonzero((f >= LOW) & (f <= HIGH))
    fold[used, np.round(12 * np.log2(f[used] / BASE)).astype(int) % 12] = 1
    return fold


_FOLD, _HANN = _folding(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) pitch-class energies, smoothed and of unit length; silence is zero."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    out = np.zeros((n, 12), np.float32)
    for lo in range(0, n, BLOCK_FRAMES):
        k = min(BLOCK_FRAMES, n - lo)
        frames = np.lib.stride_tricks.sliding_window_view(samples[lo * HOP : (lo + k - 1) * HOP + FRAME], FRAME)[::HOP]
        out[lo : lo + k] = (np.abs(np.fft.rfft(frames * _HANN)).astype(np.float32) ** 2) @ _FOLD
    if n < len(SMOOTH):
        return np.zeros((0, 12), np.float32)
    out = sum(w * out[j : n - len(SMOOTH) + 1 + j] for j, w in enumerate(SMOOTH))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-9), 0)


def _halves(kind: int, y: int, h: int, w: int) -> tuple[list[tuple], list[tuple]]:
    """Rectangles (frame, class, end frame, end class) that a filter adds and that it compares them with."""
    if kind == 0:
        return [(0, y, w, y + h // 2)], [(0, y + h // 2, w, y + h)]
    if kind == 1:
        return [(0, y, w // 2, y + h)], [(w // 2, y, w, y + h)]
    if kind == 2:
        return [(0, y, w // 2, y + h // 2), (w // 2, y + h // 2, w, y + h)], [(w // 2, y, w, y + h // 2), (0, y + h // 2, w // 2, y + h)]
    if kind == 3:
        return [(0, y + h // 3, w, y + 2 * h // 3)], [(0, y, w, y + h // 3), (0, y + 2 * h // 3, w, y + h)]
    return [(w // 3, y, 2 * w // 3, y + h)], [(0, y, w // 3, y + h), (2 * w // 3, y, w, y + h)]


def packed(image: np.ndarray) -> np.ndarray:
    """Packed integers of a chroma image, one for each place with ``SPAN`` frames after it."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)

    def area(parts):
        return sum(total[b : b + n, d] - total[a : a + n, d] - total[b : b + n, c] + total[a : a + n, c] for a, c, b, d in parts)

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        first, second = _halves(kind, y, h, w)
        # areas are rounded, so that equal sounds at other places of a recording quantise alike
        value = np.log1p(np.round(area(first), 6)) - np.log1p(np.round(area(second), 6))
        out = out << np.uint32(2) | GRAY[np.searchsorted(CUTS, np.round(value, 6), "right")]
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    return packed(chroma(np.asarray(samples, np.float32)))


def fingerprint_recordings(rows: DataFrame, *, id_col: str, media_col: str, decode: Callable[[object], np.ndarray] = pcm16) -> DataFrame:
    """(rec_id, fingerprint, n_ints): little-endian unsigned 32-bit packed integers of every row.

    ``decode`` turns a media value into samples at ``RATE``; null media and recordings shorter
    than a fingerprint have an empty one; null ids and repeated rows are kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prints = [b"" if m is None else fingerprint(decode(m)).astype("<u4").tobytes() for m in pdf["media"]]
            yield pd.DataFrame({"id": pdf["id"], "none": pdf["none"], "fingerprint": prints})

    own = F.col(id_col).cast("long")
    given = rows.select(F.coalesce(own, F.lit(0).cast("long")).alias("id"), own.isNull().alias("none"), F.col(media_col).alias("media"))
    out = given.mapInPandas(run, "id long, none boolean, fingerprint binary")
    return out.select(F.when(~F.col("none"), F.col("id")).alias("rec_id"), "fingerprint", (F.length("fingerprint") / 4).cast("long").alias("n_ints"))


def _errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits and places of the overlap when ``b`` starts ``offset`` places after ``a``; places
    at which either is silent do not count."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 0
    x, y = a[lo:hi], b[lo - offset : hi - offset]
    sound = (x != SILENT) & (y != SILENT)
    return int(np.bitwise_count(x[sound] ^ y[sound]).sum()), int(sound.sum())


def _runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first place and length of each run of equal keys that is not silent."""
    key = np.where(code == SILENT, np.int64(-1), (code >> np.uint32(32 - KEY_BITS)).astype(np.int64))
    first = np.flatnonzero(np.diff(key, prepend=-2) != 0)
    length = np.diff(np.append(first, len(key)))
    good = key[first] >= 0
    return key[first][good], first[good], length[good]


class Shard:
    """Recordings with their runs of equal keys sorted by key."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints = prints
        runs = [_runs(p) for p in prints]
        key = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in runs)])
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], np.repeat(np.arange(len(prints)), [len(r[0]) for r in runs])[order]
        self.first, self.length = (np.concatenate([np.zeros(0, np.int64), *(r[j] for r in runs)])[order] for j in (1, 2))
        self.reach = max((len(p) for p in prints), default=0)

    def votes(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(recording, offset, votes) of each recording's most voted offset, ties to the least.

        Two runs of one key vote for a range of offsets: rising, level, falling. Only the four bends
        of that line are noted, however long the runs are, and a recording's votes are the sum of its lines."""
        key, first, length = _runs(query)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        width, bends, slopes = self.reach + 2 * len(query) + 2, np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = 0
        total = np.cumsum(hi - lo)
        while begin < len(key):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            n = (hi - lo)[begin:stop]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[begin:stop], n)
            mine, long = np.repeat(first[begin:stop], n), np.repeat(length[begin:stop], n)
            low = self.owner[at] * (2 * width) + self.first[at] - mine - long + 1 + width
            points = np.concatenate([low, low + long, low + self.length[at], low + long + self.length[at]])
            change = np.repeat(np.array([1, -1, -1, 1]), len(at))
            points, place = np.unique(np.concatenate([bends, points]), return_inverse=True)
            slopes = np.bincount(place, np.concatenate([slopes, change]), len(points)).astype(np.int64)
            bends, begin = points, stop
        if not len(bends):
            return bends, bends, bends
        rec, x = bends // (2 * width), bends % (2 * width) - width
        slope = np.cumsum(slopes)  # 0 again at the end of every recording
        gap = np.diff(x, append=x[-1] + 1)
        gap[np.append(np.diff(rec) > 0, True)] = 1  # the last bend of a recording, whose slope is 0
        value = np.cumsum(slope * gap) - slope * (gap - 1)  # at the bend itself
        ends = np.concatenate([value, value + slope * (gap - 1)])
        rec2, x2 = np.concatenate([rec, rec]), np.concatenate([x, x + gap - 1])
        order = np.lexsort((x2, -ends, rec2))
        top = order[np.diff(rec2[order], prepend=-1) > 0]
        return rec2[top], x2[top], ends[top]

    def aligned(self, query: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(recording, offset, share of differing bits) of those aligned with ``query``. The offset
        is the place of the query's start: the most voted one, ties to the least."""
        for rec, offset, count in zip(*self.votes(query)):
            if count >= MIN_VOTES:
                bits, places = _errors(self.prints[rec], query, int(offset))
                if places >= MIN_OVERLAP and bits <= MAX_ERROR * 32 * places:
                    yield int(rec), int(offset), bits / (32 * places)


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas body over rows sorted by shard, its recordings before its queries: each class of the
    shard with its best query and how many align with it. Queries stream past the shard."""
    number, raw, shard, best, links = None, [], None, {}, {}

    def result() -> pd.DataFrame:
        return pd.DataFrame([(raw[r], links[r], *best[r]) for r in links], columns=["fingerprint", "links", "bit_error", "query_id", "offset"])

    for pdf in batches:
        for key, turn, query, mine in pdf[["shard", "turn", "query_id", "fingerprint"]].itertuples(index=False):
            if key != number:
                if links:
                    yield result()
                number, raw, shard, best, links = key, [], None, {}, {}
            if not turn:
                raw.append(mine)
                continue
            shard = shard or Shard([np.frombuffer(r, "<u4") for r in raw])
            for rec, offset, error in shard.aligned(np.frombuffer(mine, "<u4")):
                if raw[rec] != mine:
                    links[rec] = links.get(rec, 0) + 1
                    best[rec] = min(best.get(rec, (2.0, 0, 0)), (error, query, offset))
    if links:
        yield result()


def align_recordings(prints: DataFrame, queries: Column, *, shard: int | None = None) -> DataFrame:
    """Align all recordings (of ``fingerprint_recordings``) with those that ``queries`` picks.

    One row per row: rec_id, n_ints, class_id (least id of an equal fingerprint), n_links (query
    fingerprints other than its own that align), and of the best of them (fewest differing bits,
    then least id) query_id, offset and bit_error. Empty fingerprints have neither class nor
    links; null ids are no queries but are aligned; an empty table gives no rows."""
    known = prints.where("n_ints > 0")
    classes = known.groupBy("fingerprint").agg(F.min("rec_id").alias("class_id"), F.min(F.when(queries, F.col("rec_id"))).alias("query_id"))
    classes = materialize(classes)
    total = classes.count()
    shard = min(max(total // 64, SHARD_RECORDINGS[0]), SHARD_RECORDINGS[1]) if shard is None else shard
    shards = max(1, -(-total // shard))
    mark, zero = F.xxhash64("fingerprint"), F.lit(0).cast("long")
    held = classes.select("fingerprint", F.pmod(mark, F.lit(shards)).alias("shard"), F.lit(0).alias("turn"), zero.alias("query_id"))
    asked = classes.where("query_id IS NOT NULL").select("fingerprint", F.explode(F.sequence(zero, F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("turn"), "query_id")
    met = held.unionByName(asked).repartition(4 * shards, "shard").sortWithinPartitions("shard", "turn")
    pairs = met.mapInPandas(_align, "fingerprint binary, links long, bit_error double, query_id long, offset long")
    best = pairs.groupBy("fingerprint").agg(F.sum("links").alias("n_links"), F.min(F.struct("bit_error", "query_id", "offset")).alias("best"))
    out = prints.join(classes.select("fingerprint", "class_id").join(best, "fingerprint", "left"), "fingerprint", "left")
    return out.select("rec_id", "n_ints", "class_id", F.coalesce("n_links", zero).alias("n_links"), "best.query_id", "best.offset", "best.bit_error")


def tones_of_vector(vector) -> np.ndarray:
    """A recording of a vector, where a table has no media of its own: one tone of ``HOP`` samples
    per component, a semitone for each 1/40 of its value, three octaves around the middle."""
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], np.float64))
    pitch = np.clip(np.round(18 + 40 * v), 0, 35)
    step = 2 * np.pi * 110 * 2 ** (pitch / 12) / RATE
    phase = np.cumsum(np.repeat(step, HOP))
    return np.sin(phase).astype(np.float32)
