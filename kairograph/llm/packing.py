"""Best-fit packing of documents into token sequences.

Hierarchical residual packing: every partition packs its own pieces best-fit
decreasing; nearly full bins are final; underfull bins become items of the next
level, where a few partitions' bins are merged best-fit, up a tree to one root.

Bound of what a level passes on. After best-fit no two bins of a group fit together,
so at most one bin of a group is half full or less. A bin more than half full can only
take in such a small bin, and a level with G groups has at most G of those. Passing on
the small bin and the G emptiest others therefore loses no possible merge, and a merge
task never sees more than fan_in * (G + 1) bins: a bound that grows with the number of
partitions, not with the documents in them.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

END_ID = 1
#: Chunks, and words, kept per worker, twice as many at most; the older half goes when a cache is full.
CACHE_ENTRIES = 200_000

# Fixed values of the tokenizer file: its split pattern on lower-case Latin text.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xe0-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xe0-\xf6\xf8-\xff]+")
_PLAIN = re.compile(r"[\x21-\x7e\xe0-\xf6\xf8-\xff]+")
#: Characters at which str.split() cuts though the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class _Cache(dict):
    """Two generations: a full cache becomes the old one, whose hits move up again."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkTokenizer:
    """Ids of the tokenizer file as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokenizer never joins text across white space, so ids of a text
    are the ids of its white-space chunks in order; chunks and words are looked up first
    and tokenized only when new. Chunks beyond plain Latin go to the full tokenizer.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = False
        self.model = self.full.model.tokenize
        seen, spare, byte_char = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256)), 256, {}
        for b in range(256):
            byte_char[b] = chr(b) if b in seen else chr(spare)
            spare += b not in seen
        self.as_bytes = {c: "".join(byte_char[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.words = _Cache(self._word, cache_entries)
        self.chunks = _Cache(self._chunk, cache_entries)

    def _word(self, word: str) -> bytes:
        return np.array([t.id for t in self.model(word if word.isascii() else word.translate(self.as_bytes))], "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if _PLAIN.fullmatch(low) and "<|" not in low and len(low) == len(chunk):
            words = self.words
            return b"".join([words[w] for w in _SPLIT.findall(low)])
        return self._whole(chunk)

    def encode(self, text: str | None) -> bytes:
        """Ids of one text, without the end id."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._whole(text)
        chunks = self.chunks
        return b"".join([chunks[c] for c in text.split()])


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item goes to the fullest bin that still takes it.
    Returns (bin of each item, offset of each item in its bin, bins' fill).
    Open bins are kept by residual, so a step costs a search over at most ``capacity`` sizes."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_residual: dict[int, list[int]] = {}
    sizes: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        k = bisect.bisect_left(sizes, n)
        if k == len(sizes):
            b = len(fill)
            fill.append(0)
        else:
            room = sizes[k]
            b = by_residual[room].pop()
            if not by_residual[room]:
                del by_residual[room], sizes[k]
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        room = capacity - fill[b]
        if room:
            if room not in by_residual:
                by_residual[room] = []
                bisect.insort(sizes, room)
            by_residual[room].append(b)
    return bin_of, offset, np.array(fill, np.int64)


def carried(fill: np.ndarray, capacity: int, others: int) -> np.ndarray:
    """Which bins go up the tree: those at most half full and the ``others`` emptiest rest."""
    open_bins = np.flatnonzero(fill < capacity)
    open_bins = open_bins[np.argsort(fill[open_bins], kind="stable")]
    small = int((fill[open_bins] * 2 <= capacity).sum())
    keep = np.zeros(len(fill), bool)
    keep[open_bins[: small + others]] = True
    return keep


_LOCAL = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, up boolean, fill long"


def _tokenize_and_pack(path: str, capacity: int, leaves: int, with_ids: bool, cache_entries: int):
    """mapInPandas body: (id, text) rows of a partition to pieces in local bins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = ChunkTokenizer(path, cache_entries)
        end = np.array([END_ID], "<u4").tobytes()
        doc, piece, start, length, crc, ids = [], [], [], [], [], []
        for pdf in batches:
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                raw = tok.encode(text) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    doc.append(None if key is None or key != key else int(key))
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
        if not doc:
            return
        n = np.array(length, np.int64)
        bin_of, offset, fill = best_fit(n, capacity)
        up = carried(fill, capacity, leaves)
        base = TaskContext.get().partitionId() << 40
        out = pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "piece": piece, "start": start, "length": n, "ids_crc32": crc, "bin": bin_of + base, "offset": offset, "up": up[bin_of], "fill": fill[bin_of]})
        if with_ids:
            out["ids"] = ids
        for k in range(0, len(out), 50_000):
            yield out.iloc[k : k + 50_000]

    return run


def _merge(capacity: int, others: int):
    """applyInPandas body: best-fit over the bins of a few groups of the level below."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        fill_in = pdf["fill"].to_numpy(np.int64)
        bin_of, offset, fill = best_fit(fill_in, capacity)
        up = carried(fill, capacity, others)
        members, bins, rows = list(pdf["members"]), pdf["bin"].to_numpy(), []
        order = np.argsort(bin_of, kind="stable")
        for b, inside in enumerate(np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1) if len(order) else []):
            held = [{"bin": int(x["bin"]), "shift": int(x["shift"] + offset[i])} for i in inside.tolist() for x in members[i]]
            rows.append((int(bins[inside[0]]), int(fill[b]), held, bool(up[b])))
        return pd.DataFrame(rows, columns=["bin", "fill", "members", "up"]).assign(grp=int(key[0]))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, fan_in: int = 8, with_ids: bool = False, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Pack all documents into as few ``capacity``-token sequences as best-fit finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    with ``with_ids`` the piece's ids as little-endian unsigned 32-bit bytes. Documents of
    more than ``capacity`` ids (end id included) are cut; all others stay whole.

    Null or empty texts are one end id; null ids stay null; repeated rows are packed once
    each; an empty table gives no rows; further columns are ignored. ``cache_entries`` trades a
    worker's memory for time and changes no result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    leaves = max(1, rows.rdd.getNumPartitions())
    local = materialize(rows.mapInPandas(_tokenize_and_pack(tokenizer_path, capacity, leaves, with_ids, cache_entries), _LOCAL + (", ids binary" if with_ids else "")))

    level = local.where("up").select("bin", "fill").distinct().select(
        "bin", "fill", F.array(F.struct(F.col("bin"), F.lit(0).cast("long").alias("shift"))).alias("members"), F.lit(True).alias("up"), F.shiftright("bin", 40).alias("grp")
    )
    schema, final = "bin long, fill long, members array<struct<bin:long,shift:long>>, up boolean, grp long", None
    groups = leaves
    while groups > 1:
        groups = -(-groups // fan_in)
        merged = materialize(level.withColumn("grp", F.floor(F.col("grp") / fan_in).cast("long")).groupBy("grp").applyInPandas(_merge(capacity, groups), schema))
        done = merged if groups == 1 else merged.where("NOT up")
        final = done if final is None else final.unionByName(done)
        level = merged.where("up")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    if final is None:
        return local.select(*keep, F.col("bin").alias("sequence_id"), "offset")
    moved = final.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.shift").alias("shift"))
    up = local.where("up").join(moved, "bin")
    return local.where("NOT up").select(*keep, F.col("bin").alias("sequence_id"), "offset").unionByName(
        up.select(*keep, "sequence_id", (F.col("offset") + F.col("shift")).alias("offset"))
    )
