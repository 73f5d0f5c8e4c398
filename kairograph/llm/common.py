"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words wherever a contract says ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for written tables: below ``spark.checkpoint.dir`` where that is set (shared by
    all machines); a local session without it, as in tests, gets a temporary one, a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="kairograph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/kairograph-{uuid.uuid4().hex}"


#: Rows that reach a Python worker at once while a table is written; texts may be long.
BATCH_ROWS = 1024
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back: cuts the
    lineage, survives lost executors, and keeps columnar compression. Python workers get at
    most ``batch_rows`` rows at once for it, or fewer where the session says so."""
    spark = df.sparkSession
    path, rows = scratch_dir(spark), spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(min(int(rows), batch_rows) if int(rows) > 0 else batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_KEY, rows)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        jvm, files = df.sparkSession.sparkContext._jvm, df.inputFiles()
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have shuffle files that no table refers to any more deleted now, not when the driver next runs short of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_memory() -> None:
    """Give memory that a finished fit has freed back to the system, where its C library offers that; the
    driver would hold it through all that follows."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def crc32_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null ids count as remainder 0)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(mod)), F.lit(0)).cast("int")


def columns_with(df: DataFrame, *fresh: str) -> list[str]:
    """Columns of ``df`` that do not clash with the names an operator adds."""
    return [c for c in df.columns if c not in fresh]


def lower_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, A-Z lower-cased, each text followed by one space,
    and where each text starts (one more entry at the end). Nulls are empty."""
    raw = [b"" if t is None or t != t else t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8).copy() if raw else np.zeros(0, np.uint8)
    upper = (data >= 65) & (data <= 90)
    data[upper] |= 0x20
    return data, starts


def text_groups(texts, chars: int) -> Iterator[list]:
    """Consecutive runs of texts of about ``chars`` characters together, so that work arrays
    stay small whatever a batch holds; a longer text is a run of its own."""
    group, size = [], 0
    for t in texts:
        n = len(t) if isinstance(t, str) else 0
        if group and size + n > chars:
            yield group
            group, size = [], 0
        group.append(t)
        size += n
    if group:
        yield group


_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096), np.uint64(0x5851F42D4C957F2D))]), dtype=np.uint64)
    return _POWERS[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of every lower-cased text.

    Returns (hash of each word, bytes of each word, word offsets of each text with one
    more entry at the end). Works on the bytes at once; no word becomes a Python object.
    """
    data, starts = lower_bytes(texts)
    n_docs = len(starts) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    solid = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    size = stop - first
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    part = (data[solid].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[at]
    sums = np.add.reduceat(part, np.cumsum(size) - size)
    return mix64(sums + size.astype(np.uint64) * _MULT), size, np.searchsorted(first, starts)
