"""Bounded, deterministic samples of labelled rows for fitting a classifier."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Hash space of the sampling decision.
_SPACE = 1 << 24
#: Most classes a label column may have; more raise.
MAX_CLASSES = 4096
#: Pieces of a long text that a fit reads.
PIECES = 8


def _place(*cols: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), *cols), F.lit(_SPACE))


def excerpt(text: Column, chars: int) -> Column:
    """The text, or of one longer than ``chars`` as many characters in ``PIECES`` pieces spread over the whole."""
    size, piece = F.length(text), chars // PIECES
    starts = [F.floor((size - piece) * k / (PIECES - 1)).cast("int") + 1 for k in range(PIECES)]
    return F.when(size <= chars, text).otherwise(F.concat_ws("\n", *(F.substring(text, s, F.lit(piece)) for s in starts)))


def sample_by_class(rows: DataFrame, id_col: str, label_col: str, size: int, max_classes: int = MAX_CLASSES) -> DataFrame:
    """About ``size`` rows, as evenly from the classes of ``label_col`` as they have rows.

    A row's fate depends on its id alone, so the sample is the same at any partitioning; only
    the label counts reach the driver, and more than ``max_classes`` labels raise."""
    found = rows.where(F.col(label_col).isNotNull()).groupBy(label_col).count().limit(max_classes + 1).collect()
    if len(found) > max_classes:
        raise ValueError(f"{label_col} has more than {max_classes} classes")
    counts = {r[0]: r[1] for r in found}
    if not counts:
        return rows.limit(0)
    left, share = size, {}
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left // (len(counts) - k))
        share[label], left = take / n, left - take
    form = StructType().add("_class", rows.schema[label_col].dataType).add("_below", "long")
    table = rows.sparkSession.createDataFrame([(k, int(p * _SPACE) + (p >= 1)) for k, p in share.items()], form)
    return rows.join(F.broadcast(table), F.col(label_col) == F.col("_class")).where(_place(id_col) < F.col("_below")).drop("_class", "_below")


def first_by_hash(rows: DataFrame, most: int, id_col: str, *ties: str) -> DataFrame:
    """At most ``most`` rows, those first by the hash of their id, then by id and ``ties``: the same at any partitioning."""
    return rows.orderBy(_place(id_col), id_col, *ties).limit(most)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, size: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """Text and label of a bounded sample: at most about ``size`` labelled ids, their texts of any
    length, of long ones ``max_chars`` characters in pieces. Conflicting labels of an id count as
    the larger, of conflicting texts the least counts.

    The sampled ids are few by construction (``size``), so they are broadcast and the
    documents are scanned in place."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    chosen = first_by_hash(sample_by_class(one, id_col, "_label", size), 2 * size, id_col)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col), excerpt(text, max_chars).alias("text")).where(F.length("text") > 0)
    found = texts.join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min("text").alias("text"), F.max("_label").alias("label"))
    return found.toPandas().sort_values(id_col, ignore_index=True)
