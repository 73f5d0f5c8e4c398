"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells, one for each combination of the mixing columns (source,
language, topic). Spark sums the tokens of each cell; raking scales the cells' weights
until every column's marginal has its target shares; the ratio of a cell's weight to its
tokens, calibrated to the wanted number of tokens, is the probability of its documents.
A document is drawn by a hash of its id, so the draw is the same at any partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_with, materialize

#: Rounds of raking; each round scales every mixing column once.
ROUNDS = 20
#: Most cells that the driver rakes (about 100 bytes each) or Spark broadcasts; more stay in Spark tables.
MAX_CELLS = 100_000
NONE = "(none)"
_U = 16.0**13

#: The topics told apart by the form of a text, first match first.
TOPIC_PATTERNS = (("legal", "[Ll]icen[sc]e|[Cc]opyright"), ("contact", "[A-Za-z0-9._]@[A-Za-z0-9]"), ("table", " \\| "), ("dated", "[0-9]{4}"))
SHORT_TOKENS = 100


def word_tokens(text: Column) -> Column:
    """Words of a text and one end; a null text is its end alone."""
    return (F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)) + 1).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """Topic by form: what the patterns say, else short or prose."""
    out = None
    for name, pattern in TOPIC_PATTERNS:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.when(tokens < SHORT_TOKENS, "short").otherwise("prose")


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id's text: 52 bits of its salted md5."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(_U)


def flattened(alpha: float):
    """Target of a column: its own shares to the power ``alpha`` (1 keeps them, 0 makes them equal)."""
    return lambda share: share**alpha


def _shares(own: pd.Series, target) -> pd.Series:
    """Target shares of the values present, from a rule or a mapping; values without one get none."""
    want = own.map(target) if callable(target) else own.index.to_series().map(lambda v: float(target.get(v, 0.0)))
    want = want.clip(lower=0.0)
    return want / want.sum() if want.sum() > 0 else own


def rake(cells: pd.DataFrame, targets: Mapping[str, object], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of cells (columns of ``targets``, and ``n``) whose marginals approach the targets;
    they sum to 1, and a cell of no tokens weighs nothing."""
    n = cells["n"].to_numpy(float)
    w = n / max(n.sum(), 1e-300)
    codes = []
    for col, target in targets.items():
        code, values = pd.factorize(cells[col])
        own = pd.Series(np.bincount(code, w, len(values)), index=values)
        codes.append((code, _shares(own, target).to_numpy(float)))
    for _ in range(rounds):
        for code, share in codes:
            now = np.bincount(code, w, len(share))
            w = w * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[code]
    return w


def calibrate(n: np.ndarray, w: np.ndarray, fraction: float) -> np.ndarray:
    """Probabilities min(1, c * ratio) whose expected tokens are ``fraction`` of all; where too
    few cells have weight for that, those are taken whole."""
    ratio = np.divide(w * n.sum(), n, out=np.zeros_like(w), where=n > 0)
    order = np.argsort(-ratio, kind="stable")
    r, m = ratio[order], n[order].astype(float)
    above = np.concatenate([[0.0], np.cumsum(m)[:-1]])
    below = np.cumsum((r * m)[::-1])[::-1]
    scale = np.divide(fraction * n.sum() - above, below, out=np.full_like(r, np.inf), where=below > 0)
    fits = np.flatnonzero(scale * r <= 1)
    c = scale[fits[0]] if len(fits) else np.inf
    with np.errstate(invalid="ignore"):
        return np.where(ratio > 0, np.minimum(1.0, np.nan_to_num(c * ratio, nan=0.0, posinf=1.0)), 0.0)


def _rake_in_spark(cells: DataFrame, targets: Mapping[str, object], rounds: int, fraction: float) -> DataFrame:
    """The same for more cells than the driver takes: each round is one written table."""
    total = cells.agg(F.sum("n")).first()[0]
    now = cells.withColumn("w", F.col("n") / F.lit(float(total)))
    wants = {}
    for col, target in targets.items():
        own = now.groupBy(col).agg(F.sum("w").alias("own"))
        if callable(target):
            want = own.select(col, target(F.col("own")).alias("want"))
        else:
            known = now.sparkSession.createDataFrame(pd.DataFrame({col: list(target), "want": [float(x) for x in target.values()]}), f"{col} string, want double")
            want = own.join(known, col, "left").select(col, F.greatest(F.coalesce("want", F.lit(0.0)), F.lit(0.0)).alias("want"))
        all_of = want.agg(F.sum("want")).first()[0]
        wants[col] = materialize(want.withColumn("want", F.col("want") / F.lit(all_of)))
    for _ in range(rounds):
        for col, want in wants.items():
            scale = now.groupBy(col).agg(F.sum("w").alias("now")).join(want, col).select(col, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(0.0).alias("_f"))
            now = now.join(scale, col).withColumn("w", F.col("w") * F.col("_f")).drop("_f")
        now = materialize(now)
    ratio = F.when(F.col("n") > 0, F.col("w") * F.lit(float(total)) / F.col("n")).otherwise(0.0)
    low, high = 0.0, 1e12
    for _ in range(60):
        c = (low + high) / 2 if low else np.sqrt(max(low, 1e-12) * high)
        got = now.agg(F.sum(F.col("n") * F.least(F.lit(1.0), F.lit(float(c)) * ratio))).first()[0]
        low, high = (c, high) if got < fraction * total else (low, c)
    return materialize(now.withColumn("probability", F.least(F.lit(1.0), F.lit(float(high)) * ratio)))


def mix_to_targets(docs: DataFrame, margins: Mapping[str, tuple[Column, object]], *, tokens: Column, fraction: float, id_col: str = "doc_id", seed: int = 0, rounds: int = ROUNDS, max_cells: int = MAX_CELLS) -> DataFrame:
    """All columns of ``docs`` plus ``n_tokens``, one ``mix_<name>`` per margin, ``weight`` (the
    raked share of all tokens of the document's cell), ``probability`` and ``selected``.

    ``margins`` maps a name to (column, target); a target is a rule from own share to wanted
    share, or a mapping from value to share. Null values are the value ``(none)``; null ids
    draw alike; repeated rows share their fate; an empty table stays empty; existing columns
    of the added names are replaced."""
    spark, names = docs.sparkSession, [f"mix_{m}" for m in margins]
    added = ["n_tokens", *names, "weight", "probability", "selected"]
    rows = docs.withColumn("n_tokens", tokens)
    rows = rows.select("*", *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"mix_{m}") for m, (c, _) in margins.items()))
    rows = rows.select(*columns_with(docs, *added), "n_tokens", *names)
    cells = materialize(rows.groupBy(*names).agg(F.sum("n_tokens").alias("n")))
    targets = {f"mix_{m}": t for m, (_, t) in margins.items()}
    if cells.count() <= max_cells:
        pdf = cells.toPandas().sort_values(names, ignore_index=True)  # at most max_cells
        pdf["w"] = rake(pdf, targets, rounds)
        pdf["probability"] = calibrate(pdf["n"].to_numpy(float), pdf["w"].to_numpy(float), fraction)
        table = spark.createDataFrame(pdf[[*names, "w", "probability"]], ", ".join(f"{c} string" for c in names) + ", w double, probability double")
        table = F.broadcast(table)
    else:
        table = _rake_in_spark(cells, targets, rounds, fraction).select(*names, "w", "probability")
    out = rows.join(table.withColumnRenamed("w", "weight"), names)
    return out.withColumn("selected", uniform(F.col(id_col), seed) < F.col("probability")).select(*columns_with(docs, *added), *added)


def document_margins(alpha: float = 0.7) -> dict[str, tuple[Column, object]]:
    """Source, language and topic of the document table, each flattened by ``alpha``."""
    return {"source": (F.col("source"), flattened(alpha)), "lang": (F.col("lang"), flattened(alpha)), "topic": (form_topic(F.coalesce("text", F.lit("")), F.col("n_tokens")), flattened(alpha))}


def keep_mixed(docs: DataFrame, *, fraction: float = 0.8, alpha: float = 0.7) -> DataFrame:
    """The drawn documents with their own columns."""
    own = {c: f"own_{c}" for c in ("n_tokens", "weight", "probability", "selected") if c in docs.columns}
    mixed = mix_to_targets(docs.withColumnsRenamed(own), document_margins(alpha), tokens=word_tokens(F.col("text")), fraction=fraction)
    return mixed.where("selected").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def mixing_sql(*, fraction: float, alpha: float, rounds: int = ROUNDS, seed: int = 0) -> str:
    """The registered query as SQL over ``documents``: the rounds are unrolled, one table each."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{t}'" for t, p in TOPIC_PATTERNS) + f" WHEN n_tokens < {SHORT_TOKENS} THEN 'short' ELSE 'prose' END"
    dims = ("source", "lang", "topic")
    parts = [
        "t AS MATERIALIZED (SELECT *, 1 + coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents)",
        f"d AS MATERIALIZED (SELECT doc_id, n_tokens, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {topic} AS topic FROM t)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL)",
        "r0 AS MATERIALIZED (SELECT *, n / sum(n) OVER () AS w, " + ", ".join(f"pow(sum(n) OVER (PARTITION BY {x}) / sum(n) OVER (), {alpha}) AS p_{x}" for x in dims) + " FROM c)",
    ]
    for x in dims:
        parts.append(f"z_{x} AS MATERIALIZED (SELECT sum(p) AS z FROM (SELECT DISTINCT {x}, p_{x} AS p FROM r0))")
    last = "r0"
    for k in range(rounds):
        for x in dims:
            now = f"r{k + 1}_{x}"
            parts.append(f"{now} AS MATERIALIZED (SELECT * REPLACE (w * (p_{x} / (SELECT z FROM z_{x})) / sum(w) OVER (PARTITION BY {x}) AS w) FROM {last})")
            last = now
    parts += [
        f"q AS MATERIALIZED (SELECT *, w * sum(n) OVER () / n AS ratio, sum(n) OVER () AS total FROM {last})",
        f"s AS MATERIALIZED (SELECT *, ({fraction} * total - (sum(n) OVER o - n)) / (sum(ratio * n) OVER () - (sum(ratio * n) OVER o - ratio * n)) AS scale FROM q WINDOW o AS (ORDER BY ratio DESC, source, lang, topic ROWS UNBOUNDED PRECEDING))",
        "f AS MATERIALIZED (SELECT arg_max(scale, ratio) AS scale FROM s WHERE scale * ratio <= 1)",
        "p AS MATERIALIZED (SELECT source, lang, topic, w, least(1.0, ratio * (SELECT scale FROM f)) AS probability FROM q)",
    ]
    u = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(16, 13)"
    return "WITH " + ", ".join(parts) + (
        " SELECT d.doc_id, d.n_tokens::BIGINT AS n_tokens, d.topic AS topic, round(w, 6) AS weight, round(probability, 6) AS probability, "
        f"{u} < probability AS selected FROM d JOIN p USING (source, lang, topic)"
    )
