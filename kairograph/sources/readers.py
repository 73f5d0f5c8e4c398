"""Readers of the dataset files: dictionaries, facts, descriptions, matrices, samples and codes."""

from __future__ import annotations

import csv
import io

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import spaced_name
from .matrix import read_matrix  # noqa: F401

FACTS = "seq long, s long, r long, o long, t long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines; ``seq`` grows in the order of a file's lines."""
    return spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).where(F.trim("value") != "")


def _strict(ok: Column, value: Column, message: str) -> Column:
    """``value`` where ``ok``, else an error that shows the line."""
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("value"))).cast("string"))


def read_id_names(spark: SparkSession, path: str, *, fields: str = "least", spaces: bool = True) -> DataFrame:
    """(seq, id, name) of ``name<TAB>id`` lines.

    ``fields``: ``least`` skips lines of fewer than two fields, ``exact`` those of any other
    number, ``strict`` raises on lines of fewer. ``spaces`` turns underscores into spaces."""
    parts = F.split(F.trim("value"), "\t")
    rows = _lines(spark, path)
    if fields == "strict":
        rows = rows.withColumn("value", _strict(F.size(parts) >= 2, F.col("value"), "no tab in line"))
    else:
        rows = rows.where(F.size(parts) == 2 if fields == "exact" else F.size(parts) >= 2)
    name = spaced_name(parts[0]) if spaces else parts[0]
    return rows.select("seq", F.trim(parts[1]).cast("long").alias("id"), name.alias("name"))


def name_to_id(names: DataFrame) -> DataFrame:
    """(name, id); of repeated names the last line counts."""
    return names.groupBy("name").agg(F.max_by("id", "seq").alias("id"))


def read_facts(spark: SparkSession, path: str, *, strict: bool = False, timed: bool = True) -> DataFrame:
    """(seq, s, r, o, t) of white-space separated lines, without t unless ``timed``: further fields are
    ignored, shorter lines skipped (``strict``: tab-separated, shorter lines raise). A missing file is an
    empty table, but raises where ``strict``."""
    names = "srot" if timed else "sro"
    try:
        rows = _lines(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND" and not strict:
            return spark.createDataFrame([], FACTS).select("seq", *names)
        raise
    parts = F.split("value", "\t") if strict else F.split(F.trim("value"), "\\s+")
    if strict:
        rows = rows.withColumn("value", _strict(F.size(parts) >= len(names), F.col("value"), "too few fields in line"))
    else:
        rows = rows.where(F.size(parts) >= len(names))
    return rows.select("seq", *(F.trim(parts[k]).cast("long").alias(c) for k, c in enumerate(names)))


def read_dataset(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """Entities, relations and all facts (split, and seq in the order train, valid, test) of a dataset folder."""
    facts = None
    for k, split in enumerate(("train", "valid", "test")):
        f = read_facts(spark, f"{root}/{name}/{split}.txt").withColumn("seq", F.col("seq") + F.lit(k << 58)).withColumn("split", F.lit(split))
        facts = f if facts is None else facts.unionByName(f)
    return {"entities": read_id_names(spark, f"{root}/{name}/entity2id.txt"), "relations": read_id_names(spark, f"{root}/{name}/relation2id.txt"), "facts": facts}


def read_link_dataset(spark: SparkSession, folder: str, *, timed: bool = True) -> dict[str, DataFrame]:
    """A link-prediction dataset folder as five tables: ``entities`` and ``relations`` (id, name), ``train``,
    ``valid`` and ``test`` (seq, s, r, o, and t if ``timed``). Lines are separated by tabs; a missing
    file, a line that is too short, or a fact of an id without a name raises when it is read."""
    names = {k: read_id_names(spark, f"{folder}/{f}2id.txt", fields="strict", spaces=False).groupBy("id").agg(F.max_by("name", "seq").alias("name")) for k, f in (("entities", "entity"), ("relations", "relation"))}

    def known(facts: DataFrame, column: str, table: str) -> DataFrame:
        mark = names[table].select(F.col("id").alias(column), F.lit(True).alias("_known"))
        text = F.concat(F.lit(f"no name in {table} for id "), F.col(column).cast("string"))
        joined = facts.join(mark, column, "left")
        return joined.withColumn(column, F.when(F.col("_known"), F.col(column)).otherwise(F.raise_error(text).cast("long"))).drop("_known")

    def split(name: str) -> DataFrame:
        facts = read_facts(spark, f"{folder}/{name}.txt", strict=True, timed=timed)
        columns = facts.columns
        return known(known(known(facts, "s", "entities"), "o", "entities"), "r", "relations").select(*columns)

    return {**names, **{k: split(k) for k in ("train", "valid", "test")}}


def read_word_graph(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, rel, word_id) of the static word graph."""
    return spark.read.csv(path, sep="\t", schema="entity_id long, rel int, word_id long", mode="FAILFAST")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples text, compressed or not; comments and other lines are skipped."""
    pattern = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.+?)\s*\.\s*$"
    found = [F.regexp_extract("value", pattern, k).alias(c) for k, c in ((1, "s"), (2, "p"), (3, "o"))]
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(*found)


def read_delimited(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A headed text table whose delimiter is told from its first line; headers are trimmed,
    lower-cased and freed of a byte-order mark. Raises where a required column is missing."""
    head = spark.read.text(path).limit(1).collect()
    first = head[0][0].lstrip("﻿") if head else ""
    sep = max("\t,;|", key=first.count)
    names = [x.strip().lower() for x in next(csv.reader(io.StringIO(first), delimiter=sep), [])]
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in names)
    return spark.read.csv(path, sep=sep, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=True)


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, description) with unique ids; repeated ids raise."""
    d = read_delimited(spark, path, ("id", "name", "description")).select(F.col("id").cast("long").alias("id"), "name", "description")
    twice = d.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{path} repeats id {twice[0][0]}")
    return d


def read_samples(spark: SparkSession, path: str, schema: str, *, lines: bool = True, wrapper: tuple[str, ...] = ("data", "samples", "records")) -> DataFrame:
    """Samples of JSON lines, of an array, or of an array inside an object (``wrapper``); broken lines raise."""
    if lines:
        return spark.read.json(path, schema=schema, mode="FAILFAST")
    plain = spark.read.json(path, schema=schema, multiLine=True)
    inside = spark.read.json(path, schema=", ".join(f"`{w}` array<struct<{schema}>>" for w in wrapper), multiLine=True)
    held = inside.select(F.explode(F.coalesce(*wrapper)).alias("x")).select("x.*")
    return held if held.limit(1).count() else plain


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, level from 0, code) of a table whose z-columns are found by name (z0.. or z1..)."""
    d = read_delimited(spark, path, ("entity_id",))
    z = sorted((c for c in d.columns if c[:1] == "z" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(c).cast("int").alias("code")) for k, c in enumerate(z)))).alias("x")
    return d.select(F.col("entity_id").cast("long").alias("entity_id"), rows).select("entity_id", "x.*")


def read_codebooks(spark: SparkSession, path: str) -> DataFrame:
    """(level, code, centroid) of the written codebooks below ``path``."""
    return spark.read.schema("level int, code int, centroid array<double>").parquet(f"{path}/codebooks")


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, level from 1, code) of a JSON object from id to a string of code tokens."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "text"))
    token = F.explode(F.regexp_extract_all("text", F.lit("<z[0-9]+_[0-9]+>"), F.lit(0))).alias("token")
    part = lambda k: F.regexp_extract("token", "<z([0-9]+)_([0-9]+)>", k).cast("int")
    return m.select(F.col("id").cast("long").alias("entity_id"), token).select("entity_id", part(1).alias("level"), part(2).alias("code"))


def read_token_map(spark: SparkSession, path: str) -> DataFrame:
    """(token, level, code_index) of a JSON object from token to its level and code, in that order."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<level:int,code_index:int>>")).alias("token", "at"))
    return m.select("token", "at.level", "at.code_index").orderBy("level", "code_index", "token")


def attach_tokens(codes: DataFrame, tokens: DataFrame) -> DataFrame:
    """``codes`` (entity_id, level from 0, code) plus ``token``; a missing token raises."""
    t = tokens.select((F.col("level") - 1).alias("level"), F.col("code_index").alias("code"), "token")
    text = F.concat(F.lit("no token for level "), F.col("level").cast("string"), F.lit(" code "), F.col("code").cast("string"))
    return codes.join(t, ["level", "code"], "left").withColumn("token", F.coalesce("token", F.raise_error(text).cast("string")))


def sample_fields(samples: DataFrame) -> DataFrame:
    """Query and mode of samples that name them in different ways: the field itself, else from ``meta``."""
    cols = samples.columns
    meta = dict(samples.dtypes).get("meta", "")
    has = lambda c: c in cols
    query = [F.col("query")] * has("query") + [F.array("meta.s_id", "meta.r_id", "meta.o_id", "meta.t")] * all(f"{k}:" in meta for k in ("s_id", "r_id", "o_id", "t"))
    mode = [F.col("mode")] * has("mode") + [F.col(f"meta.{k}") for k in ("direction", "mode") if f"{k}:" in meta]
    text = [F.col(c) for c in ("prompt", "input") if has(c)]
    answer = [F.col(c) for c in ("answer", "output", "target") if has(c)]
    pick = lambda xs, n: (F.coalesce(*xs) if xs else F.lit(None)).alias(n)
    return samples.select("*", pick(query, "query_of"), pick(mode, "mode_of"), pick(text, "prompt_of"), pick(answer, "answer_of"))
