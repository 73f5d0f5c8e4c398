"""The registered queries of the training-data operators, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    """Register ``f`` under its own name."""
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a 4096-token sequence."""
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


@query
def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth row among all rows."""
    from .ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality probability of every document, learned from labels outside one fold of three."""
    from .common import crc32_mod
    from .quality import score_quality, train_quality

    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"), train_rows=crc32_mod("doc_id", 3) != 1)
    return score_quality(docs, model).select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the languages outside one fold of three."""
    from .common import crc32_mod
    from .langid import predict_language, train_language

    docs = table(spark, sf_dir, "documents")
    model = train_language(docs, train_rows=crc32_mod("doc_id", 3) != 1)
    return predict_language(docs, model).select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity probability of every document, learned from labels outside one fold of five."""
    from .common import crc32_mod
    from .toxicity import score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), train_rows=crc32_mod("doc_id", 5) != 0)
    return score_toxicity(docs, model).select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets are at least 0.9 alike."""
    from .jaccard import Similarity, jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), Similarity(k=3, num=90, den=100))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, learned from nine folds of ten."""
    from .common import crc32_mod
    from .lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"), train=crc32_mod("doc_id", 10) != 0)


@query
def op9_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of all vectors (the tables have no media column), each aligned with every fiftieth one."""
    from .audio import align_recordings, fingerprint_recordings, tones_of_vector
    from .common import materialize

    prints = materialize(fingerprint_recordings(table(spark, sf_dir, "embeddings"), id_col="vec_id", media_col="embedding", decode=tones_of_vector))
    return align_recordings(prints, F.col("rec_id") % 50 == 0)


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether the tokens are more than 2048."""
    import public_tokenizers

    from .token_automaton import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after every seventh row's label is moved on by one."""
    from .hard_negatives import mine_hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least 5 letters and 3 occurrences with its near words' number, form and root."""
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), drop_one_in=97)


#: Production mixing: the share of the tokens to keep, and how far shares are flattened.
MIX_FRACTION, MIX_ALPHA = 0.8, 0.7


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's raked weight, its probability and whether it is drawn."""
    from .mixing import document_margins, mix_to_targets, word_tokens

    docs = table(spark, sf_dir, "documents")
    mixed = mix_to_targets(docs, document_margins(MIX_ALPHA), tokens=word_tokens(F.col("text")), fraction=MIX_FRACTION)
    return mixed.select("doc_id", "n_tokens", F.col("mix_topic").alias("topic"), F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def _op10_sql() -> str:
    from .mixing import mixing_sql

    return mixing_sql(fraction=MIX_FRACTION, alpha=MIX_ALPHA)


ORACLE["op10_mixing"] = _op10_sql()
