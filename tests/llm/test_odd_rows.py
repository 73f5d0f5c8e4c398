"""Clashing columns, very long texts, ties and repeated rows, where the operators' own tests lack them."""

import numpy as np
from pyspark.sql import functions as F

from kairograph.llm import audio, jaccard, lm, mixing

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 5000}x{k % 77}" for k in range(120_000))


def test_near_duplicates_of_clashing_columns_and_long_texts(spark):
    rows = [(1, LONG), (2, LONG + " tail"), (3, LONG[: len(LONG) // 2]), (4, "a b c d"), (4, "a b c d"), (5, "A b\tc d")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("own")).withColumn("n_shingles", F.lit("own")).withColumn("token", F.lit(1)).repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(d, jaccard.Similarity(3, 90, 100)).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 4)]
    kept = jaccard.keep_one_per_group(d, jaccard.Similarity(3, 90, 100))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.first().token == 1


def test_language_model_of_long_and_repeated_texts(spark):
    rows = [(k, "the cat sat on the mat and " * (1 + k % 3)) for k in range(30)] + [(90, LONG[:400_000]), (91, LONG[:400_000]), (91, LONG[:400_000]), (92, None), (93, ""), (94, "x" * 200_000), (None, "the cat")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("block", F.lit(1)).repartition(4)
    got = lm.score_texts(d, train=F.col("doc_id") % 10 != 0).collect()
    assert len(got) == len(rows) and all(np.isfinite([r.score, r.base_score]).all() and r.score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (92, 93)} == {1}
    twice = [r.score for r in got if r.doc_id == 91]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_alignment_of_clashing_columns_and_repeated_rows(spark):
    tone = audio.fingerprint(audio.tones_of_vector(np.random.default_rng(0).normal(size=64) / 4))
    other = audio.fingerprint(audio.tones_of_vector(np.random.default_rng(1).normal(size=64) / 4))
    quiet = np.full(9000, audio.SILENT)
    long = np.concatenate([quiet, tone, quiet])
    rows = [(k, p.astype("<u4").tobytes(), len(p)) for k, p in enumerate([tone, tone, other, long, quiet])] + [(0, tone.astype("<u4").tobytes(), len(tone)), (None, tone[2:].astype("<u4").tobytes(), len(tone) - 2)]
    d = spark.createDataFrame(rows, "rec_id long, fingerprint binary, n_ints long").withColumn("shard", F.lit("own")).withColumn("query_id", F.lit("own")).withColumn("turn", F.lit("own")).repartition(3)
    got = sorted(((r.rec_id if r.rec_id is not None else -1), r.class_id, r.n_links, r.query_id, r.offset) for r in audio.align_recordings(d, F.col("rec_id") == 0).collect())
    assert got == [(-1, None, 1, 0, -2), (0, 0, 0, None, None), (0, 0, 0, None, None), (1, 0, 0, None, None), (2, 2, 0, None, None), (3, 3, 1, 0, 9000), (4, 4, 0, None, None)]


def test_mixing_of_long_texts(spark):
    d = spark.createDataFrame([(1, LONG, "s", "en"), (2, "a b", "s", "en"), (3, "word " * 400_000, "t", "de")], "doc_id long, text string, source string, lang string")
    rows = {r.doc_id: r.n_tokens for r in mixing.mix_to_targets(d, mixing.document_margins(), tokens=mixing.word_tokens(F.col("text")), fraction=0.9).collect()}
    assert rows == {1: 120_001, 2: 3, 3: 400_001}


def test_pipeline_of_long_texts_and_ties(spark, tmp_path):
    import corpus_pipeline as cp
    from kairograph.llm.common import materialize

    some = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    body = " ".join(r.text for r in some.collect() if r.text)
    body = body * (1 + 600_000 // len(body))
    tied = spark.createDataFrame([(9001, body, "en", "web", len(body)), (9002, body, "en", "web", len(body)), (9002, body, "en", "web", len(body))], some.schema)
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    now = materialize(some.unionByName(tied))
    for name, stage in cp.STAGES:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = materialize(stage(spark, now, str(tmp_path)))
        assert {r.doc_id for r in now.select("doc_id").collect()} <= before
        if name == "near_duplicates":
            assert now.where("doc_id >= 9001").count() <= 1
