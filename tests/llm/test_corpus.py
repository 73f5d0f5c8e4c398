"""Packing, neighbours, near duplicates, audio, mixing and the pipeline: brute force and edge cases."""

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairograph.llm import ann, audio, components, jaccard, mixing, packing
from kairograph.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
pt = pytest.importorskip("public_tokenizers")


def test_packing_is_exact_and_dense(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pd.DataFrame(r.asDict() for r in QUERIES["op1_best_fit_packing"](spark, SF).collect())
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    ids = {k: [*tok.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    want = {(k, p): (at, len(x[at : at + 4096]), zlib.crc32(np.array(x[at : at + 4096], "<u4").tobytes())) for k, x in ids.items() for p, at in enumerate(range(0, len(x), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows.itertuples()} == want and len(rows) == len(want)
    fill = 0
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all() and g.length.sum() <= 4096
        fill += 1
    assert fill <= 1.02 * -(-rows.length.sum() // 4096) + 1


def test_packing_of_odd_rows(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "word " * 9000), (5, "<|endoftext|> \x1c é")], "doc_id long, text string").withColumn("offset", F.lit("own")).repartition(5)
    rows = packing.pack_documents(d, pt.path("word_bpe_49k.json"), capacity=64, fan_in=2, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1] and sum(r.doc_id == 3 for r in rows) == 2
    assert sum(r.length for r in rows if r.doc_id == 4) == 9001 and len({r.sequence_id for r in rows}) <= 9001 // 64 + 2
    assert packing.pack_documents(d.limit(0), pt.path("word_bpe_49k.json")).count() == 0


def brute_nearest(ids, x, q, k=10):
    d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
    d[q] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[o]), d[o]) for o in order]


def test_neighbours_recall(spark):
    got = {}
    for r in QUERIES["op2_ann_search"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    hits = []
    for q in np.flatnonzero(ids % 100 == 0):
        want, mine = brute_nearest(ids, x, q), sorted(got[ids[q]])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and mine == [(k + 1, i, s) for k, (s, i) in enumerate(sorted((s, i) for _, i, s in mine))]
        hits.append(len({i for _, i, _ in mine} & {i for i, _ in want}))
    assert np.mean(hits) >= 9


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, -0.0]), (10, [1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("own"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest_neighbours(d, F.lit(True), k=3).collect()]
    assert sorted(x[1:] for x in got if x[0] == 0) == [(1, 1, 0.0), (2, 2, 0.0), (3, 9, 0.0)]
    assert sorted(x[1:] for x in got if x[0] == 8) == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]
    assert {x[0] for x in got} == {0, 1, 2, 8, 9}
    assert ann.nearest_neighbours(d.limit(0), F.lit(True)).count() == 0
    wide = spark.createDataFrame([(k, [float(x) for x in np.random.default_rng(k).normal(size=4) * 1e200]) for k in range(50)], "vec_id long, embedding array<double>")
    assert ann.nearest_neighbours(wide, F.col("vec_id") < 5, k=4).count() == 20


def test_many_equal_vectors_over_shards(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    rows = [(k, [float(v) for v in base[k % 40 if k % 3 else 0]]) for k in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    index = ann.build_index(d, keep=6, shard_nodes=10)
    assert index.count() >= 2 and index.agg(F.sum("nodes")).first()[0] == len({tuple(v) for _, v in rows})
    got = {}
    for r in ann.search_index(index, d.where("vec_id < 20"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    x = np.array([v for _, v in rows])
    for q in range(20):
        assert [i for _, i in sorted(got[q])] == [i for i, _ in brute_nearest(np.arange(300), x, q, 5)]


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            c = len(x & y)
            if x and y and den * c >= num * (len(x) + len(y) - c):
                old, new = max(label[ids[a]], label[ids[b]]), min(label[ids[a]], label[ids[b]])
                label = {i: new if v == old else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def near_copies(rng, groups=12):
    rows, vocabulary = [], [f"w{k}" for k in range(40)]
    for g in range(groups):
        text = list(rng.choice(vocabulary, rng.integers(1, 120)))
        for _ in range(rng.integers(1, 9)):
            copy = list(text)
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    return list(enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small):
    if small:  # every path for large families
        monkeypatch.setattr(jaccard, "SMALL_CELL", 3)
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 200)
    rows = near_copies(np.random.default_rng(5)) + [(1000, None), (1001, ""), (1002, "A b"), (1003, "a  B"), (1004, "x"), (1005, "word " * 30_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("own")).repartition(3)
    for sim in (jaccard.Similarity(3, 90, 100), jaccard.Similarity(5, 80, 100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(d, sim).collect()}
        assert got == brute_components(rows, sim.k, sim.num, sim.den)


def test_settled_and_redealt_sets_meet(spark, monkeypatch):
    """x and y become frequent only after the sets that hold f, g and h are dealt anew. The set of f
    has then moved x and y back; document 1, which round 1 left alone, must move them too."""
    monkeypatch.setattr(jaccard, "SMALL_CELL", 3)
    f, g, h, a, x, y = (c * n for c, n in zip("fghaxy", (40, 40, 40, 35, 30, 29)))  # long words come first
    common = [x, y, *("c" * n for n in range(22, 29))]
    rows = [(1, " ".join([a, *common])), (2, " ".join([f, *common]))]
    rows += [(k, " ".join([f, g, h, x, y, *(f"d{k}{j}" for j in range(5))])) for k in range(3, 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(d, jaccard.Similarity(1, 80, 100)).collect()}
    assert got == brute_components(rows, 1, 80, 100) and got[2] == (10, 1)


def test_frequent_tokens_of_two_rounds_lose_no_link(spark):
    """Two documents that share 18 of 20 shingles, with 70 others that make their long words frequent one after the other."""
    wa, wf, h = "a" * 20, "f" * 20, "h" * 10
    common = ["s" * 8 + str(k) for k in range(2, 5)] + [f"t{k}" for k in range(17)]
    rows = [(1000, " ".join([wa, *common])), (1001, " ".join([wf, *common]))]
    rows += [(k, " ".join([h, wf, *common[:3], *(f"o{k}x{j}" for j in range(16))])) for k in range(70)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for sim in (jaccard.Similarity(1, 90, 100), jaccard.Similarity(3, 90, 100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(d, sim).collect()}
        assert got == brute_components(rows, sim.k, sim.num, sim.den)


def test_clashing_class_keys_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "KEY_BITS", 4)
    rows = near_copies(np.random.default_rng(11))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(d, jaccard.Similarity(3, 90, 100)).collect()}
    assert got == brute_components(rows, 3, 90, 100)


def test_components_with_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_EDGES", 3)
    rng = np.random.default_rng(12)
    edges = [(7, k) for k in range(100, 140)] + [(k, k + 1) for k in range(200, 260)] + [(139, 230), (5, 5), (None, 3)] + [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(60)]
    label = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in label:
        for u, v in edges:
            if u in label and v in label and u != v:
                label[u] = label[v] = min(label[u], label[v])
    d = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.component for r in components.connected_components(d).collect()} == label
    with pytest.raises(RuntimeError):
        components.connected_components(d, max_rounds=1)


def test_near_duplicates_of_odd_rows(spark):
    d = spark.createDataFrame([(5, "a b c d"), (5, "x y z"), (6, "a b c d"), (7, "x y z"), (None, "a b c d"), (8, None)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(d, jaccard.Similarity(3, 90, 100)).collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (5, 5), (6, 5), (7, 5), (None, None), (8, 8)], key=str)
    kept = jaccard.keep_one_per_group(d, jaccard.Similarity(3, 90, 100))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [5, 8, None]
    assert jaccard.jaccard_components(d.limit(0)).count() == 0


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (np.unique(rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 300))) for _ in range(2))
        a = np.unique(np.concatenate([a, b[: rng.integers(0, len(b) + 1)]]))
        assert jaccard._most_common(jaccard.signature(a), len(a), jaccard.signature(b), len(b)) >= len(np.intersect1d(a, b))
        assert len(jaccard.unpacked_set(jaccard.packed_set(a))) == len(a)


def test_alignment_finds_shifted_noise(spark):
    rng = np.random.default_rng(7)
    song = [audio.tones_of_vector(rng.normal(0, 0.2, 64)) for _ in range(6)]
    cut = np.concatenate([song[5][: 7 * audio.HOP], song[0]]) + rng.normal(0, 0.05, len(song[0]) + 7 * audio.HOP)
    pcm = lambda x: (np.clip(x, -1, 1) * 30000).astype("<i2").tobytes()
    rows = [(k, pcm(s)) for k, s in enumerate(song)] + [(10, pcm(cut)), (11, pcm(song[1])), (12, None), (13, b"\0\0\0"), (None, pcm(song[2])), (14, b"\0" * 40000)]
    d = spark.createDataFrame(rows, "rec_id long, audio binary")
    prints = audio.fingerprint_recordings(d, id_col="rec_id", media_col="audio")
    got = {r.rec_id: r for r in audio.align_recordings(prints, F.col("rec_id").isin(0, 1), shard=3).collect()}
    assert got[10].query_id == 0 and got[10].offset == 7 and got[10].bit_error < 0.05 and got[10].n_links == 1
    assert got[11].class_id == 1 and got[1].class_id == 1 and got[11].n_links == 0
    assert got[3].n_links == 0 and got[12].n_ints == 0 and got[12].class_id is None and got[None].class_id == 2
    assert audio.align_recordings(prints.limit(0), F.lit(True)).count() == 0


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(8)
    prints = [rng.integers(0, 1 << 32, rng.integers(20, 60), dtype=np.uint32) for _ in range(30)]
    prints += [np.concatenate([rng.integers(0, 1 << 32, k, dtype=np.uint32), prints[k]]) for k in range(8)]
    got = {(r, o) for r, o, _ in audio.Shard(prints).aligned(prints[3])}
    want = set()
    for r, p in enumerate(prints):
        votes = {}
        for i, a in enumerate(p):
            for j, b in enumerate(prints[3]):
                if a >> 12 == b >> 12:
                    votes[i - j] = votes.get(i - j, 0) + 1
        if votes and max(votes.values()) >= audio.MIN_VOTES:
            o = min(votes, key=lambda k: (-votes[k], k))
            bits, n = audio._errors(p, prints[3], o)
            if n >= audio.MIN_OVERLAP and bits <= audio.MAX_ERROR * 32 * n:
                want.add((r, o))
    assert got == want and (33, 3) in got


def test_packed_integers_match_plain_sums():
    rng = np.random.default_rng(10)
    image = rng.random((40, 12)).astype(np.float32)
    got = audio.packed(image)
    for place in (0, 3, 24):
        want = 0
        for kind, y, h, w in audio.FILTERS:
            first, second = (sum(float(image[place + a : place + b, c:d].astype(float).sum()) for a, c, b, d in part) for part in audio._halves(kind, y, h, w))
            value = np.log1p(round(first, 6)) - np.log1p(round(second, 6))
            want = want << 2 | int(audio.GRAY[sum(round(value, 6) >= c for c in audio.CUTS)])
        assert int(got[place]) == want
    assert len(got) == 40 - audio.SPAN + 1 and not len(audio.packed(image[: audio.SPAN - 1]))


def test_alignment_query_matches_brute_force(spark):
    """Every recording of the smallest tables with every fiftieth one, over one shard and over many."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    prints = audio.fingerprint_recordings(rows, id_col="vec_id", media_col="embedding", decode=audio.tones_of_vector)
    raw = {r.rec_id: np.frombuffer(r.fingerprint, "<u4") for r in prints.collect()}
    want = {}
    for i, p in raw.items():
        hits = []
        for q in sorted(raw):
            if q % 50 == 0 and not np.array_equal(raw[q], p):
                hits += [(e, q, o) for _, o, e in audio.Shard([p]).aligned(raw[q])]
        want[i] = (len(hits), *(min(hits)[1:] if hits else (None, None)))
    for shard in (None, 7):
        got = {r.rec_id: (r.n_links, r.query_id, r.offset) for r in audio.align_recordings(prints, F.col("rec_id") % 50 == 0, shard=shard).collect()}
        assert got == want


def test_fingerprint_query_keeps_all_rows(spark):
    assert QUERIES["op9_media_fingerprints"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()


def test_mixing_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    r = con.execute(ORACLE["op10_mixing"])
    names = [c[0] for c in r.description]
    want = sorted(map(repr, ([row[names.index(c)] for c in ("doc_id", "n_tokens", "topic", "weight", "probability", "selected")] for row in r.fetchall())))
    got = QUERIES["op10_mixing"](spark, SF).select("doc_id", "n_tokens", "topic", "weight", "probability", "selected").collect()
    assert sorted(repr(list(x)) for x in got) == want


def test_raking_meets_targets_and_tokens(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    margins = {"source": (F.col("source"), lambda s: s**0.5), "lang": (F.col("lang"), {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1})}
    out = mixing.mix_to_targets(docs, margins, tokens=mixing.word_tokens(F.col("text")), fraction=0.4)
    cells = out.groupBy("mix_source", "mix_lang").agg(F.first("weight").alias("w"), F.sum("n_tokens").alias("n"), F.first("probability").alias("p")).toPandas()
    by = cells.groupby("mix_lang").w.sum()
    assert abs(by["en"] - 0.4) < 1e-6 and abs(by["es"] - 0.1) < 1e-6 and abs(cells.w.sum() - 1) < 1e-9
    own = cells.groupby("mix_source").n.sum() / cells.n.sum()
    want = own**0.5 / (own**0.5).sum()
    assert np.allclose(cells.groupby("mix_source").w.sum(), want, atol=1e-3)
    assert abs((cells.n * cells.p).sum() / cells.n.sum() - 0.4) < 1e-9
    spread = mixing.mix_to_targets(docs, margins, tokens=mixing.word_tokens(F.col("text")), fraction=0.4, max_cells=0)
    a, b = (x.select("doc_id", F.round("probability", 6)).orderBy("doc_id").collect() for x in (out, spread))
    assert a == b


def test_mixing_of_odd_rows(spark):
    d = spark.createDataFrame([(1, None, None, None), (2, "a b", "s", None), (2, "a b", "s", None), (None, "c", None, "en")], "doc_id long, text string, source string, lang string").withColumn("weight", F.lit("own"))
    rows = mixing.mix_to_targets(d, mixing.document_margins(), tokens=mixing.word_tokens(F.col("text")), fraction=1.0).collect()
    assert len(rows) == 4 and all(r.probability == 1 and r.selected for r in rows) and sorted(r.n_tokens for r in rows) == [1, 2, 3, 3]
    assert mixing.keep_mixed(d).columns == d.columns
    assert mixing.keep_mixed(d.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, a clashing extra column and an empty table pass every stage."""
    import corpus_pipeline as cp
    from kairograph.llm.common import materialize

    some = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", None, 0), (None, "no id but words here", "en", "web", 20), (9003, "12 34", None, "web", 5), (9003, "12 34", None, "web", 5), (9004, "word " * 60_000, "en", "web", 300_000)], some.schema)
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (some.unionByName(odd).withColumn("score", F.lit("own")), some.limit(0)):
        now = materialize(docs)
        for name, stage in cp.STAGES:
            now = materialize(stage(spark, now, str(tmp_path)))
            if name != "packing":
                assert now.columns == docs.columns
        if not docs.limit(1).count():
            assert now.count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp
    from kairograph.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, now = [], docs
    for _, stage in cp.STAGES[:-1]:
        now = materialize(stage(spark, now, SF))
        assert now.columns == docs.columns
        steps.append({r.doc_id: r.text for r in now.select("doc_id", "text").collect()})
    for before, after in zip([{r.doc_id: r.text for r in docs.collect()}, *steps], steps):
        assert after.items() <= before.items() and len(after) >= 0.6 * len(before)
    want = brute_components(list(steps[1].items()), 5, 80, 100)
    assert set(steps[2]) == {i for i, (_, c) in want.items() if c == i}
    packed = cp.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(steps[3])
