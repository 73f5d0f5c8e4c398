"""Classifiers, language model and page text: held-out accuracy, brute force and edge cases."""

import dataclasses
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairograph.llm import html_text as ht
from kairograph.llm import langid as li
from kairograph.llm import lm
from kairograph.llm import quality as qu
from kairograph.llm import toxicity as to
from kairograph.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LONG = "word " * 60_000
ODD = [(1, None, None), (2, "", "en"), (3, "  \n ", None), (4, "12 34 !?", "en"), (5, LONG, "en"), (6, "the same text", "en"), (6, "the same text", "en"), (None, "no id", "fr"), (7, "漢字 \x00 é", None)]
FORM = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, FORM).withColumn("score", F.lit("own")).withColumn("predicted", F.lit("own"))


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_quality_held_out(spark, labelled):
    got = QUERIES["op5_quality_classifier"](spark, SF).toPandas().set_index("doc_id")
    want = labelled[1].groupBy("doc_id").agg(F.max("quality").alias("y")).toPandas().set_index("doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(got.held_out[i] == held(i, 3, 1) for i in got.index)
    x = got[got.held_out].join(want, how="inner")
    assert (x.predicted == x.y).mean() >= 0.95


def test_language_held_out(spark, labelled):
    got = QUERIES["op6_language_id"](spark, SF).toPandas().set_index("doc_id").join(labelled[0].select("doc_id", "lang").toPandas().set_index("doc_id"))
    x = got[got.held_out & got.lang.notna()]
    assert len(got) == 1000 and (x.lang == x.lang_pred).mean() >= 0.97


def test_quality_of_odd_rows(spark, labelled, odd):
    model = qu.train_quality(*labelled)
    rows = qu.score_quality(odd, model).select("doc_id", "score", "predicted").collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert math.isclose(next(r.score for r in rows if r.doc_id == 2), model.prior)
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    assert qu.score_quality(odd.limit(0), model).count() == 0
    none = qu.train_quality(labelled[0], labelled[1].limit(0))
    assert {r.score for r in qu.score_quality(odd, none).collect()} == {0.5}
    kept = qu.keep_good(odd, labelled[1])
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} <= {"own"}


def test_language_of_odd_rows(spark, labelled, odd):
    model = li.train_language(labelled[0])
    rows = li.predict_language(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert {r.lang_pred for r in rows if r.doc_id == 6} <= set(model.langs)
    assert li.train_language(labelled[0].where("lang IS NULL")) is None
    assert {r.lang_pred for r in li.predict_language(odd, None).collect()} == {"und"}


def test_language_weights_are_sparse_and_pieces_agree(labelled):
    pdf = labelled[0].where("lang IS NOT NULL AND length(text) > 0").limit(300).toPandas()
    model = li.fit_language(list(pdf.text), list(pdf.lang))
    assert (model.weights == 0).mean() > 0.5
    texts = ["abc def", "", "über alles " * 50, "x"]
    whole = li.logits(texts, model)
    old, li.PIECE = li.PIECE, 7
    try:
        assert np.allclose(li.logits(texts, model), whole, atol=1e-4)
    finally:
        li.PIECE = old


def test_toxicity_gradient_matches_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in to._start(rng).items()}
    rows, place, at = to.words_of(["you bad bad thing", "a nice day"])
    win, _ = to.windows_of(place, at, len(rows))
    x, words = to._inputs(rows, p)
    score, state = to._forward(x.astype(np.float64), win, p, keep=True)
    g = to._backward(np.ones(len(win)), x.astype(np.float64), win, p, state, words)
    for name, index in (("out", 2), ("attv", 1), ("uf", (3, 5)), ("wb", (2, 7)), ("bf", 4)):
        values = []
        for e in (1e-3, -1e-3):
            q = {k: v.copy() for k, v in p.items()}
            q[name][index] += e
            values.append(to._forward(to._inputs(rows, q)[0].astype(np.float64), win, q)[0].sum())
        assert math.isclose((values[0] - values[1]) / 2e-3, float(g[name][index]), rel_tol=0.02, abs_tol=2e-3)


def test_toxicity_learns_and_generalises():
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(list("bdgklmnprst")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(300)]
    bad = ["scumbag", "moronic", "idiotic", "trashy"]

    def text(toxic, size):
        words = list(rng.choice(clean, size))
        for _ in range(3 * toxic):
            words[rng.integers(size)] = rng.choice(bad)
        return " ".join(words)

    y = np.arange(700) % 4 == 0
    model = to.fit_toxicity(pd.DataFrame({"text": [text(t, 40 + k % 80) for k, t in enumerate(y)], "label": y.astype(int)}))
    new = [text(k % 2, 50 + k) for k in range(200)]
    z = model.slope * to.text_logits(new, model.params) + model.bias
    assert model.slope > 0 and ((z >= 0) == (np.arange(200) % 2 == 1)).mean() > 0.95


def test_toxicity_query_held_out(spark):
    big = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, big).toPandas().set_index("doc_id")
    want = spark.read.parquet(f"{big}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("y")).toPandas().set_index("doc_id")
    assert len(got) == 10_000 and all(got.held_out[i] == held(i, 5, 0) for i in got.index) and (got.predicted == (got.score >= 0.5)).all()
    x = got[got.held_out].join(want, how="inner")
    toxic = x[x.y == 1]
    assert (x.predicted == x.y).mean() >= 0.95 and toxic.predicted.mean() >= 0.6


def test_fits_do_not_depend_on_the_deal(spark, labelled):
    docs, labels = labelled
    for fit in (lambda d: qu.train_quality(d, labels, fit_rows=200).good, lambda d: li.train_language(d, fit_rows=200).weights.tobytes(), lambda d: to.train_toxicity(d, labels, fit_rows=60).params["out"].tobytes()):
        assert fit(docs.repartition(1)) == fit(docs.repartition(50))


def test_long_texts_are_learned_in_pieces(spark):
    from kairograph.llm.sampling import excerpt, sample_by_class

    d = spark.createDataFrame([(1, "short"), (2, "a" * 500 + "z" * 500)], "id long, text string")
    a, b = (r.t for r in d.select(excerpt(F.col("text"), 80).alias("t")).collect())
    assert a == "short" and b == "\n".join(["a" * 10] * 4 + ["z" * 10] * 4)
    with pytest.raises(ValueError):
        sample_by_class(d, "id", "text", 5, max_classes=1)


def test_toxicity_calibration_keeps_the_order():
    z, y = np.array([1e-4, 2e-4, 3e-4, 5.0, 6.0, 900.0]), np.array([0, 0, 0, 1, 1, 1.0])
    slope, bias = to._calibration(z, y)
    assert slope > 0 and np.isfinite(bias)


def test_toxicity_of_odd_rows(spark, odd):
    p = to.ToxicityModel(to._start(np.random.default_rng(0)))
    rows = to.score_toxicity(odd, p).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 4))
    assert to.score_toxicity(odd.limit(0), p).count() == 0
    no = to.fit_toxicity(pd.DataFrame({"text": ["a"], "label": [0]}))
    assert no.slope == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("head", [1_000_000, 5])
def test_lm_base_matches_brute_force(spark, head):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "B", "cc", "Dd", "é", "x" * 40], rng.integers(0, 30))) for _ in range(60)] + [None, "", "\tNew words\x0bhere ", "a a"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "a b"), (3, "a")], "doc_id long, text string")
    train = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) != 0
    got = lm.score_texts(docs.withColumns({"score": F.lit("own"), "key": F.lit("own"), "block": F.lit("own")}), train=train, head_words=head, head_begun=head).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    count = Counter()
    for i, t in rows:
        if (i or 0) % 3:
            count.update([*words(t), 0])
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), 0]), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), 0]), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)


def toy_model(seed=4):
    """Random counters and weights over bytes 1 to 63 as symbols, three known begun words."""
    rng = np.random.default_rng(seed)
    n = int(lm.FIRST[-1])
    symbol = (np.arange(256) % 64).astype(np.uint8)
    m = lm.MixingModel(symbol, np.full(256, -2.0), rng.integers(-60, 60, n * 64).astype(np.int8), rng.integers(0, 4, n).astype(np.uint8), rng.normal(0.3, 0.2, (lm.GATES, lm.INPUTS)).astype(np.float32))
    words = [b"abcd", b"abce", b"xyz"]
    matrix = np.array([list(w.ljust(17, b"\0")) for w in words], np.uint8)
    keys = np.unique(np.concatenate([k for _, _, k in lm.begun_keys(matrix, (matrix != 0).sum(1))]).view(np.int64))
    known = lm.Begun(keys, np.full(len(keys), 2), (rng.integers(1, 9, 2 * len(keys)) * 64 + rng.integers(1, 60, 2 * len(keys))).astype(np.int64))
    return m, known


def one_window(raw: bytes, m):
    data = np.frombuffer(raw + b"\0", np.uint8)
    (w,) = lm.stretches_of(data, np.array([0, len(data)]), m.symbol)
    return w


def test_lm_probabilities_of_a_symbol_sum_to_one(monkeypatch):
    """The 64 symbols that may follow a prefix, the end included, have probabilities that sum to 1, also where a passage foretells one."""
    monkeypatch.setattr(lm, "ONE_IN", 1)
    m, known = toy_model()
    start = b"\x01\x02abcd xyz abcd "
    _, key = lm.looked_up(one_window(start, m))
    for said in (b"abce xy", b"xyz"):
        passages = {int(k): (3, said) for k in key}
        for prefix in (b"", b"abc", start, start + said[:2], start + b"q"):
            def logs(raw, size):
                w = one_window(raw, m)
                w.size = np.array([size])
                return lm.code_online(*lm.predictions(w, m, known, passages, np.zeros(1, bool)), w, m.weights, 0.02)[0][0]

            after = [logs(prefix + bytes([k]), len(prefix) + 1) for k in range(1, 64)] + [logs(prefix, len(prefix) + 1)]
            assert math.isclose(np.exp(after).sum(), np.exp(logs(prefix, len(prefix))), rel_tol=1e-4)


def test_lm_matches_a_plain_mixer():
    m, known = toy_model(5)
    text = "abcd abce xyz abc xyzabcd " * 60
    got, size = lm.text_scores([text], np.zeros(1, bool), m, known, {}, 0.01)
    data, _ = lm.plain_bytes([text])
    s, total, raw = m.symbol[data].astype(int), 0.0, bytes(data)
    s[-1] = 0
    w = one_window(raw[:-1], m)
    ctx, (place, key) = lm.table_contexts(w), lm.begun_words(w)
    row = dict(zip(place.tolist(), known.find(key).tolist()))
    for i, sym in enumerate(s):
        if i % lm.STRETCH == 0:
            weights = m.weights.astype(float).copy()
        r, node = row.get(i, 0), 1
        for depth in range(lm.BITS):
            bit = sym >> (5 - depth) & 1
            x = np.array([*(m.odds[c[i] * 64 + node] for c in ctx), known.odds[r * 64 + node], 0]) / 16
            g = (int(known.sure[r]) * 2 + int(m.sure[ctx[-1][i]] >= 2)) * lm.BITS + depth
            p = 1 / (1 + math.exp(-float(weights[g] @ x)))
            total += math.log10(p if bit else 1 - p)
            weights[g] += 0.01 * (bit - p) * x
            node = node * 2 + bit
    assert size[0] == len(s) and math.isclose(got[0], total, rel_tol=1e-4)


def test_lm_windows_do_not_matter(monkeypatch):
    m, known = toy_model(6)
    texts = ["abcd xyz " * 700, "", "abce " * 300, "x" * 3000]
    whole, _ = lm.text_scores(texts, np.ones(4, bool), m, known, {})
    monkeypatch.setattr(lm, "WINDOW", 1500)
    assert np.allclose(lm.text_scores(texts, np.ones(4, bool), m, known, {})[0], whole)


def test_lm_does_not_depend_on_the_deal_and_tells_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    twice = docs.where("doc_id % 5 = 0 AND length(text) > 500").withColumn("doc_id", F.col("doc_id") + 100_000)
    docs, train = docs.unionByName(twice), F.col("doc_id") % 10 != 3
    one, many = ({r.doc_id: r for r in lm.score_texts(docs.repartition(k), train=train).collect()} for k in (1, 7))
    assert one.keys() == many.keys()
    assert all(math.isclose(one[i].score, many[i].score, rel_tol=1e-6) and one[i].base_score == pytest.approx(many[i].base_score) for i in one)
    copied = [i for i in one if i % 5 == 0 and i + 100_000 in one]
    single = [i for i in one if i % 5 and one[i].n_tokens > 80]
    assert np.median([one[i].bits_per_byte for i in copied]) < 0.9 * np.median([one[i].bits_per_byte for i in single])


def test_lm_query_beats_the_base(spark):
    got = QUERIES["op8_lm_scoring"](spark, SF).toPandas()
    new = got[got.held_out]
    assert len(got) == 1000 and new.score.sum() > new.base_score.sum() and got.bits_per_byte.between(0, 20).all()


def test_lm_slopes_match_differences():
    """Slopes and curvatures of the log-probability at fixed weights, against differences of what is coded without moving them."""
    m, known = toy_model(7)
    texts, train = ["abcd xyz abce " * 200, "xyz", ""], np.ones(3, bool)
    slope, bend = lm.weight_slopes(texts, m, known, {})
    total = lambda w: lm.text_scores(texts, train, dataclasses.replace(m, weights=w.astype(np.float32)), known, {}, 0.0)[0].sum() * lm.LN10
    for g in np.argsort(-np.abs(slope).sum(1))[:4]:
        step = np.zeros_like(m.weights)
        step[g] = 0.02 * np.array([1.0, -0.5, 0.7, 0.0])
        up, mid, down = total(m.weights + step), total(m.weights), total(m.weights - step)
        assert math.isclose(up - down, 2 * slope[g] @ step[g], rel_tol=2e-2, abs_tol=2e-2)
        assert math.isclose(2 * mid - up - down, step[g] @ bend[g] @ step[g], rel_tol=0.1, abs_tol=2e-2)


def test_lm_symbol_paths_match_nodes():
    rng = np.random.default_rng(3)
    odds, seen, symbol = rng.integers(-127, 128, 6400).astype(np.int8), rng.integers(0, 200, 6400).astype(np.uint8), np.arange(64)
    for visits in (None, seen):
        got, node = lm.symbol_paths(odds, visits).view(np.int8).reshape(100, 64, 8), np.ones(64, np.int64)
        for depth in range(lm.BITS):
            bit = symbol >> (5 - depth) & 1
            for c in (0, 57, 99):
                assert (got[c, :, depth] == lm._log_odds(odds, visits, c * 64 + node, bit) * (2 * bit - 1)).all()
            node = node * 2 + bit


def test_lm_all_training_texts_teach(spark, monkeypatch):
    """Every training text teaches the starting weights once, in one of two rounds, and no held-out one does."""
    docs, kept = spark.createDataFrame([(i, f"text number {i} of some") for i in range(200)], "doc_id long, text string"), spark.sparkContext.accumulator(0)
    teach = lm._teach

    def counted(*shared):
        run = teach(*shared)

        def body(key, texts, found):
            kept.add(sum(int(x.split()[2]) for x in texts["text"]))
            return run(key, texts, found)

        return body

    monkeypatch.setattr(lm, "_teach", counted)
    lm.score_texts(docs, train=F.col("doc_id") % 10 != 0, teach=8)
    assert kept.value == sum(i for i in range(200) if i % 10)


def test_lm_broadcasts_are_small(spark, monkeypatch):
    """What all broadcasts of a run take on disk, on each executor again: tables of mostly empty counters travel compressed, and once for both rounds of lessons."""
    import os

    sizes, send = [], spark.sparkContext.broadcast

    def measured(value):
        sizes.append(send(value))
        sizes[-1] = sizes[-1], os.path.getsize(sizes[-1]._path)
        return sizes[-1][0]

    monkeypatch.setattr(spark.sparkContext, "broadcast", measured)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert lm.score_texts(docs, train=F.col("doc_id") % 10 != 0).count() == docs.count()
    assert sum(n for _, n in sizes) < 8e6


def test_lm_words_hash_as_elsewhere(monkeypatch):
    from kairograph.llm.common import word_hashes

    monkeypatch.setattr(lm, "HASH_BYTES", 64)
    texts = ["  Ab \t\n c ", "", None, " ", "x", "\u00c9 a", "a\0b \0 c\0", "Z" * 500 + " q", " ".join(f"w{i % 37}" for i in range(300))]
    for some in (texts, texts[::-1], [""], []):
        (h, size, cut), got = word_hashes(some), lm.plain_words(*lm.plain_bytes(some))
        assert (h == got[0]).all() and (size == got[2] - got[1]).all() and (cut == got[3]).all()


def test_lm_keys_that_share_a_slot():
    keys = np.arange(1, 9, dtype=np.int64) << 40
    assert lm.Keys(keys).find(np.append(keys, [9 << 40, 5])).tolist() == [*range(1, 9), 0, 0]
    assert lm.Keys(keys[:0]).find(keys).tolist() == [0] * 8


def test_lm_plain_bytes():
    data, starts = lm.plain_bytes(["  Ab \t\n c ", "", None, " ", "x", "É a"])
    assert bytes(data) == b"ab c\0\0\0\0x\0" + "É a".encode() + b"\0" and starts.tolist() == [0, 5, 6, 7, 8, 10, 15]


def test_lm_without_training_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm.score_texts(d, train=F.lit(False)).collect()
    assert {r.n_known for r in rows} == {0} and len(rows) == 2
    assert lm.score_texts(d.limit(0), train=F.lit(True)).count() == 0


PAGE = """<html><head><title>t</title><style>p {}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div class="content"><article><h1>Head&shy;line &amp; more</h1><p>First   paragraph with <b>bold</b>
text that is long enough.</p><p>Short.</p><script>var x = 1;</script><ul><li>One item</li><li>Two</li></ul></article></div>
<div class="comments"><p>A reader writes a very long comment about all of this, longer than the text.</p></div><aside class=sidebar>Side</aside><footer>Foot</footer></body></html>"""


def test_main_text():
    assert ht.main_text(PAGE) == "Head­line & more\nFirst paragraph with bold text that is long enough.\nShort.\nOne item\nTwo"
    bare = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert ht.main_text(bare) == ht.main_text(PAGE)


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "post with-comments", "ad-free", "search-result", "social-story"])
def test_class_words_do_not_drop_the_article(name):
    paragraphs = [f"Paragraph {k} of the story has enough words to stand above what surrounds it on the page." for k in range(4)]
    story = "".join(f"<p>{p}</p>" for p in paragraphs)
    side = "<div class=sidebar><p>Side words</p></div>"
    for tag in ("div", "article"):
        assert ht.main_text(f"<body><nav><a href=x>Menu</a></nav><{tag} class='{name}'>{story}{side}</{tag}></body>") == "\n".join(paragraphs)
    parts = "".join(f"<article class='{name}' id=n{k}><p>{p}</p></article>" for k, p in enumerate(paragraphs))
    assert ht.main_text(f"<body>{parts}{side}</body>") == "\n".join(paragraphs)


def test_article_elements_are_selected_by_ratio():
    paragraphs = [f"Paragraph {k} of the story has enough words to stand above what surrounds it, and then some more words." for k in range(8)]
    cards = "".join(f"<article><h3><a href=x>Card {k}</a></h3><p>Teaser {k}</p></article>" for k in range(5))
    page = "<body><main><h1>Title</h1><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</article></main>{cards}</body>"
    assert ht.main_text(page).split("\n")[-8:] == paragraphs and "Teaser" not in ht.main_text(page)
    outside = "<body><article><p>Teaser</p></article><div>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div></body>"
    assert ht.main_text(outside).endswith("\n".join(paragraphs))


def test_ratios_decide_the_regions(monkeypatch):
    """Without article elements or class words the ratios choose; with constant ratios the page comes out wrong."""
    words = "Paragraph {} of the story has enough words to stand above what surrounds it on the page."
    story = [words.format(k) for k in range(5)]
    links = "".join(f"<p><i><b>Item</b></i> <a href=x>{k} more of this</a> <i>-</i></p>" for k in range(12))
    page = f"<body><div>{links}</div><div>" + "".join(f"<p>{p}</p>" for p in story[:2]) + "<p>Short one.</p>" + "".join(f"<p>{p}</p>" for p in story[2:]) + f"</div><div class='content'>{links}</div></body>"
    want = "\n".join([*story[:2], "Short one.", *story[2:]])
    assert ht.main_text(page) == want
    marked = page.replace("<div>", "<div class='ad-free header'>", 1)  # misleading names elsewhere change nothing
    assert ht.main_text(marked) == want
    monkeypatch.setattr(ht, "raw_ratios", lambda lines: np.ones(len(lines)))
    assert ht.main_text(page) != want


def test_smoothing_and_clusters_match_brute_force():
    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 40):
        x = rng.exponential(10, n)
        reach = min(n, int(3 * ht.SIGMA))
        g = {d: math.exp(-0.5 * (d / ht.SIGMA) ** 2) for d in range(-reach, reach + 1)}
        want = [sum(x[i + d] * w for d, w in g.items() if 0 <= i + d < n) / sum(g.values()) for i in range(n)]
        assert np.allclose(ht.smoothed_ratios(x), want)
        low, high = min(want), max(want)
        for _ in range(50):
            a, b = [v for v in want if v <= (low + high) / 2], [v for v in want if v > (low + high) / 2]
            low, high = sum(a) / len(a) if a else low, sum(b) / len(b) if b else high
        assert math.isclose(ht.threshold_of(np.array(want)), (low + high) / 2, rel_tol=1e-9)


@pytest.mark.parametrize("html", ["<b>x " * 16_000 + "</i>" * 16_000, "<div>" * 16_000 + "deep", "<p><b>x " * 16_000, "x " * 500_000])
def test_main_text_of_deep_and_long_pages(html):
    began = time.process_time()
    assert isinstance(ht.main_text(html), str) and time.process_time() - began < 3


@pytest.mark.parametrize("html", [None, "", "<", "<p", "</div></div>", "<script>x", "<!-- a", "&#xD800;&bogus;", "<nav>only</nav>", "\x00"])
def test_main_text_of_odd_pages(html):
    assert isinstance(ht.main_text(html), str)


def test_pages_keep_rows(spark):
    d = spark.createDataFrame([(1, PAGE, "own"), (1, PAGE, "own"), (2, None, None)], "page_id long, html string, text string")
    rows = ht.extract_main_text(d).collect()
    assert len(rows) == 3 and all(r.n_chars == len(r.text) for r in rows) and rows[2].text == ""
    assert ht.extract_main_text(d.limit(0)).count() == 0


STORY = [f"Paragraph {k} of the article tells at some length what happened and why it matters to all of us." for k in range(3)]
TALK = [f"Reader {k} thinks that this is quite right and says so in a rather long comment under the text." for k in range(12)]


@pytest.mark.parametrize("tag", ["article", "div", "section"])
@pytest.mark.parametrize("name", ["comments", "comment-list", "disqus_thread"])
def test_comments_longer_than_the_article(tag, name):
    page = f"<body><nav><a href=a>Home</a></nav><{tag}><h1>Title here</h1>{''.join(f'<p>{p}</p>' for p in STORY)}</{tag}><div class={name}>{''.join(f'<p>{c}</p>' for c in TALK)}</div></body>"
    assert ht.main_text(page) == "\n".join(["Title here", *STORY])
    inside = f"<body><{tag}>{''.join(f'<p>{p}</p>' for p in STORY)}<div class={name}>{''.join(f'<div><p>{c}</p></div>' for c in TALK)}</div></{tag}></body>"
    assert ht.main_text(inside) == "\n".join(STORY)


def test_names_that_frame_the_article_are_released():
    body = "".join(f"<p>{p}</p>" for p in STORY * 4)
    assert ht.main_text(f"<body><div class=menu><a href=a>Home</a></div><div class=page-with-sidebar>{body}</div><div class=bottom>Contact</div></body>") == "\n".join(STORY * 4)
    # where all text is comments, a page of comments is what there is
    assert ht.main_text(f"<body><div class=comments>{body}</div></body>") == "\n".join(STORY * 4)


def test_titles_and_endings_in_siblings():
    body = "".join(f"<p>{p}</p>" for p in STORY)
    links = "<div><a href=a>One</a> <a href=b>Two</a></div>"
    page = f"<body>{links}<div class=h><h1>The title</h1></div><div>{body}</div><div>That is all.</div><div>&copy; 2024 The paper.</div></body>"
    assert ht.main_text(page) == "\n".join(["The title", *STORY, "That is all."])
    lead = f"<body>{links}<div><h1>The title</h1><p>By a writer</p></div><div>{body}</div><div><h2>More</h2></div>{links}</body>"
    assert ht.main_text(lead) == "\n".join(["The title", "By a writer", *STORY])


def test_ratios_decide_where_names_are_absent(monkeypatch):
    """The given pages without their class names and marking elements."""
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    bare = [re.sub(r"<(/?)(nav|footer|header|aside|article|main|form)\b[^>]*>", r"<\1div>", re.sub(r' (class|id|role)="[^"]*"', "", h)) for h in pages if h]
    own = [ht.main_text(h) for h in bare]
    monkeypatch.setattr(ht, "smoothed_ratios", lambda ratio: np.ones(len(ratio)))
    assert np.mean([a != ht.main_text(h) for a, h in zip(own, bare)]) > 0.5


def test_lm_words_tell_of_all_their_begun_parts():
    """Whole words give each symbol the paths that their begun parts give as contexts of their own, texts' ends, words only
    used and a byte 0 included; so does every confidence."""
    rng = np.random.default_rng(12)
    pool = ["".join(rng.choice(list("abé"), rng.integers(1, 20))) for _ in range(300)] + ["ab\0a", "aba\0", "abab\xff"]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(40)] + ["", "abab", "baba ab", "a" * 16, "a" * 17]
    data, starts = lm.plain_bytes(texts)
    symbol, _ = lm.choose_symbols(np.bincount(data, minlength=256))
    symbol[0] = symbol[255]
    key, n, heads = lm.distinct_words(data, starts)
    n = np.where(rng.random(len(n)) < 0.8, n, 0)  # some are only used
    length = (heads != 0).sum(1)
    cells = Counter()
    for size, rows, k in lm.begun_keys(heads, length):
        follows = np.where(length[rows] > size, heads[rows, np.minimum(size, 16)], 32)
        for a, b, c in zip(k.view(np.int64).tolist(), symbol[follows].tolist(), n[rows].tolist()):
            cells[a, b] += c
    keys = sorted({a for a, _ in cells})
    flat = {k: [64 * c + b for (a, b), c in cells.items() if a == k and c] for k in keys}
    row, size, *told = lm.words_told(heads, n, symbol)
    start = np.cumsum(size) - size + 1
    (w,) = lm.stretches_of(data, starts, symbol)
    for learning, lanes in zip((True, False), told):
        plain = lm.Begun(np.array(keys), np.array([len(flat[k]) for k in keys]), np.array([x for k in keys for x in flat[k]], np.int64), learning)
        whole = lm.Told([])
        whole.keys, whole.n, whole.start = lm.Keys(key), np.append(0, n), np.append(1, start[row]).astype(np.int32)
        lanes = np.concatenate([np.zeros((1, 8), np.int8), lanes])
        whole.sure = lanes[:, 6].astype(np.uint8)
        whole.paths = np.where(np.arange(8) == 6, np.int8(0), lanes).view(np.int64)[:, 0]
        (at, sure), known = plain.contexts(w), lm.BegunWords(lm.Told([]), whole).over(data, starts)
        own, own_sure = known.contexts(w)
        a, b = plain.paths[at].view(np.int8).reshape(-1, 8).astype(int), known.paths[own].view(np.int8).reshape(-1, 8).astype(int)
        inner = (data != 0) | np.isin(np.arange(len(data)), starts[1:] - 1)
        clean = ~np.isin(w.text[np.searchsorted(w.start, np.arange(len(data)), "right") - 1], [i for i, t in enumerate(texts) if "\0" in t])  # the plain form ends a word there
        seen = (at >= 64) & inner & clean
        assert seen.sum() > 1000 and (sure[seen] == own_sure[seen]).all()
        assert np.abs(a - b)[seen].max() <= (6 if learning else 0)  # the plain form takes the own visit out of rounded counts
        assert (own[(at < 64) & clean] == 0).all()


def test_lm_no_begun_word_is_left_out(spark):
    """Scores don't depend on how many words are broadcast: those of the others reach the blocks that hold them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    few, all_ = ({r.doc_id: r for r in lm.score_texts(docs, train=F.col("doc_id") % 10 != 0, head_words=k, head_begun=k).collect()} for k in (5, 1_000_000))
    assert few.keys() == all_.keys()
    assert all(math.isclose(few[i].score, all_[i].score, rel_tol=1e-6) and few[i].n_known == all_[i].n_known and math.isclose(few[i].base_score, all_[i].base_score, rel_tol=1e-9) for i in few)
