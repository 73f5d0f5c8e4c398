"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kairograph.llm import spelling
from kairograph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = {i: i + 32 for i in range(65, 91)}


def brute_words(docs, drop=97):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return n


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(n):
    holes = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k] + "*" + w[k + 1 :]].add(w)
            holes[w[:k] + w[k + 1 :]].add(w)
        holes[w].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and one_edit(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def as_dict(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = {w: k for w, k in brute_words(docs).items() if len(w) >= 5 and k >= 3}
    got = as_dict(QUERIES["op13_spelling_variants"](spark, SF))
    assert got == brute_groups(n) and any(f for f, *_ in got.values())


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.text("abeéÀz", min_size=1, max_size=6), st.integers(1, 40), max_size=60))
def test_all_edits_are_found(spark, n):
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_dict(spelling.group_spellings(words)) == brute_groups(n)


def test_letters_beyond_the_table_share_bits(spark):
    n = {"жук": 9, "жак": 2, "жуки": 3, "\U0001f600a": 4, "\U0001f601a": 1, "a": 1, "é": 5}
    assert as_dict(spelling.group_spellings(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute_groups(n)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 ..."), (None, "Colour colour COLOUR color"), (4, "color color"), (4, "color color"), (5, "x" * 300_000), (6, "grüße " * 60_000 + "grüsse grusse")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("own")).withColumn("n", F.lit(1)).repartition(3)
    got = as_dict(spelling.spelling_variants(docs, min_count=1))
    assert got.pop("x" * 300_000) == (None, "x" * 300_000, 1, 0, None)
    assert got == brute_groups({w: k for w, k in brute_words(rows, None).items() if 5 <= len(w) < 99})
    assert got["colour"][:2] == (None, "colour") and got["color"][3] == 1
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
