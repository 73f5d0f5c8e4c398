"""The golden toy graph: history, as-of counts, supplements, ranks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kairograph.operators import facts as fa
from kairograph.operators import history as hi
from kairograph.operators import ranking as rk
from kairograph.operators import snapshots as sn

TOY = [(0, 0, 1, 0), (1, 1, 2, 0), (0, 0, 1, 1), (0, 0, 2, 1), (2, 1, 0, 1), (3, 0, 1, 2), (0, 1, 3, 2), (1, 0, 2, 3), (4, 1, 3, 2), (3, 1, 3, 3)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(k, *f) for k, f in enumerate(TOY)], "seq long, s long, r long, o long, t long").persist()


def lines(df):
    return [(r.t, r.s, r.r, r.o) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(
    "e, q, limit, want",
    [
        (0, 2, 50, [(1, 2, 1, 0), (1, 0, 0, 2), (1, 0, 0, 1), (0, 0, 0, 1)]),
        (0, 2, 2, [(1, 2, 1, 0), (1, 0, 0, 2)]),
        (3, 4, 50, [(3, 3, 1, 3), (3, 3, 1, 3), (2, 4, 1, 3), (2, 0, 1, 3), (2, 3, 0, 1)]),
        (3, 3, 50, [(2, 4, 1, 3), (2, 0, 1, 3), (2, 3, 0, 1)]),
        (9, 3, 50, []),
    ],
)
def test_golden_history(spark, toy, e, q, limit, want):
    assert lines(hi.history(toy, spark.createDataFrame([(e, q)], "e long, q long"), limit)) == want


def test_golden_supplement(spark, toy):
    q = spark.createDataFrame([(3, 3)], "e long, q long")
    got = {(r.t, r.s, r.r, r.o): r.weight for r in hi.supplement_weights(toy, q, 50).collect()}
    want = {(1, 0, 0, 1): 0.834667807, (0, 0, 0, 1): 0.834506471, (1, 2, 1, 0): 0.648583610, (1, 0, 0, 2): 0.648583610, (0, 1, 1, 2): 0.628221066}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    one = hi.supplement_weights(toy, q, 50, max_hop=1)
    assert {(r.t, r.s, r.r, r.o) for r in one.collect()} == {(1, 0, 0, 1), (0, 0, 0, 1)}


def test_golden_counts(spark, toy):
    q = spark.createDataFrame([(0, 0, 1, 3), (1, 1, 2, 3)], "s long, r long, o long, t long")
    assert {(r.s, r.n) for r in hi.triple_counts(toy, q).collect()} == {(0, 2), (1, 1)}
    assert {(r.a, r.n) for r in hi.pair_counts(toy, q).collect()} == {(0, 2), (1, 1)}


def test_history_of_no_facts(spark, toy):
    assert hi.history(toy.limit(0), spark.createDataFrame([(0, 5)], "e long, q long"), 3).count() == 0


def test_segments_across_slices(spark):
    times = [0, 0, 3, 3, 1, 1, 1, 4, 4, 5]
    f = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "seq long, t long")
    want, seg, last = [], 0, 0
    for t in times:
        seg += t != last
        last = t
        want.append(seg)
    for width in (2, 3, 1 << 16):
        assert [r.segment for r in sn.segments(f, width=width).orderBy("seq").collect()] == want


def test_ranks_match_brute_force(spark):
    rng = random.Random(3)
    rows = sorted((rng.randrange(6), rng.randrange(2), rng.randrange(6), rng.randrange(8)) for _ in range(120))
    rows.sort(key=lambda x: x[3])
    f = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "seq long, s long, r long, o long, t long")
    q = fa.queries_of(f, 2)
    both = [(s, r, o, t) for s, r, o, t in rows] + [(o, r + 2, s, t) for s, r, o, t in rows]
    ents = sorted({e for x in rows for e in (x[0], x[2])})
    for r in rk.ranks(f, q, 2).collect():
        n = {e: sum(x[:3] == (r.e, r.r, e) and x[3] < r.t for x in both) for e in ents}
        order = sorted(ents, key=lambda e: (-n[e], e))
        true = {x[2] for x in both if x[:2] == (r.e, r.r) and x[3] == r.t} - {r.answer}
        assert r.raw_rank == order.index(r.answer) + 1
        assert r.filtered_rank == [e for e in order if e not in true].index(r.answer) + 1


def test_list_rank_repeats_and_absence(spark):
    p = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "f"), ("a", 4, "y"), ("b", 1, "z")], "id string, place int, item string")
    t = spark.createDataFrame([("a", "y"), ("b", "q")], "id string, item string")
    f = spark.createDataFrame([("a", "f"), ("a", "y")], "id string, item string")
    assert {r.id: r["rank"] for r in rk.list_rank(p, t, f).collect()} == {"a": 2, "b": None}
    assert {r.id: r["rank"] for r in rk.list_rank(p, t, f, distinct=False).collect()} == {"a": 3, "b": None}
    s = rk.summary(rk.list_rank(p, t, f), "rank").first()
    assert s.num_eval == 2 and math.isclose(s.mrr, 0.25) and s.hits_1 == 0 and s.hits_3 == 0.5


def test_supplement_sampling_is_bounded_and_repeatable(spark, toy):
    q = spark.createDataFrame([(3, 3)], "e long, q long")
    w = hi.supplement_weights(toy, q, 5)
    base = hi.history(toy, q, 5)
    a, b = ({(r.t, r.s, r.r, r.o) for r in hi.supplement_top(w, base, 5, sample=True, seed=k).collect()} for k in (1, 1))
    assert a == b and len(a) == 2
    top = hi.supplement_top(w, base, 5).orderBy("place").collect()
    assert [(r.t, r.s, r.o) for r in top] == [(1, 0, 1), (0, 0, 1)]


def test_answers_in_history_match_what_is_visible(spark):
    """Against the laid-out history, with self-loops, nulls and queries of other times; no row is made for each fact shown."""
    rng = random.Random(8)
    some = lambda: None if rng.random() < 0.04 else rng.randrange(6)
    rows = [(k, some(), 0, some(), rng.randrange(9)) for k in range(120)]
    f = spark.createDataFrame(rows, "seq long, s long, r long, o long, t long").persist()
    q = spark.createDataFrame([(k, some(), rng.randrange(11), some()) for k in range(300)] + [(300, 77, 3, 77)], "id long, e long, t long, answer long").persist()
    for limit in (1, 3, 7, 500):
        h = hi.visible_entities(hi.history(f, q.select("e", F.col("t").alias("q")).distinct(), limit))
        want = {(r.e, r.q, r.x) for r in h.where("e IS NOT NULL AND x IS NOT NULL").collect()}
        got = hi.in_history(q, f, limit)
        assert {(r.id, r.in_history) for r in got.collect()} == {(r.id, (r.e, r.t, r.answer) in want) for r in q.collect()}
    assert "inline" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 301


def test_prompts_need_every_name(spark, toy):
    from kairograph.operators import prompts as pr

    names = spark.createDataFrame([(k, f"e{k}") for k in range(5)], "id long, name string")
    rel = spark.createDataFrame([(0, "likes"), (1, "sees")], "id long, name string")
    rows = {r.id: r for r in pr.prompt_rows(toy, names, rel, 2, "train", limit=2, skip_first=True).collect()}
    assert len(rows) == 16 and rows[0].output == "e1" and rows[0].filters == ["e2"]
    assert rows[0].input.endswith("### History ###\n0: [e0\tlikes\te1]\n### Query ###\n1: [e0\tlikes\t?]\n### Answer ###\n")
    assert not rows[1].meta.in_history and rows[0].meta.in_history
    with pytest.raises(Exception, match="no name for"):
        pr.prompt_rows(toy, names.where("id <> 3"), rel, 2, "train").collect()
    bare = pr.prompt_rows(toy, names, rel, 2, "train", with_history=False).collect()
    assert len(bare) == 20 and not any(r.meta.in_history for r in bare)


def test_supplements_of_a_dense_graph(spark):
    rng = random.Random(5)
    rows = sorted(((rng.randrange(7), rng.randrange(2), rng.randrange(7), rng.randrange(6)) for _ in range(70)), key=lambda x: x[3])
    f = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "seq long, s long, r long, o long, t long").persist()
    queries, limit, recent = hi.entity_queries(f), 8, 5

    def newest(e, q, n):
        return [x for x in rows for end in (x[0], x[2]) if end == e and x[3] < q][::-1][:n]

    want = set()
    for e, q in map(tuple, queries.collect()):
        base = newest(e, q, 100)
        if 0 < len(base) < limit:
            near = {x for y in {y for b in base for y in (b[0], b[2])} for x in newest(y, q, recent) if x[0] != e}
            want |= {(e, q, x[3], x[0], x[1], x[2]) for x in near - set(base)}
    found = hi.supplement_candidates(f, queries, limit, recent)
    assert want and sorted(map(tuple, found.collect())) == sorted(want)
    assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()  # candidates are made once, not compared
    base = hi.history(f, queries, limit)
    whole = hi.supplement_weights(f, queries, limit, recent=recent)
    for multiplier, sample in ((1, False), (2, True)):
        top = lambda w: sorted(map(tuple, hi.supplement_top(w, base, limit, multiplier=multiplier, sample=sample).drop("weight").collect()))  # noqa: B023, E731
        assert top(hi.supplement_weights(f, queries, limit, recent=recent, multiplier=multiplier)) == top(whole)
