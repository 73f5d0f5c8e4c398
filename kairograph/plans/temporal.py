"""Snapshots, answer sets and point-in-time history over the event facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as fa
from ..operators import history as hi
from ..operators import snapshots as sn
from .common import ASKED, BOTH, FACTS, HISTORY, INC, RECENT, SHORT_HISTORY, facts, hist_sql, query, relation_total

#: Ids sorted, distinct, joined by commas.
IDS = "array_to_string(list_sort(list(DISTINCT {0})), ',')"


@query(f"{FACTS} SELECT seq, s, r, o, t, CASE WHEN t < 24 THEN 'train' WHEN t < 27 THEN 'valid' ELSE 'test' END AS split FROM f")
def event_facts(spark, sf_dir):
    return facts(spark, sf_dir)


@query(f"{FACTS} SELECT seq, t, (sum(CASE WHEN t <> p THEN 1 ELSE 0 END) OVER (ORDER BY seq))::BIGINT AS segment FROM (SELECT seq, t, lag(t, 1, 0) OVER (ORDER BY seq) AS p FROM f)")
def snapshot_segments(spark, sf_dir):
    return sn.segments(facts(spark, sf_dir))


@query(f"{FACTS}, p AS (SELECT t, count(*) AS edges, 2 * count(DISTINCT r) AS rels FROM f GROUP BY t), n AS (SELECT t, count(DISTINCT e) AS nodes FROM (SELECT t, unnest([s, o]) AS e FROM f) GROUP BY t) SELECT t, nodes, rels, edges FROM p JOIN n USING (t)")
def snapshot_sizes(spark, sf_dir):
    return sn.per_snapshot(facts(spark, sf_dir))


@query(f"{FACTS}, p AS (SELECT t, count(*) AS edges, 2 * count(DISTINCT r) AS rels FROM f GROUP BY t), n AS (SELECT t, count(DISTINCT e) AS nodes FROM (SELECT t, unnest([s, o]) AS e FROM f) GROUP BY t) SELECT round(avg(nodes), 6) AS avg_nodes, round(avg(rels), 6) AS avg_rels, count(*) AS snapshots, max(edges) AS max_edges, min(edges) AS min_edges FROM p JOIN n USING (t)")
def snapshot_stats(spark, sf_dir):
    st = sn.statistics(facts(spark, sf_dir))
    return st.withColumn("avg_nodes", F.round("avg_nodes", 6)).withColumn("avg_rels", F.round("avg_rels", 6))


@query(f"{FACTS} SELECT seq, o AS s, r + (SELECT n FROM nr) AS r, s AS o, t FROM f")
def inverse_edges(spark, sf_dir):
    f = facts(spark, sf_dir).drop("split")
    return fa.inverse(f, relation_total(spark, sf_dir))


@query(f"{FACTS}, {ASKED} SELECT e, r, t, dir, {IDS.format('answer')} AS answers, count(DISTINCT answer) AS n FROM qs GROUP BY e, r, t, dir")
def answer_sets(spark, sf_dir):
    f = facts(spark, sf_dir)
    return fa.answer_sets(f, relation_total(spark, sf_dir))


@query(f"{FACTS} SELECT 'object' AS kind, s AS a, r AS b, {IDS.format('o')} AS answers FROM f GROUP BY s, r UNION ALL SELECT 'subject', o, r + (SELECT n FROM nr), {IDS.format('s')} FROM f GROUP BY o, r UNION ALL SELECT 'relation', s, o, {IDS.format('r')} FROM f GROUP BY s, o")
def static_answer_sets(spark, sf_dir):
    f = facts(spark, sf_dir)
    return fa.static_answer_sets(f, relation_total(spark, sf_dir))


@query(f"{FACTS}, {BOTH} SELECT s, r, o, min(t) AS first_t FROM b GROUP BY s, r, o")
def first_seen_answers(spark, sf_dir):
    f = facts(spark, sf_dir)
    return fa.first_seen(f, relation_total(spark, sf_dir))


@query(f"{FACTS}, {BOTH}, {ASKED}, fs AS (SELECT s, r, o, min(t) AS first_t FROM b GROUP BY s, r, o) SELECT q.e, q.r, q.t, count(fs.o) AS n FROM (SELECT DISTINCT e, r, t FROM qs) q LEFT JOIN fs ON fs.s = q.e AND fs.r = q.r AND fs.first_t < q.t GROUP BY ALL")
def known_answer_counts(spark, sf_dir):
    f = facts(spark, sf_dir)
    n = relation_total(spark, sf_dir)
    return fa.known_answers(f, fa.queries_of(f, n), n)


@query(f"{FACTS}, g AS (SELECT t, r, {IDS.format('s')} AS entities, count(DISTINCT s) AS n FROM f GROUP BY t, r) SELECT * FROM g UNION ALL SELECT t, r + (SELECT n FROM nr), entities, n FROM g")
def rel_to_entities(spark, sf_dir):
    f = facts(spark, sf_dir)
    return fa.relation_entities(f, relation_total(spark, sf_dir))


@query(f"{FACTS} SELECT t, s, {IDS.format('r')} AS relations, count(DISTINCT r) AS n FROM f GROUP BY t, s")
def entity_to_relations(spark, sf_dir):
    return fa.entity_relations(facts(spark, sf_dir))


@query(f"{FACTS} SELECT r, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, r) AS place FROM f GROUP BY r")
def predicate_frequency(spark, sf_dir):
    return fa.predicate_frequency(facts(spark, sf_dir))


@query(f"{FACTS} SELECT t, e, row_number() OVER (PARTITION BY t ORDER BY e) - 1 AS node FROM (SELECT DISTINCT t, unnest([s, o]) AS e FROM f)")
def relabelled_nodes(spark, sf_dir):
    return fa.relabel(facts(spark, sf_dir))


_IDX = "ix AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT t FROM f)), fi AS MATERIALIZED (SELECT f.*, idx FROM f JOIN ix USING (t))"


@query(f"{FACTS}, {_IDX} SELECT DISTINCT idx // 3 AS window, s, r, o FROM fi")
def dilated_snapshots(spark, sf_dir):
    return sn.dilated(facts(spark, sf_dir), 3)


@query(f"{FACTS}, {_IDX} SELECT w.idx AS window, s, r, o FROM fi JOIN ix w ON fi.idx BETWEEN w.idx AND w.idx + 4 WHERE w.idx + 4 <= (SELECT max(idx) FROM ix)")
def sliding_snapshots(spark, sf_dir):
    return sn.sliding(facts(spark, sf_dir), 5)


@query(f"{FACTS}, {_IDX} SELECT w.idx AS at, s, r, o FROM fi JOIN ix w ON fi.idx BETWEEN w.idx - 10 AND w.idx - 1")
def trailing_snapshots(spark, sf_dir):
    return sn.trailing(facts(spark, sf_dir), 10)


@query(f"{FACTS}, {ASKED} SELECT *, row_number() OVER (ORDER BY t, dir, seq) - 1 AS id FROM qs WHERE t > (SELECT min(t) FROM f)")
def sample_ids(spark, sf_dir):
    f = facts(spark, sf_dir)
    return sn.sample_ids(f, relation_total(spark, sf_dir), skip_first=True)


@query(f"{FACTS}, {INC}, {hist_sql('h', HISTORY)} SELECT * FROM h")
def history_topk(spark, sf_dir):
    f = facts(spark, sf_dir)
    return hi.history(f, hi.entity_queries(f), HISTORY)


@query(f"{FACTS}, {INC}, {hist_sql('h', HISTORY)} SELECT e, q, count(DISTINCT x) AS n, {IDS.format('x')} AS entities FROM (SELECT e, q, unnest([s, o]) AS x FROM h) GROUP BY e, q")
def history_visible(spark, sf_dir):
    f = facts(spark, sf_dir)
    seen = hi.visible_entities(hi.history(f, hi.entity_queries(f), HISTORY))
    return fa.listed(seen, ["e", "q"], "x", "entities")


@query(f"{FACTS}, {INC}, {ASKED}, {hist_sql('h', HISTORY)}, v AS (SELECT DISTINCT e, q, unnest([s, o]) AS x FROM h) SELECT qs.seq, qs.dir, qs.e, qs.r, qs.answer, qs.t, v.x IS NOT NULL AS in_history FROM qs LEFT JOIN v ON v.e = qs.e AND v.q = qs.t AND v.x = qs.answer")
def in_history(spark, sf_dir):
    f = facts(spark, sf_dir)
    return hi.in_history(fa.queries_of(f, relation_total(spark, sf_dir)), f, HISTORY)


@query(f"{FACTS} SELECT s, r, o, t, coalesce(sum(c) OVER (PARTITION BY s, r, o ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n FROM (SELECT s, r, o, t, count(*) AS c FROM f GROUP BY ALL)")
def triple_count_asof(spark, sf_dir):
    f = facts(spark, sf_dir)
    return hi.triple_counts(f, f)


@query(f"{FACTS} SELECT a, b, t, coalesce(sum(c) OVER (PARTITION BY a, b ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n FROM (SELECT least(s, o) AS a, greatest(s, o) AS b, t, count(*) AS c FROM f GROUP BY ALL)")
def pair_count_asof(spark, sf_dir):
    f = facts(spark, sf_dir)
    return hi.pair_counts(f, f)


_CAND = f"""{hist_sql('h', SHORT_HISTORY)}, sh AS MATERIALIZED (SELECT e, q FROM h GROUP BY e, q HAVING count(*) < {SHORT_HISTORY}),
seed AS MATERIALIZED (SELECT DISTINCT e, q, unnest([s, o]) AS x FROM h SEMI JOIN sh USING (e, q)),
nx AS MATERIALIZED (SELECT x, q, (SELECT count(*) FROM inc WHERE inc.e = d.x AND inc.t < d.q) AS n FROM (SELECT DISTINCT x, q FROM seed) d),
near AS MATERIALIZED (SELECT nx.x, nx.q, inc.t, inc.s, inc.r, inc.o FROM nx JOIN inc ON inc.e = nx.x AND inc.p <= nx.n AND inc.p > nx.n - {RECENT}),
cand AS MATERIALIZED (SELECT DISTINCT seed.e, seed.q, near.t, near.s, near.r, near.o FROM seed JOIN near USING (x, q) WHERE near.s <> seed.e
 EXCEPT SELECT e, q, t, s, r, o FROM h)"""
_WEIGHT = """tc AS MATERIALIZED (SELECT s, r, o, q, (SELECT count(*) FROM f WHERE f.s = c.s AND f.r = c.r AND f.o = c.o AND f.t < c.q) AS n_spo FROM (SELECT DISTINCT s, r, o, q FROM cand) c),
pc AS MATERIALIZED (SELECT a, b, q, (SELECT count(*) FROM f WHERE least(f.s, f.o) = c.a AND greatest(f.s, f.o) = c.b AND f.t < c.q) AS n_so FROM (SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b, q FROM cand) c),
cw AS MATERIALIZED (SELECT cand.*, n_spo, n_so, CASE WHEN v1.x IS NOT NULL AND v2.x IS NOT NULL THEN 1 ELSE 2 END AS hops FROM cand JOIN tc USING (s, r, o, q)
 JOIN pc ON pc.a = least(cand.s, cand.o) AND pc.b = greatest(cand.s, cand.o) AND pc.q = cand.q
 LEFT JOIN seed v1 ON v1.e = cand.e AND v1.q = cand.q AND v1.x = cand.s LEFT JOIN seed v2 ON v2.e = cand.e AND v2.q = cand.q AND v2.x = cand.o),
wt AS MATERIALIZED (SELECT *, exp(-0.6 * hops) / (0.6 * ln(greatest(n_spo, 1)) + 1) * (exp(-0.01 * ((q - t) / 24.0)) + ln(1 + 0.1 * n_so) / (1 + ln(1 + 0.1 * n_so)) + 1) AS weight FROM cw)"""
_ROOM = f"rm AS (SELECT e, q, {SHORT_HISTORY} - count(*) AS room FROM h GROUP BY e, q)"
_ORDER = "round(weight, 9) DESC, t DESC, s, r, o"


def _weighted(f, multiplier=None):
    return hi.supplement_weights(f, hi.entity_queries(f), SHORT_HISTORY, recent=RECENT, multiplier=multiplier)


@query(f"{FACTS}, {INC}, {_CAND} SELECT * FROM cand")
def supplement_candidates(spark, sf_dir):
    f = facts(spark, sf_dir)
    return hi.supplement_candidates(f, hi.entity_queries(f), SHORT_HISTORY, RECENT)


@query(f"{FACTS}, {INC}, {_CAND}, {_WEIGHT} SELECT e, q, t, s, r, o, n_spo, n_so, hops, round(weight, 7) AS weight FROM wt")
def supplement_weights(spark, sf_dir):
    return _weighted(facts(spark, sf_dir)).withColumn("weight", F.round("weight", 7))


@query(f"{FACTS}, {INC}, {_CAND}, {_WEIGHT}, {_ROOM} SELECT e, q, t, s, r, o, place FROM (SELECT *, row_number() OVER (PARTITION BY e, q ORDER BY {_ORDER}) AS place FROM wt JOIN rm USING (e, q)) WHERE place <= room")
def supplement_top(spark, sf_dir):
    f = facts(spark, sf_dir)
    base = hi.history(f, hi.entity_queries(f), SHORT_HISTORY)
    return hi.supplement_top(_weighted(f, 1), base, SHORT_HISTORY).select("e", "q", "t", "s", "r", "o", "place")


_U = "('0x' || substr(md5('0|' || e || '|' || q || '|' || t || '|' || s || '|' || r || '|' || o), 1, 13))::BIGINT / pow(16, 13)"


@query(
    f"{FACTS}, {INC}, {_CAND}, {_WEIGHT}, {_ROOM}, hv AS (SELECT *, row_number() OVER (PARTITION BY e, q ORDER BY {_ORDER}) AS heavy FROM wt JOIN rm USING (e, q)), "
    f"ky AS (SELECT *, row_number() OVER (PARTITION BY e, q ORDER BY round(ln(greatest({_U}, 1e-12)) / weight, 9) DESC, {_ORDER}) AS place FROM hv WHERE heavy <= room * 10) SELECT e, q, t, s, r, o, place FROM ky WHERE place <= room"
)
def supplement_sample(spark, sf_dir):
    f = facts(spark, sf_dir)
    base = hi.history(f, hi.entity_queries(f), SHORT_HISTORY)
    return hi.supplement_top(_weighted(f, 10), base, SHORT_HISTORY, sample=True).select("e", "q", "t", "s", "r", "o", "place")
