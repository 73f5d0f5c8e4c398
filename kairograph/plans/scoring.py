"""Ranks and metrics of the frequency scorer on the test facts, and prompt rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as fa
from ..operators import prompts as pr
from ..operators import ranking as rk
from .common import ASKED, BOTH, FACTS, HISTORY, INC, TEST_FROM, entity_names, facts, hist_sql, query, relation_names, relation_total

#: Dense SQL form: every test query against every entity.
_DENSE = f"""{ASKED}, {BOTH}, tq AS MATERIALIZED (SELECT * FROM qs WHERE t >= {TEST_FROM}),
g AS MATERIALIZED (SELECT DISTINCT e, r, t, answer FROM tq),
sc AS MATERIALIZED (SELECT d.e, d.r, d.t, ent.e AS x, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT e, r, t FROM tq) d CROSS JOIN ent
 LEFT JOIN (SELECT q.e, q.r, q.t, b.o AS x, count(*) AS n FROM (SELECT DISTINCT e, r, t FROM tq) q JOIN b ON b.s = q.e AND b.r = q.r AND b.t < q.t GROUP BY ALL) c
 ON c.e = d.e AND c.r = d.r AND c.t = d.t AND c.x = ent.e),
tr AS MATERIALIZED (SELECT DISTINCT e, r, t, answer AS x FROM qs),
rk AS MATERIALIZED (SELECT g.e, g.r, g.t, g.answer, 1 + count(*) FILTER (sc.n > a.n OR (sc.n = a.n AND sc.x < g.answer)) AS raw_rank,
 1 + count(*) FILTER ((sc.n > a.n OR (sc.n = a.n AND sc.x < g.answer)) AND tr.x IS NULL) AS filtered_rank
 FROM g JOIN sc a ON a.e = g.e AND a.r = g.r AND a.t = g.t AND a.x = g.answer JOIN sc ON sc.e = g.e AND sc.r = g.r AND sc.t = g.t
 LEFT JOIN tr ON tr.e = g.e AND tr.r = g.r AND tr.t = g.t AND tr.x = sc.x GROUP BY g.e, g.r, g.t, g.answer),
ra AS MATERIALIZED (SELECT tq.*, raw_rank, filtered_rank FROM tq JOIN rk USING (e, r, t, answer))"""
_HITS = ", ".join(f"round(avg(CASE WHEN {{0}} <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hits_{k}" for k in rk.HITS)


def _ranked(spark, sf_dir):
    f = facts(spark, sf_dir)
    n = relation_total(spark, sf_dir)
    return rk.ranks(f, rk.queries_of_test(f, n), n)


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"{FACTS}, {_DENSE} SELECT seq, dir, e, r, answer, t, raw_rank FROM ra")
def raw_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).drop("filtered_rank")


@query(f"{FACTS}, {_DENSE} SELECT seq, dir, e, r, answer, t, filtered_rank FROM ra")
def filtered_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).drop("raw_rank")


@query(f"{FACTS}, {_DENSE} SELECT count(*) AS num_eval, round(avg(1.0 / filtered_rank), 6) AS mrr, {_HITS.format('filtered_rank')} FROM ra")
def mrr_hits(spark, sf_dir):
    return _rounded(rk.summary(_ranked(spark, sf_dir), "filtered_rank"))


@query(f"{FACTS}, {_DENSE} SELECT dir, count(*) AS num_eval, round(avg(1.0 / filtered_rank), 6) AS mrr, {_HITS.format('filtered_rank')} FROM ra GROUP BY dir")
def mrr_by_direction(spark, sf_dir):
    return _rounded(rk.summary(_ranked(spark, sf_dir), "filtered_rank", ["dir"]))


@query(f"{FACTS}, {_DENSE} SELECT 'raw' AS kind, dir, count(*) AS num_eval, round(avg(1.0 / raw_rank), 6) AS mrr, {_HITS.format('raw_rank')} FROM ra GROUP BY dir UNION ALL SELECT 'filtered', dir, count(*), round(avg(1.0 / filtered_rank), 6), {_HITS.format('filtered_rank')} FROM ra GROUP BY dir")
def metrics_by_direction(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).select("dir", F.explode(F.create_map(F.lit("raw"), F.col("raw_rank"), F.lit("filtered"), F.col("filtered_rank"))).alias("kind", "rank"))
    return _rounded(rk.summary(ranked, "rank", ["kind", "dir"]))


_SEEN = f"{ASKED}, {BOTH}, dq AS (SELECT DISTINCT e, r, t FROM qs WHERE t >= {TEST_FROM}), cs AS MATERIALIZED (SELECT q.e, q.r, q.t, b.o AS entity, count(*) AS n FROM dq q JOIN b ON b.s = q.e AND b.r = q.r AND b.t < q.t GROUP BY ALL)"
_TOP = "tp AS MATERIALIZED (SELECT e, r, t, entity, n, place FROM (SELECT *, row_number() OVER (PARTITION BY e, r, t ORDER BY n DESC, entity) AS place FROM cs) WHERE place <= 10)"
_TOTAL = "tt AS (SELECT q.e, q.r, q.t, count(b.s) AS total FROM dq q LEFT JOIN b ON b.s = q.e AND b.r = q.r AND b.t < q.t GROUP BY ALL)"


def _top(spark, sf_dir):
    f = facts(spark, sf_dir)
    n = relation_total(spark, sf_dir)
    return f, n, rk.top_k(rk.candidates_seen(f, rk.queries_of_test(f, n), n), ["e", "r", "t"], 10, score="n")


@query(f"{FACTS}, {_SEEN}, {_TOP}, {_TOTAL} SELECT e, r, t, entity, place, round(ln((n + 1) / (total + (SELECT count(*) FROM ent))), 6) AS score FROM tp JOIN tt USING (e, r, t)")
def topk_scores(spark, sf_dir):
    f, n, top = _top(spark, sf_dir)
    total = rk.totals_before(f, rk.queries_of_test(f, n), n)
    size = rk.entities(f).agg(F.count(F.lit(1)).alias("size"))
    top = top.join(total, ["e", "r", "t"]).crossJoin(F.broadcast(size))
    return top.select("e", "r", "t", "entity", "place", F.round(rk.frequency_score(F.col("n"), F.col("total"), F.col("size")), 6).alias("score"))


@query(f"{FACTS}, {_SEEN}, {_TOP} SELECT DISTINCT CASE WHEN r < (SELECT n FROM nr) THEN e ELSE entity END AS s, CASE WHEN r < (SELECT n FROM nr) THEN r ELSE r - (SELECT n FROM nr) END AS r, CASE WHEN r < (SELECT n FROM nr) THEN entity ELSE e END AS o, t FROM tp")
def predicted_triples(spark, sf_dir):
    _, n, top = _top(spark, sf_dir)
    return rk.predicted_triples(top, n)


_LISTS = f"{_TOP}, li AS MATERIALIZED (SELECT qs.seq, qs.dir, tp.place, tp.entity AS item, qs.answer, qs.e, qs.r, qs.t FROM qs JOIN tp USING (e, r, t)), fl AS (SELECT DISTINCT e, r, t, answer AS item FROM qs)"


@query(
    f"{FACTS}, {_SEEN}, {_LISTS}, hit AS (SELECT seq, dir, place FROM li WHERE item = answer), "
    "kept AS (SELECT li.* FROM li LEFT JOIN fl ON fl.e = li.e AND fl.r = li.r AND fl.t = li.t AND fl.item = li.item WHERE fl.item IS NULL OR li.item = li.answer) "
    f"SELECT qs.seq, qs.dir, CASE WHEN any_value(hit.place) IS NULL THEN NULL ELSE count(kept.place) END AS rank FROM qs LEFT JOIN hit ON hit.seq = qs.seq AND hit.dir = qs.dir LEFT JOIN kept ON kept.seq = qs.seq AND kept.dir = qs.dir AND kept.place <= hit.place WHERE qs.t >= {TEST_FROM} GROUP BY qs.seq, qs.dir"
)
def truncated_list_rank(spark, sf_dir):
    f, n, top = _top(spark, sf_dir)
    q = rk.queries_of_test(f, n).withColumn("id", F.struct("seq", "dir"))
    lists = q.select("id", "e", "r", "t").join(top, ["e", "r", "t"]).select("id", "place", F.col("entity").alias("item"))
    # true answers pass over listed items only, so those that no list holds are not dealt to the queries
    listed = fa.answers(f, n).withColumnRenamed("answer", "entity").join(top.select("e", "r", "t", "entity"), ["e", "r", "t", "entity"], "left_semi")
    filters = q.select("id", "e", "r", "t").join(listed, ["e", "r", "t"]).select("id", F.col("entity").alias("item"))
    out = rk.list_rank(lists, q.select("id", F.col("answer").alias("item")), filters)
    return out.select("id.seq", "id.dir", "rank")


_NAME = "'Entity_' || {0}"
_PROMPT = f"""ids AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, dir, seq) - 1 AS id, CASE WHEN dir = 1 THEN r - (SELECT n FROM nr) ELSE r END AS br FROM qs WHERE t >= {TEST_FROM}),
past AS (SELECT e, q, string_agg(h.t || ': [Entity_' || h.s || chr(9) || rel.event_type || chr(9) || 'Entity_' || h.o || ']', chr(10) ORDER BY rank) AS txt FROM h JOIN rel ON rel.r = h.r GROUP BY e, q),
v AS MATERIALIZED (SELECT DISTINCT e, q, unnest([s, o]) AS x FROM h),
oth AS (SELECT ids.id, string_agg('Entity_' || d.answer, '|' ORDER BY d.answer) AS filters FROM ids JOIN (SELECT DISTINCT e, r, t, answer FROM qs) d ON d.e = ids.e AND d.r = ids.r AND d.t = ids.t AND d.answer <> ids.answer GROUP BY ids.id)"""


@query(
    f"{FACTS}, {ASKED}, {INC}, {hist_sql('h', HISTORY)}, {_PROMPT} SELECT ids.id, '### Instruction ###' || chr(10) || '{pr.INSTRUCTION}' || chr(10) || '### Subject ###' || chr(10) || 'Entity_' || ids.e || chr(10) || '### History ###' || chr(10) || coalesce(past.txt, '') || chr(10) "
    "|| '### Query ###' || chr(10) || ids.t || ': [' || CASE WHEN dir = 0 THEN 'Entity_' || ids.e ELSE '?' END || chr(9) || rel.event_type || chr(9) || CASE WHEN dir = 0 THEN '?' ELSE 'Entity_' || ids.e END || ']' || chr(10) || '### Answer ###' || chr(10) AS input, "
    "'Entity_' || ids.answer AS output, coalesce(oth.filters, '') AS filters, v.x IS NOT NULL AS in_history, CASE WHEN dir = 0 THEN 'forward' ELSE 'backward' END AS direction "
    "FROM ids JOIN rel ON rel.r = ids.br LEFT JOIN past ON past.e = ids.e AND past.q = ids.t LEFT JOIN v ON v.e = ids.e AND v.q = ids.t AND v.x = ids.answer LEFT JOIN oth ON oth.id = ids.id"
)
def prompt_rows(spark, sf_dir):
    f = facts(spark, sf_dir)
    rows = pr.prompt_rows(f.where("split = 'test'"), entity_names(spark, sf_dir), relation_names(spark, sf_dir), relation_total(spark, sf_dir), "test", limit=HISTORY, lookback=f)
    return rows.select("id", "input", "output", F.array_join("filters", "|").alias("filters"), "meta.in_history", "meta.direction")
