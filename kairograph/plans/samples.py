"""Samples, descriptions and lists of names: fields, conversions, coverage and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import codes as co
from ..operators import context as cx
from ..operators import graph as gr
from ..operators import history as hi
from ..operators import ranking as rk
from ..operators import training as tr
from ..sources import readers as rd
from . import codes as pc
from .common import BOTH, FACTS, ORACLE, RECENT, SHORT_HISTORY, entity_names, facts, query, relation_names, table
from .graphs import _edges
from .temporal import supplement_weights  # noqa: F401  registers the SQL that the hop filter narrows
from .texts import _CTX, _TOPN, _contexts

_LEAST = _TOPN.replace('"count" >= 1', '"count" >= 2')


@query(f"{FACTS}, {_CTX}, {_LEAST} SELECT * FROM tn")
def frequent_contexts(spark, sf_dir):
    return cx.context_top(_contexts(spark, sf_dir), 5, 2)


#: Descriptions of two in three entities; those of the others are blank.
_DONE_SQL = "dn AS (SELECT 'entity' AS kind, e AS id, CASE e % 3 WHEN 0 THEN '  ' ELSE 'known' END AS description FROM ent)"


def _done(spark, sf_dir):
    e = entity_names(spark, sf_dir)
    return e.select(F.lit("entity").alias("kind"), "id", F.when(F.col("id") % 3 == 0, "  ").otherwise("known").alias("description"))


def _items(spark, sf_dir):
    """Entities and relations, and one of each kind that no fact names."""
    e, r = entity_names(spark, sf_dir), relation_names(spark, sf_dir)
    lone = spark.createDataFrame([("entity", -1), ("relation", -1)], "kind string, id long")
    return e.select(F.lit("entity").alias("kind"), "id").unionByName(r.select(F.lit("relation").alias("kind"), "id")).unionByName(lone)


@query(f"{FACTS}, {_DONE_SQL} SELECT 'entity' AS kind, e AS id FROM ent WHERE e % 3 = 0 UNION ALL SELECT 'relation', r FROM rel UNION ALL SELECT unnest(['entity', 'relation']), -1")
def pending_descriptions(spark, sf_dir):
    return cx.pending(_items(spark, sf_dir), _done(spark, sf_dir))


@query(f"{FACTS} SELECT 'entity' AS kind, count(*) + 1 AS total, count(*) FILTER (e % 3 <> 0) AS filled, count(*) AS covered FROM ent UNION ALL SELECT 'relation', count(*) + 1, 0, count(*) FROM rel")
def description_coverage(spark, sf_dir):
    return cx.coverage(_items(spark, sf_dir), _done(spark, sf_dir), _contexts(spark, sf_dir))


@query("SELECT p_partkey AS id, 'Instruct: Represent the part.' || chr(10) || 'Query: ' || p_name || '. ' || p_type AS long, p_name || '. ' || p_type AS short FROM part")
def embedding_inputs(spark, sf_dir):
    p, name, kind = table(spark, sf_dir, "part"), F.col("p_name"), F.col("p_type")
    return p.select(F.col("p_partkey").alias("id"), tx.embedding_input(name, kind, " Represent the part. ").alias("long"), tx.embedding_input(name, kind).alias("short"))


@query("SELECT p_partkey AS id, p_partkey % 2 = 0 AS code FROM part")
def code_like(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" <"), "p_name", F.lit("> "))).otherwise(F.concat(F.lit("<"), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.looks_like_code(name).alias("code"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '<z1_01>|<z2_' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '>' ELSE 'part|' || p_partkey END AS tokens FROM part")
def parsed_codes(spark, sf_dir):
    i = F.col("p_partkey")
    code = F.when(i % 2 == 0, F.concat(tx.code_token(F.lit(1), F.lit(1)), F.lit(" "), tx.code_token(F.lit(2), i % 100))).otherwise(F.concat(F.lit(" part  "), i.cast("string")))
    return table(spark, sf_dir, "part").select(i.alias("id"), F.array_join(tx.parse_code_tokens(code), "|").alias("tokens"))


@query(f"{pc._CODES} SELECT vec_id AS id, {pc._TOKEN.format(1, 0)} || {pc._TOKEN.format(2, 1)} || {pc._TOKEN.format(3, 2)} AS output, (SELECT count(*) FROM zs WHERE vec_id % 3 = 2) AS missing FROM zs WHERE vec_id % 3 <> 2")
def code_targets(spark, sf_dir):
    """A third of the outputs are codes, a third names, a third unknown."""
    coded = co.with_code(pc._encoded(spark, sf_dir), pc.LEVELS).select(F.col("vec_id").alias("id"), "tokens")
    i, name = F.col("id"), F.concat(F.lit("Entity_"), F.col("id").cast("string"))
    samples = coded.select("id", F.when(i % 3 == 0, F.concat(F.lit(" "), "tokens")).when(i % 3 == 1, F.concat(F.lit("  "), name)).otherwise("nobody").alias("output"))
    kept, counts = tr.targets_as_codes(samples, coded.select(i.alias("entity"), name.alias("name")), coded.select(i.alias("entity"), "tokens"))
    return kept.crossJoin(F.broadcast(counts.select("missing"))).select("id", "output", "missing")


@query(
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN conv_id || ',' || turn ELSE conv_id || ',0,' || turn || ',7' END AS query_of, CASE WHEN conv_id % 2 = 0 THEN role ELSE 'meta ' || role END AS mode_of, "
    "text AS prompt_of, coalesce(role, 'target') AS answer_of FROM conversations"
)
def sample_fields(spark, sf_dir):
    """Samples that name query, mode, prompt and answer in different ways."""
    odd, role = F.col("turn") % 2 != 0, F.col("role")
    meta = F.struct(F.col("conv_id").alias("s_id"), F.lit(0).cast("long").alias("r_id"), F.col("turn").alias("o_id"), F.lit(7).cast("long").alias("t"), F.concat(F.lit("meta "), role).alias("direction"))
    s = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(~odd, F.array("conv_id", "turn")).alias("query"), F.when(F.col("conv_id") % 2 == 0, role).alias("mode"), F.col("text").alias("input"), role.alias("output"), F.lit("target").alias("target"), meta.alias("meta")
    )
    out = rd.sample_fields(s)
    return out.select("conv_id", "turn", F.array_join(F.transform("query_of", lambda x: x.cast("string")), ",").alias("query_of"), "mode_of", "prompt_of", "answer_of")


@query(f"SELECT * FROM ({ORACLE['supplement_weights']}) WHERE hops <= 1")
def supplement_one_hop(spark, sf_dir):
    f = facts(spark, sf_dir)
    return hi.supplement_weights(f, hi.entity_queries(f), SHORT_HISTORY, recent=RECENT, max_hop=1).withColumn("weight", F.round("weight", 7))


#: The names of a query's list are its nearest vectors' labels, so they repeat; its own label is the
#: target, and the next label is another true answer.
_NAMED = f"""{pc._SCORES}, li AS MATERIALIZED (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY score DESC, entity) AS place FROM es JOIN embeddings ON vec_id = entity WHERE query <> entity QUALIFY place <= 50),
tg AS (SELECT vec_id AS query, label FROM embeddings WHERE vec_id % {pc.APART} = 0), hit AS (SELECT query, min(place) AS hit_at FROM li JOIN tg USING (query, label) GROUP BY query),
rr AS (SELECT tg.query, CASE WHEN any_value(hit_at) IS NULL THEN NULL ELSE count(li.place) END AS rank FROM tg LEFT JOIN hit USING (query) LEFT JOIN li ON li.query = tg.query AND li.place <= hit_at AND li.label <> tg.label + 1 GROUP BY tg.query)"""
_NAME_HITS = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hits_{k}" for k in rk.NAME_HITS)


@query(f"{_NAMED} SELECT count(*) AS num_eval, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, {_NAME_HITS} FROM rr")
def metrics_by_name(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity"), "label")
    top = rk.top_k(pc.best_vectors(spark, sf_dir, 51).where("query <> entity"), ["query"], 50).join(labels, "entity")
    own = labels.where(F.col("entity") % pc.APART == 0)
    text = lambda c, form: F.format_string(form, c).alias("item")
    lists = top.select(F.col("query").alias("id"), "place", text(F.col("label"), " Label  %d"))
    targets = own.select(F.col("entity").alias("id"), text(F.col("label"), "LABEL %d"))
    filters = own.select(F.col("entity").alias("id"), text(F.col("label") + 1, "label %d")).unionByName(targets)
    r = rk.metrics_by_name(lists, targets, filters)
    return r.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def first_documents(spark, sf_dir):
    return tr.first_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


@query("SELECT doc_id, source, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place FROM documents WHERE doc_id IS NOT NULL")
def shuffled_documents(spark, sf_dir):
    return tr.shuffle_places(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 7)


@query(f"{FACTS}, {BOTH} SELECT o AS dst, s AS src, r AS rel, t, row_number() OVER (ORDER BY o, s, r, t) - 1 AS place FROM b")
def sorted_edges(spark, sf_dir):
    return gr.sorted_edges(_edges(spark, sf_dir)[0], ("t",)).select("dst", "src", "rel", "t", "place")


@query(f"{FACTS}, {BOTH} SELECT DISTINCT o AS node FROM b WHERE s IN (SELECT s FROM f WHERE t = 0)")
def neighbours(spark, sf_dir):
    """What the subjects of the first day are ever linked with."""
    first = facts(spark, sf_dir).where("t = 0").select(F.col("s").alias("node"))
    return gr.neighbours(_edges(spark, sf_dir)[0], first)


_STEP = f"""WITH vec AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), bk AS MATERIALIZED (SELECT vec_id AS code, v FROM vec WHERE vec_id < {pc.SIZE}),
near AS MATERIALIZED (SELECT a.vec_id, arg_min(bk.code, (list_sum(list_transform(list_zip(a.v, bk.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), bk.code)) AS code FROM vec a CROSS JOIN bk GROUP BY a.vec_id),
ct AS (SELECT code, count(*) AS n FROM near GROUP BY code), mn AS (SELECT code, i, avg(x) AS m FROM (SELECT code, unnest(range(len(v))) AS i, unnest(v) AS x FROM near JOIN vec USING (vec_id)) GROUP BY code, i),
own AS (SELECT code, unnest(range(len(v))) AS i, unnest(v) AS x FROM bk)"""


@query(f"{_STEP} SELECT own.code::INT AS code, i::INT AS i, round(x + coalesce(n, 0) / (own.code + 1.0 + coalesce(n, 0)) * (coalesce(m, x) - x), 6) AS x, own.code + 1 + coalesce(n, 0) AS n FROM own LEFT JOIN ct USING (code) LEFT JOIN mn USING (code, i)")
def centroid_step(spark, sf_dir):
    """All vectors as one batch for centroids that have met ``code + 1`` rows."""
    vec = pc._vectors(spark, sf_dir)
    book = vec.where(F.col("vec_id") < pc.SIZE).select(F.col("vec_id").cast("int").alias("code"), F.col("v").alias("centroid"), (F.col("vec_id") + 1).alias("n"))
    out = co.move_centroids(book, vec.select("v"))
    return out.select("code", "n", F.posexplode("centroid").alias("i", "x")).select("code", "i", F.round("x", 6).alias("x"), "n")


#: Codes of every other vector are the paths; labels are all codes, an end after them, two masked places before.
_END = 9999
_PATHS = f"""{pc._CODES}, tk AS MATERIALIZED (SELECT vec_id AS id, z0::INT AS a, 1000 + z1::INT AS b, 2000 + z2::INT AS c FROM zs),
nx AS MATERIALIZED (SELECT '' AS prefix, list_sort(list(DISTINCT a)) AS tokens FROM tk WHERE id % 2 = 0 UNION ALL SELECT a::VARCHAR, list_sort(list(DISTINCT b)) FROM tk WHERE id % 2 = 0 GROUP BY a
 UNION ALL SELECT a || ',' || b, list_sort(list(DISTINCT c)) FROM tk WHERE id % 2 = 0 GROUP BY a, b UNION ALL SELECT DISTINCT a || ',' || b || ',' || c, [{_END}] FROM tk WHERE id % 2 = 0),
sp AS (SELECT id, 0 AS position, a AS token, '' AS prefix FROM tk UNION ALL SELECT id, 1, b, a::VARCHAR FROM tk UNION ALL SELECT id, 2, c, a || ',' || b FROM tk UNION ALL SELECT id, 3, {_END}, a || ',' || b || ',' || c FROM tk),
al AS MATERIALIZED (SELECT id, position, token, CASE WHEN list_contains(t, token) THEN t ELSE list_append(t, token) END AS allowed FROM (SELECT sp.*, coalesce(tokens, [{_END}]) AS t FROM sp LEFT JOIN nx USING (prefix)))"""


@query(f"{_PATHS} SELECT id, position, token, array_to_string(allowed, ',') AS allowed, max(len(allowed)) OVER (PARTITION BY id // 16) AS width, len(allowed) AS real FROM al")
def allowed_labels(spark, sf_dir):
    """What may stand at every label, padded by batches of 16 samples."""
    z = [F.col(f"z{k}").cast("int") + 1000 * k for k in range(3)]
    tokens = pc._encoded(spark, sf_dir).select(F.col("vec_id").alias("id"), F.array(*z).alias("path"))
    masked = F.lit(tr.IGNORED)
    rows = tokens.select("id", F.concat(F.array(masked, masked), "path", F.array(F.lit(_END))).alias("labels"))
    out = tr.pad_allowed(tr.allowed_labels(rows, "id", tokens.where("id % 2 = 0"), _END), F.floor(F.col("id") / 16))
    real = F.size(F.filter("mask", lambda x: x)).cast("long")
    return out.select("id", "position", "token", F.array_join(F.slice("allowed", 1, real.cast("int")), ",").alias("allowed"), F.size("allowed").cast("long").alias("width"), real.alias("real"))

