"""Text functions over documents, and contexts of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context as cx
from ..operators import training as tr
from .common import FACTS, entity_names, facts, query, relation_names, table

#: White space as the engine squeezes it, for SQL.
_SQ = "trim(regexp_replace({0}, '[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{001c}}-\\x{{001f}}\\x{{0085}}\\x{{000b}}]+', ' ', 'g'))"
_TEXT = "coalesce(text, '')"


@query(f"SELECT doc_id, lower({_SQ.format(_TEXT)}) AS norm, {_SQ.format('replace(source, chr(95), chr(32))')} AS source FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("norm"), tx.normalize_entity_name(F.col("source")).alias("source"))


@query(f"SELECT doc_id, {_SQ.format('replace(regexp_replace(trim(label), $$(?s)^<(.*)>$$$, $$\\1$$), chr(95), chr(32))')} AS label FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<' || source || '_' || lang || '>' ELSE source || '_' || lang END AS label FROM documents)".replace("$$(?s)^<(.*)>$$$", "'(?s)^<(.*)>$'").replace("$$\\1$$", "'\\1'"))
def normalize_label(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("_"), "lang")
    return d.select("doc_id", tx.normalize_label(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<"), name, F.lit(">"))).otherwise(name)).alias("label"))


_PARTS = f"regexp_split_to_array(regexp_replace({_SQ.format(_TEXT)}, '([.!?。！？]) +', '\\1' || chr(1), 'g'), chr(1))"
_FIRST = f"trim(array_to_string(list_slice(list_filter({_PARTS}, lambda s: trim(s) <> ''), 1, 4), ' '))"


@query(f"WITH a AS (SELECT doc_id, {_FIRST} AS x FROM documents), b AS (SELECT doc_id, CASE WHEN x <> '' AND NOT regexp_matches(x, '[.!?。！？]$') THEN x || '.' ELSE x END AS x FROM a) SELECT doc_id, CASE WHEN length(x) > 200 THEN rtrim(substr(x, 1, 197)) || '...' ELSE x END AS description FROM b")
def normalize_description(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_description(F.coalesce("text", F.lit("")), 200).alias("description"))


@query("SELECT doc_id, regexp_matches(CASE WHEN doc_id % 3 = 0 THEN text || '漢字' ELSE text END, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]') AS cjk FROM documents")
def contains_cjk(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.contains_cjk(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("漢字"))).otherwise(F.col("text"))).alias("cjk"))


_ODD = "p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (' || p_brand || ')' ELSE '' END"


@query(f"WITH n AS (SELECT p_partkey AS id, {_ODD} AS name FROM part) SELECT id, 0 AS rel, trim(substr(name, 1, instr(name, '(') - 1)) AS word FROM n WHERE contains(name, '(') AND contains(name, ')') UNION ALL SELECT id, 1, substr(name, instr(name, '(') + 1, instr(name, ')') - instr(name, '(') - 1) FROM n WHERE contains(name, '(') AND contains(name, ')') UNION ALL SELECT id, 2, name FROM n WHERE NOT (contains(name, '(') AND contains(name, ')'))")
def name_words(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" ("), "p_brand", F.lit(")"))).otherwise(""))
    return p.select(F.col("p_partkey").alias("id"), F.explode(tx.parenthesis_words(name)).alias("w")).select("id", "w.rel", "w.word")


_CTX = """lab AS (SELECT e, 'Entity ' || e AS name FROM ent), cx AS MATERIALIZED (
SELECT 'entity' AS kind, s AS id, 'OUT relation=' || event_type || '; counterpart=Entity ' || o AS text, seq * 3 AS "at" FROM f JOIN rel USING (r)
UNION ALL SELECT 'entity', o, 'IN relation=' || event_type || '; counterpart=Entity ' || s, seq * 3 + 1 FROM f JOIN rel USING (r)
UNION ALL SELECT 'relation', r, 'Entity ' || s || ' -> Entity ' || o, seq * 3 + 2 FROM f),
cc AS MATERIALIZED (SELECT kind, id, text, count(*) AS "count", min("at") AS "first" FROM cx GROUP BY kind, id, text)"""


def _contexts(spark, sf_dir):
    return cx.context_counts(facts(spark, sf_dir), entity_names(spark, sf_dir), relation_names(spark, sf_dir))


@query(f"{FACTS}, {_CTX} SELECT * FROM cc")
def context_counts(spark, sf_dir):
    return _contexts(spark, sf_dir)


_TOPN = 'tn AS (SELECT kind, id, place, text || $$; freq=$$ || "count" AS text FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY "count" DESC, "first") AS place FROM cc WHERE "count" >= 1) WHERE place <= 5)'


@query(f"{FACTS}, {_CTX}, {_TOPN} SELECT * FROM tn")
def context_topn(spark, sf_dir):
    return cx.context_top(_contexts(spark, sf_dir), 5, 1)


@query(f"{FACTS}, {_CTX}, {_TOPN} SELECT e AS id, 'Describe it.' || chr(10) || 'Entity name: Entity_' || e || chr(10) || 'Evidence:' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY place) || chr(10) || 'At most 120 words.' || chr(10) AS content FROM ent JOIN tn ON tn.kind = 'entity' AND tn.id = e GROUP BY e")
def description_messages(spark, sf_dir):
    top = cx.context_top(_contexts(spark, sf_dir), 5, 1)
    items = entity_names(spark, sf_dir).select(F.lit("entity").alias("kind"), "id", "name")
    made = cx.messages(items, top, system="You describe entities.", task=F.lit("Describe it."))
    return made.select("id", F.col("messages")[1]["content"].alias("content"))


@query("WITH l AS (SELECT greatest((len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) + 1 - 1) // 256, 0) AS bin FROM documents) SELECT bin, (bin * 256 + 1) || '-' || ((bin + 1) * 256) AS label, count(*) AS n, (bin + 1) * 256 > 2048 AS over FROM l WHERE bin IS NOT NULL GROUP BY bin")
def length_histogram(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return tr.length_histogram(d, F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f\\x0B]+")) + 1, 256, 2048)


@query("WITH w AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'), lambda x: length(x)) AS p FROM conversations), b AS (SELECT conv_id, max(len(p) + 2) AS m FROM w GROUP BY conv_id) SELECT conv_id, turn, len(p) + 2 AS total_len, (ceil(m / 8.0) * 8)::BIGINT AS padded, (list_sum(p) + 1)::BIGINT AS id_sum, len(p) * -100 + 2 + -100 * ((ceil(m / 8.0) * 8)::BIGINT - len(p) - 2) + 1 - 2 - 1 AS label_sum FROM w JOIN b USING (conv_id)")
def sft_items(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    prompt = F.transform(F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r\\f\\x0B]+"), F.lit(0)), lambda w: F.length(w))
    rows = tr.items(c, prompt, F.array(F.lit(1)), end_id=1).where("total_len <= 4096")
    rows = tr.padded(rows, F.col("conv_id"), pad_id=0)
    total = lambda col: F.aggregate(col, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", "turn", "total_len", F.size("input_ids").cast("long").alias("padded"), (total("input_ids") - 1).alias("id_sum"), (total("labels") - 2).alias("label_sum"))
