"""What the registered queries share: the events as facts, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Days from which facts are validation and test facts.
VALID_FROM, TEST_FROM = 24, 27
HISTORY, SHORT_HISTORY, RECENT = 50, 20, 256


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where that can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """A written copy below the session's checkpoint folder, for what a query uses more than once."""
    from ..streaming.facts import stream_folder

    path = stream_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts: user -[event type]-> k on a day; (seq, s, r, o, t, split)."""
    from ..operators.facts import split_by_time
    events = table(spark, sf_dir, "events")
    kinds = _few(relation_names(spark, sf_dir)).select(F.col("id").alias("r"), F.col("name").alias("event_type"))
    f = events.join(kinds, "event_type").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("long").alias("s"), "r", F.get_json_object("props", "$.k").cast("long").alias("o"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("t"),
    )
    return split_by_time(f, VALID_FROM, TEST_FROM)


def _few(names: DataFrame, most: int = 1000) -> DataFrame:
    """A dictionary of at most ``most`` rows as rows at hand, which are broadcast; a larger one as it is."""
    rows = names.limit(most + 1).collect()
    return F.broadcast(names.sparkSession.createDataFrame(rows, names.schema)) if len(rows) <= most else names


def relation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name) of the event types in alphabetical order."""
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).where("name IS NOT NULL").distinct()
    return kinds.select((F.row_number().over(W.orderBy("name")) - 1).cast("long").alias("id"), "name")


def relation_total(spark: SparkSession, sf_dir: str) -> int:
    """Number of relations: of event types, which is a scan of one column."""
    return relation_names(spark, sf_dir).count()


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name) of every entity of the facts: ``Entity_`` and its id."""
    from ..operators.ranking import entities

    e = entities(facts(spark, sf_dir))
    return e.select(F.col("entity").alias("id"), F.concat(F.lit("Entity_"), F.col("entity").cast("string")).alias("name"))


#: The facts, the number of relations and the entities as SQL.
FACTS = """WITH rel AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS r FROM (SELECT DISTINCT event_type FROM events)),
f AS MATERIALIZED (SELECT event_id AS seq, user_id::BIGINT AS s, rel.r::BIGINT AS r, json_extract_string(props, '$.k')::BIGINT AS o,
 date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS t FROM events JOIN rel USING (event_type)),
nr AS (SELECT count(*) AS n FROM rel),
ent AS MATERIALIZED (SELECT DISTINCT unnest([s, o]) AS e FROM f)"""
#: Queries of both directions, and their true answers.
ASKED = """qs AS MATERIALIZED (SELECT seq, 0 AS dir, s AS e, r, o AS answer, t FROM f UNION ALL SELECT seq, 1, o, r + (SELECT n FROM nr), s, t FROM f)"""
#: Both directions as facts.
BOTH = "b AS MATERIALIZED (SELECT seq, s, r, o, t FROM f UNION ALL SELECT seq, o, r + (SELECT n FROM nr), s, t FROM f)"
#: Incidences with their position, and the number of earlier ones by (entity, time).
INC = """inc AS MATERIALIZED (SELECT e, row_number() OVER (PARTITION BY e ORDER BY t, seq, role) AS p, seq, t, s, r, o
 FROM (SELECT s AS e, 0 AS role, * FROM f UNION ALL SELECT o, 1, * FROM f)),
et AS MATERIALIZED (SELECT e, t AS q, coalesce(sum(c) OVER (PARTITION BY e ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n
 FROM (SELECT e, t, count(*) AS c FROM inc GROUP BY e, t))"""


def hist_sql(name: str, limit: int) -> str:
    return f"{name} AS MATERIALIZED (SELECT et.e, et.q, et.n - inc.p + 1 AS rank, inc.seq, inc.t, inc.s, inc.r, inc.o FROM et JOIN inc ON inc.e = et.e AND inc.p <= et.n AND inc.p > et.n - {limit})"
