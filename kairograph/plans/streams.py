"""Streaming queries over the event files, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import small
from ..streaming import facts as st
from ..streaming import history as sh
from .common import FACTS, INC, query, relation_names, table


def _stream(spark, sf_dir) -> DataFrame:
    """The event files as a stream of facts (ts, seq, s, r, o, t)."""
    schema = table(spark, sf_dir, "events").schema
    kinds = relation_names(spark, sf_dir).select(F.col("id").alias("r"), F.col("name").alias("event_type"))
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return events.join(small(kinds), "event_type").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("user_id").cast("long").alias("s"), "r",
        F.get_json_object("props", "$.k").cast("long").alias("o"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("t"),
    )


@query(f"{FACTS} SELECT s, r, o, min(t) AS first_t FROM f GROUP BY s, r, o")
def stream_first_seen(spark, sf_dir):
    return st.run_to_table(st.first_seen(_stream(spark, sf_dir)), "complete")


@query("WITH rel AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS r FROM (SELECT DISTINCT event_type FROM events)) SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, r, count(*) AS facts FROM events JOIN rel USING (event_type) GROUP BY ALL")
def stream_daily_snapshots(spark, sf_dir):
    out = st.run_to_table(st.windowed_snapshots(_stream(spark, sf_dir), "ts", "1 day"), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "r", "facts")


@query(f"{FACTS}, c AS (SELECT s, t, sum(count(*)) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n, lag(t) OVER (PARTITION BY s ORDER BY t) AS p FROM f GROUP BY s, t) SELECT s AS e, seq, f.t, s, r, o, least(coalesce(n, 0), 50)::BIGINT AS n_before, p AS newest_t FROM f JOIN c USING (s, t)")
def stream_rolling_history(spark, sf_dir):
    return st.run_to_table(st.rolling_history(_stream(spark, sf_dir), 50), "append")


@query(f"{FACTS}, {INC} SELECT et.e, et.q, (et.n - inc.p + 1)::INT AS rank, inc.seq, inc.t, inc.s, inc.r, inc.o FROM et JOIN inc ON inc.e = et.e AND inc.p <= et.n AND inc.p > et.n - 20 WHERE et.q < (SELECT max(t) FROM f)")
def stream_newest_facts(spark, sf_dir):
    """The 20 newest facts of every entity before each day that the stream has closed."""
    return sh.run_rolling(sh.newest_facts(_stream(spark, sf_dir), 20))
