"""Forecasts over several steps, with and without their own answers as history."""

from __future__ import annotations

from ..operators import forecast as fc
from .common import FACTS, TEST_FROM, facts, query, relation_total, written

#: Snapshots of a step's history, answers of a query, and steps.
WINDOW, TOP, STEPS = 5, 3, 3


def _unrolled(feedback: bool) -> str:
    """The steps one after the other as SQL; a step without answers would leave the window, here it has some."""
    parts = [
        FACTS,
        "ts AS MATERIALIZED (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM f))",
        f"k0 AS MATERIALIZED (SELECT min(k) AS k FROM ts WHERE t >= {TEST_FROM})",
        f"w0 AS MATERIALIZED (SELECT f.t, s, r, o FROM f JOIN ts USING (t), k0 WHERE ts.k BETWEEN k0.k - {WINDOW} AND k0.k - 1)",
    ]
    for i in range(STEPS):
        parts += [
            f"q{i} AS MATERIALIZED (SELECT DISTINCT f.t, s AS e, r FROM f JOIN ts USING (t), k0 WHERE ts.k = k0.k + {i})",
            f"c{i} AS MATERIALIZED (SELECT s AS e, r, o AS entity, count(*)::DOUBLE AS score FROM w{i} GROUP BY ALL)",
            f"a{i} AS MATERIALIZED (SELECT t, e, r, row_number() OVER (PARTITION BY t, e, r ORDER BY score DESC, entity)::INT AS place, entity, score FROM q{i} JOIN c{i} USING (e, r) QUALIFY place <= {TOP})",
            f"n{i} AS (SELECT DISTINCT t, e AS s, r, entity AS o FROM a{i})" if feedback else f"n{i} AS (SELECT f.t, s, r, o FROM f JOIN ts USING (t), k0 WHERE ts.k = k0.k + {i})",
            f"w{i + 1} AS MATERIALIZED (SELECT w.t, s, r, o FROM w{i} w JOIN ts USING (t), k0 WHERE ts.k > k0.k + {i} - {WINDOW} UNION ALL SELECT t, s, r, o FROM n{i})",
        ]
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM a{i}" for i in range(STEPS))


def _run(spark, sf_dir, feedback):
    f = written(facts(spark, sf_dir).select("t", "s", "r", "o"))
    return fc.forecast(f, TEST_FROM, window=WINDOW, k=TOP, n_rel=relation_total(spark, sf_dir), cut=written, steps=STEPS, feedback=feedback)


@query(_unrolled(True))
def forecast_feedback(spark, sf_dir):
    """Three steps ahead: the top answers of a step are history of the next."""
    return _run(spark, sf_dir, True)


@query(_unrolled(False))
def forecast_steps(spark, sf_dir):
    """One step ahead at a time: the true facts follow each step."""
    return _run(spark, sf_dir, False)

