"""Every registered query of the engine against its SQL twin in DuckDB."""

import duckdb
import pytest

from kairograph.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET threads=1")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(plain(tuple(r))) for r in df.select(*cols).collect())
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = sorted(repr(plain(tuple(r[names.index(c)] for c in cols))) for r in result.fetchall())
    assert got == want
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["mode", "num_eval"]
    assert set(ORACLE) <= set(e.oracle_sql())
