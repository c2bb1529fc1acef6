"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from crawlwright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    same = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(map(same, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    sql = duck.sql(catalog.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    kinds = dict(zip(sql.columns, map(str, sql.types), strict=True))
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds
    assert plain(map(tuple, df.select(cols).collect())) == plain(duck.sql(f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})").fetchall())


def test_every_query_has_rows_or_is_a_filter(spark):
    assert len(catalog.QUERIES) >= 70
    assert catalog.entry(spark, SF).count() > 0
