"""Every core query with SQL against DuckDB on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from tarnwork.plans import analysis_queries, funnel_queries, parser_queries, skew_queries, source_queries, stage_queries

DATA = "/root/testdata/sf0.001"
MODULES = [skew_queries, funnel_queries, analysis_queries, parser_queries, source_queries, stage_queries]
CASES = [(n, m.QUERIES[n], m.SQL[n]) for m in MODULES for n in m.SQL]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else str(v)


def rows(cols, data):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_equals_sql(spark, duck, name, query, sql):
    df = query(spark, DATA)
    got = duck.execute(sql)
    cols = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, got.fetchall())


def test_queries_without_sql_run(spark):
    for m in MODULES:
        for n in set(m.QUERIES) - set(m.SQL):
            assert m.QUERIES[n](spark, DATA).count() >= 0
