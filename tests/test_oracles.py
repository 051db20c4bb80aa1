"""Every query with SQL gives the rows of its DuckDB statement on the smallest tables."""

import math

import duckdb
import pytest

from lexiline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rel = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).columns
