"""Every registered query against its SQL twin on the smallest tables."""

import importlib.util
import pathlib

import duckdb
import pytest

from terrasift.plans import registry

SF = "/root/testdata/sf0.001"
TOOL = pathlib.Path(__file__).resolve().parents[1] / "tools" / "check_oracle.py"
spec = importlib.util.spec_from_file_location("check_oracle", TOOL)
tool = importlib.util.module_from_spec(spec)
spec.loader.exec_module(tool)

QUERIES = registry.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in tool.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_matches_sql(spark, con, name):
    q = QUERIES[name]
    df = q.build(spark, SF)
    got = df.collect()
    cur = con.execute(q.sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert tool.rows_of(df.columns, got) == tool.rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_runs(spark, name):
    assert QUERIES[name].build(spark, SF).count() > 0
