"""Queries with an SQL twin against DuckDB, the others for their columns and row counts."""

import importlib.util
import pathlib

import duckdb
import pytest

from terrasift.llm.queries import ORACLE_SQL, QUERIES

from .conftest import SF

TOOL = pathlib.Path(__file__).resolve().parents[2] / "tools" / "check_oracle.py"
spec = importlib.util.spec_from_file_location("check_oracle", TOOL)
tool = importlib.util.module_from_spec(spec)
spec.loader.exec_module(tool)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert tool.rows_of(df.columns, df.collect()) == tool.rows_of(columns, cur.fetchall())


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
