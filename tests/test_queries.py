"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(tidy(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    found = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


def test_flagship_query_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, column, table", [("auto_counts", "l_quantity", "lineitem"), ("density_normalisation", "l_quantity", "lineitem"), ("labelled_states", "p_partkey", "part")])
def test_query_scans_a_column_of_a_table(spark, name, column, table):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if f"{table}.parquet" in line]
    assert any(column in line.split("ReadSchema")[-1] for line in scans)
