"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from granary.plans import queries as plans


def rows(df: pd.DataFrame) -> tuple[list[str], list]:
    df = df[sorted(df.columns)].astype(object)

    def cell(v):
        if v is None or (not isinstance(v, (list, str)) and pd.isna(v)):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return list(df.columns), sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert rows(plans.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(plans.SQL[name]).df())


def test_every_query_without_sql_runs(spark, sf_dir):
    for name in sorted(set(plans.QUERIES) - set(plans.SQL)):
        assert plans.QUERIES[name](spark, sf_dir).count() > 0, name


def test_entry_gives_rows(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    plan = plans.QUERIES["point_lookup_ids"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
