"""Every registered query with SQL gives the rows that DuckDB gives for it; those without give some."""

import os

import duckdb
import pandas as pd
import pytest

from grainsieve.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def cell(v):
    if isinstance(v, str):
        return v
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    return f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)


def rows(df):
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)
