"""Every query runs; those with an oracle equal DuckDB's result on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from twigspark.plans.catalog import ORACLES, QUERIES

@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return con


def shown(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return "null"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | np.integer | np.floating):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(shown, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, sf, duck, name):
    got, want = rows(QUERIES[name](spark, sf).toPandas()), rows(duck.execute(ORACLES[name]).fetchdf())
    assert got == want and got[1]


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*ORACLES}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
