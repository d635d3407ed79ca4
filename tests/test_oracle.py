"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as from read_parquet('{sf}/{t}.parquet')")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (float, np.floating)):
        return f"{round(float(x), 6):.6g}"
    return str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(cell(float(x) if df[c].dtype.kind == "f" else x) for c, x in zip(df.columns, r, strict=True)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry_is_stable(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["q", "stage", "item", "rank", "score", "candidate_count", "tie_at_last"]
    assert df.count() > 0
