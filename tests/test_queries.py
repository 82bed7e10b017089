"""Every query with SQL equals DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from weft.plans import catalogue
from weft.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: [None if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in df[c]] for c in sorted(df.columns)})
    return out.fillna("<null>").sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    pd.testing.assert_frame_equal(plain(got), plain(want))


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_commits_are_numbered_by_days_and_not_by_events(spark):
    plan = catalogue._history(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    assert windows and all("Aggregate [" in plan[i + 1] for i in windows)
