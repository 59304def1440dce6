"""Every catalogued query against its SQL, run by DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from strandwise.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return round(float(v), 6)
    return list(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(v) for v in r]) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, small, name):
    ours, theirs = catalog.QUERIES[name](spark, small).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs_without_sql(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
