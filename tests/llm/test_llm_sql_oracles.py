import math

import duckdb
import pandas as pd
import pytest

from strandwise.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "conversations", "benchmark")


def rows(frame):
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else v if isinstance(v, str) else float(v)
    return sorted(str([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))



@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, small).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
