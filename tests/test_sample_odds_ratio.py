"""The sample odds ratio where cells are empty."""

import duckdb

from strandwise.operators import stats as S
from strandwise.plans import catalog


def test_empty_cells(spark):
    cells = [(6, 2, 3, 4, 4.0), (0, 2, 3, 4, 0.0), (6, 2, 3, 0, 0.0), (6, 0, 3, 4, None), (6, 2, 0, 4, None), (6, 0, 0, 4, None), (0, 0, 3, 4, None), (0, 0, 0, 0, None)]
    got = spark.createDataFrame(cells, "a long, b long, c long, d long, want double").select("want", S.sample_or().alias("ratio")).collect()
    assert [r.ratio for r in got] == [r.want for r in got]


def test_ratio_of_tops_that_all_lie_inside(spark, tmp_path):
    """Purchases reach so far that only the first three events, over six minutes before, are outside."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(CASE WHEN i < 3 THEN i ELSE 400 + i END) AS ts, 500 AS user_id,
      CASE WHEN i = 3 THEN 'purchase' ELSE 'view' END AS event_type, 1.0 AS value FROM range(300) t(i)) TO '{tmp_path}/events.parquet'""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = {(r.ranking, r.depth): r.odds_ratio for r in catalog.QUERIES["TSOR_sample_odds_ratio"](spark, str(tmp_path)).collect()}
    want = {(k, d): x for k, d, x in con.sql(catalog.ORACLE["TSOR_sample_odds_ratio"]).fetchall()}
    assert got == want and None in want.values() and any(want.values())
