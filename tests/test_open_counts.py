"""Counts of open intervals: against brute force, SQL on odd rows, and by the rows that the plans make on dense tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandwise.operators import intervals as iv
from strandwise.plans import catalog


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_open_counts_against_brute_force(spark, width):
    rng = random.Random(21)
    items = [(rng.choice(["a", "b", "c", None]), s := rng.randint(-90, 90), s + rng.choice([-4, 0, 1, 2, 9, 60, 500])) for _ in range(70)] + [("d", None, 5), ("d", 5, None), ("e", -10**9, 10**9)]
    frame = spark.createDataFrame(items, "f string, start long, `end` long")
    points = [rng.randint(-120, 700) for _ in range(120)] * 2 + [None, 10**8, -(10**8), 10**10]
    want = {}
    for p in set(points) - {None}:
        for f, s, e in items:
            if s is not None and e is not None and s <= p < e:
                want[p, f] = want.get((p, f), 0) + 1
    got = iv.open_counts(spark.createDataFrame([(p,) for p in points], "pos long"), frame, "f", bin_width=width).collect()
    assert len(got) == len(want) and {(r.pos, r.f): r.n for r in got} == want
    assert iv.open_counts(spark.createDataFrame([], "pos long"), frame, "f", bin_width=width).count() == 0
    assert iv.open_counts(spark.createDataFrame([(1,)], "pos long"), frame.limit(0), "f", bin_width=width).count() == 0


def made_rows(frame):
    """Most rows that any node of the executed plan made."""
    frame.collect()
    found, left = [0], [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        inner = "executedPlan" if kind == "AdaptiveSparkPlanExec" else "plan" if kind.endswith("QueryStageExec") else None
        left += [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        found += [rows.get().value()] if rows.isDefined() else []
    return max(found)


def events(path, sql):
    con = duckdb.connect()
    con.sql(f"COPY ({sql}) TO '{path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return con


ODD = """SELECT CASE WHEN i % 17 = 3 THEN NULL WHEN i % 5 = 0 THEN i // 50 ELSE 1000 + i END AS event_id,
 CASE WHEN i % 23 <> 5 THEN TIMESTAMP '2024-01-01' + to_microseconds((i * 7919 % 400) * 40250000) END AS ts,
 CASE WHEN i % 11 <> 7 THEN i * 31 % 300 - 60 END AS user_id, CASE i % 4 WHEN 0 THEN 'view' WHEN 1 THEN NULL ELSE 'purchase' END AS event_type, CAST(i AS DOUBLE) AS value FROM range(600) t(i)"""
DENSE = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i % 100) AS ts, i AS user_id, 'purchase' AS event_type, 1.0 AS value FROM range(4000) t(i)"


def odd_and_dense(spark, path, name):
    for sub, sql in (("odd", ODD), ("dense", DENSE)):
        (path / sub).mkdir()
        con, made = events(path / sub, sql), catalog.QUERIES[name](spark, str(path / sub))
        rows = made_rows(made)
        got, want = ([tuple(map(str, r)) for r in x] for x in (made.collect(), con.sql(f"SELECT {', '.join(made.columns)} FROM ({catalog.ORACLE[name]})").fetchall()))
        assert sorted(got) == sorted(want) and len(got) > 300
    assert 4000 <= rows <= 20 * 4000  # 16 million pairs of an event and an interval


def test_open_list_on_odd_and_dense_tables(spark, tmp_path):
    odd_and_dense(spark, tmp_path, "I11_open_in_list")


def test_open_in_files_on_odd_and_dense_tables(spark, tmp_path):
    odd_and_dense(spark, tmp_path, "J5_open_in_files")
