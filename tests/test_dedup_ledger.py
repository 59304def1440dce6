"""The dedup ledger where its order leaves rows tied or null: against SQL, and against a plain count of rows alike in all columns."""

import random

import duckdb
import pytest

from strandwise.operators import ranking as R
from strandwise.plans import catalog


def test_ties_and_nulls_against_sql(spark, tmp_path):
    """Rows of one order and line in a part but of other suppliers, and null orders, lines and parts; no two rows are alike."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT DISTINCT CASE WHEN i % 7 <> 0 THEN i % 3 END AS l_orderkey, CASE WHEN i % 11 <> 0 THEN CAST(i % 2 AS INTEGER) END AS l_linenumber,
      CASE WHEN i % 13 <> 0 THEN i * 17 % 40 ELSE CASE WHEN i % 2 = 0 THEN 900 + i END END AS l_partkey, CASE WHEN i % 5 <> 0 THEN i * 31 % 6 END AS l_suppkey FROM range(900) t(i)) TO '{tmp_path}/lineitem.parquet'""")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = [tuple(map(str, r)) for r in catalog.QUERIES["P20_dedup_ledger"](spark, str(tmp_path)).collect()]
    want = [tuple(map(str, r)) for r in con.sql(catalog.ORACLE["P20_dedup_ledger"]).fetchall()]
    assert sorted(got) == sorted(want) and len(got) > 200


@pytest.mark.parametrize("copies", [2, 1 << 16])
def test_rows_alike_keep_one(spark, monkeypatch, copies):
    monkeypatch.setattr(R, "COPIES", copies)
    rng = random.Random(23)
    data = [(rng.choice(["a", "b", None, str(i)]), rng.choice([1, 2]), rng.choice([0, 0, 5])) for i in range(120)] * 3 + [("only", 1, 1)]
    made = R.dedup_ledger(spark.createDataFrame(data, "name string, allele int, at int").repartition(5), "name", ["name", "allele"], ["at"]).collect()
    assert sorted((str(r.name), r.allele, r.at) for r in made) == sorted((str(n), a, t) for n, a, t in data if n != "only")
    for of, flag in ((lambda r: (r.name,), "removed_by_name"), (lambda r: (r.name, r.allele), "same_allele_key")):
        kept = [r for r in made if not r[flag]]
        assert len(kept) == len({of(r) for r in kept}) == len({of(r) for r in made})
        assert all(r["at"] == min(x["at"] for x in made if of(x) == of(r)) for r in kept)
    assert all(not r.same_allele_key for r in made if not r.removed_by_name)
