"""Quantiles by selection against sorting, and exact tests by ratios against whole fractions."""

import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import quantiles as Q
from strandwise.operators import stats as S

PROBS = {"low": 0.0, "q025": 0.025, "third": 1 / 3, "median": 0.5, "p95": 0.95, "top": 1.0}


def values(rng):
    same = [7.25] * 300
    near = [1.0 + k * 2.0**-52 for k in range(-40, 40)]
    wide = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(120)]
    return {
        "ties": same + [rng.uniform(0, 10) for _ in range(200)],
        "near": near * 3,
        "wide": wide,
        "signs": [rng.gauss(0, 1) for _ in range(401)] + [0.0, -0.0, 5e-324, -5e-324],
        "one": [3.5],
        "two": [1.0, 2.0],
        None: [float(rng.randint(-3, 3)) for _ in range(90)],
        "endless": [float("inf"), float("-inf"), 1.0, 2.0, float("inf")],
    }


@pytest.mark.parametrize("few, parts", [(1 << 16, 1 << 16), (0, 1 << 16), (3, 8)])
def test_quantiles_against_sorting(spark, monkeypatch, few, parts):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "PARTS", parts)
    groups = values(random.Random(2))
    rows = [(g, v, "x") for g, vs in groups.items() for v in vs] + [("ties", None, "x"), ("ties", float("nan"), "x"), ("only null", None, "x"), (None, None, "x")]
    frame = spark.createDataFrame(rows, "g string, v double, n string").repartition(7)
    got = {r.g: r for r in Q.quantiles(frame, ["g"], "v", PROBS).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        if g == "endless":
            assert got[g].low == -math.inf and got[g].top == math.inf and got[g].median == 2.0
            continue
        for name, p in PROBS.items():
            want, s = float(np.quantile(vs, p)), sorted(vs)
            i = math.floor(p * (len(s) - 1))
            want = s[i] if s[i] == s[min(i + 1, len(s) - 1)] else want
            assert got[g][name] == pytest.approx(want, rel=1e-12, abs=5e-324)


def test_quantiles_without_groups_and_without_rows(spark):
    frame = spark.range(1001).select((F.col("id") % 97).cast("int").alias("v"))
    want = np.quantile([i % 97 for i in range(1001)], [0.5, 0.95])
    r = Q.quantiles(frame, [], "v", {"a": 0.5, "b": 0.95}).first()
    assert (r.a, r.b, r.n) == (want[0], pytest.approx(want[1]), 1001)
    assert [tuple(r) for r in Q.quantiles(frame.limit(0), [], "v", {"a": 0.5}).collect()] == [(0, None)]
    assert Q.quantiles(frame.limit(0).withColumn("g", F.lit(1)), ["g"], "v", {"a": 0.5}).count() == 0


def test_no_sort_of_raw_values(spark):
    """Raw values are only counted: every window and sort of the plan works on counts."""
    frame = spark.range(5000).select((F.col("id") % 7).alias("g"), F.rand(3).alias("v"))
    plan = Q.quantiles(frame, ["g"], "v", {"m": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "Window" not in plan.split("== Physical Plan ==")[1]


def by_fractions(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    w = {x: math.comb(row, x) * math.comb(n - row, col - x) for x in range(max(0, row + col - n), min(row, col) + 1)}
    total = sum(w.values())
    return w, float(Fraction(sum(v for x, v in w.items() if x >= a), total)), float(Fraction(sum(v for v in w.values() if v * 10**7 <= w[a] * (10**7 + 1)), total))


def share(w, psi, keep):
    """P(keep) under the odds ratio psi in whole fractions."""
    psi = Fraction(psi)
    low = min(w)
    weights = {x: v * psi ** (x - low) for x, v in w.items()}
    return float(sum(v for x, v in weights.items() if keep(x)) / sum(weights.values())), float(sum(x * v for x, v in weights.items()) / sum(weights.values()))


def test_small_cells_against_fractions():
    rng = random.Random(7)
    cells = [tuple(rng.randint(0, rng.choice([2, 6, 25])) for _ in range(4)) for _ in range(250)] + [(0, 0, 0, 0), (0, 0, 3, 4), (60, 0, 0, 60), (0, 60, 60, 0), (200, 1, 1, 200)]
    for cell in cells:
        est, low, high, greater, two = S.conditional(*cell)
        w, want_greater, want_two = by_fractions(*cell)
        a = cell[0]
        assert greater == pytest.approx(want_greater, rel=1e-10) and two == pytest.approx(want_two, rel=1e-10), cell
        if len(w) == 1:
            assert math.isnan(est) and (low, high) == (0.0, math.inf)
            continue
        assert (est == 0) == (low == 0) == (a == min(w)) and (est == math.inf) == (high == math.inf) == (a == max(w))
        if 0 < est < math.inf:
            assert share(w, est, bool)[1] == pytest.approx(a, rel=1e-9), cell
        if low > 0:
            assert share(w, low, lambda x: x >= a)[0] == pytest.approx(0.025, rel=1e-9), cell
        if high < math.inf:
            assert share(w, high, lambda x: x <= a)[0] == pytest.approx(0.025, rel=1e-9), cell


def test_far_tails_keep_their_size():
    cell = (90, 10, 200, 4000)
    _, greater, two = by_fractions(*cell)
    _, _, _, got, got_two = S.conditional(*cell)
    assert got == pytest.approx(greater, rel=1e-9) and got_two == pytest.approx(two, rel=1e-9) and 0 < got < 1e-60


def test_cells_of_ten_thousand_million_records():
    """Symmetric cells have known answers; time and memory follow the width of the weights."""
    began = time.time()
    est, low, high, greater, two = S.conditional(*[2_500_000_000] * 4)
    assert est == pytest.approx(1, rel=1e-9) and low * high == pytest.approx(1, rel=1e-9) and two == pytest.approx(1)
    assert math.log(high) == pytest.approx(1.959964 * math.sqrt(4 / 2.5e9), rel=1e-3) and greater == pytest.approx(0.5, abs=1e-4)
    est, low, high, greater, _ = S.conditional(25, 175, 10**9, 10**10)
    assert est == pytest.approx(25 / 175 * 10, rel=1e-6) and low < est < high and 0.01 < greater < 0.2
    assert time.time() - began < 10


def test_p_greater_falls_as_the_cell_grows():
    p = [S.conditional(a, 1000 - a, 10**8, 10**9)[3] for a in range(60, 200, 10)]
    assert all(x > y for x, y in zip(p, p[1:])) and p[0] > 0.999
