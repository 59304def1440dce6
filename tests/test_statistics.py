"""Exact statistics by their defining equations, linkage, ranking and bootstrap rules."""

import hashlib
import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import linkage as L
from strandwise.operators import ranking as R
from strandwise.operators import resample as B
from strandwise.operators import stats as S


def test_known_values():
    _, _, _, greater, two = S.conditional(3, 1, 1, 3)
    assert abs(greater - 17 / 70) < 1e-12 and abs(two - 34 / 70) < 1e-12
    assert abs(S.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert S.conditional(0, 0, 3, 4)[3:] == (1.0, 1.0)


def test_unbounded_interval_is_null_with_flag(spark):
    t = spark.createDataFrame([(5, 0, 3, 9), (2, 3, 4, 5)], "a long, b long, c long, d long")
    rows = sorted(S.with_exact(t).collect(), key=lambda r: r.a)
    assert rows[0].ci_high is not None and not rows[0].ci_high_unbounded
    assert rows[1].ci_high is None and rows[1].ci_high_unbounded and rows[1].odds_ratio is None


def test_linkage_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 2, 60), rng.integers(0, 2, 60)
    data = [("p", i, v, None if (v == "b" and i % 9 == 0) else int(a)) for v, col in (("a", x), ("b", y)) for i, a in enumerate(col)]
    h = spark.createDataFrame(data, "population string, hap int, variant string, allele int")
    r = L.linkage(L.pair_counts(h.where("variant = 'a'"), h.where("variant = 'b'"))).first()
    keep = np.arange(60) % 9 != 0
    assert abs(r.r2 - np.corrcoef(x[keep], y[keep])[0, 1] ** 2) < 1e-12
    few = L.linkage(L.pair_counts(h.where("variant = 'a' AND hap < 10"), h.where("variant = 'b'")))
    assert few.first().r2 is None


def test_packed_counts_against_rows(spark):
    """Words of 64, haplotype numbers with gaps and below zero, repeated rows, missing alleles, and pairs that never meet."""
    rng = random.Random(12)
    haps = [-70, -1, 0, 1, 62, 63, 64, 65, 127, 128, 500, 10**12]
    data = [(p, h, v, rng.choice([0, 1, 1, None])) for p in ("a", "b") for h in haps for v in range(5) if rng.random() < 0.8]
    data += [("a", -1, 7, 1), ("b", 0, 8, None), (None, 3, 0, 1)]
    frame = spark.createDataFrame(data + data[:9], "population string, hap long, variant int, allele int")
    at = {(p, h, v): x for p, h, v, x in data if p}
    want = {}
    for (p, h, v), x in at.items():
        for w in (2, 3, 4, 7, 8):
            y = at.get((p, h, w))
            if v < 2 and x is not None and y is not None:
                want.setdefault((p, v, w), []).append((x, y))
    want = {k: (len(s), sum(x for x, _ in s), sum(y for _, y in s), sum(x * y for x, y in s)) for k, s in want.items()}
    got = {(r.population, r.v1, r.v2): (r.n, r.x, r.y, r.xy) for r in L.pair_counts(frame.where("variant < 2"), frame.where("variant >= 2")).collect()}
    assert got == want
    words = L.packed(frame)
    assert words.count() == len({(p, h // 64, v) for p, h, v in at}) < len(at) and {f.name: f.dataType.simpleString() for f in words.schema if f.name in ("alt", "known")} == {"alt": "bigint", "known": "bigint"}


def test_ranking_nulls_and_depths(spark):
    s = spark.createDataFrame([("r", 1, 0.5), ("r", 2, -0.9), ("r", 3, None), ("r", 4, 0.5)], "ranking string, id int, score double")
    assert [x.id for x in R.ranked(s, ["ranking"], "score", "id").orderBy("rank").collect()] == [2, 1, 4]
    assert R.ranked(s, ["ranking"], "score", "id", nulls="first").where("rank = 1").first().id == 3
    cells = R.two_by_two(R.ranked(s, ["ranking"], "score", "id").withColumn("f", F.col("id") == 2), ["ranking"], "f", (1, 3))
    assert [tuple(r) for r in cells.collect()] == [("r", 1, 1, 0, 0, 2)]


def test_ranks_by_buckets(spark):
    """Ranks put together from buckets, on ties, zeros, both signs, extreme values and a null group."""
    rng = random.Random(9)
    values = [rng.choice([0.0, -0.0, 1e-300, 5e-324, 1e300, float("inf"), rng.uniform(-2, 2), round(rng.uniform(-2, 2), 1), float(rng.randint(-5, 5))]) for _ in range(400)]
    data = [(rng.choice(["a", "b", None]), i, None if i % 37 == 0 else v * rng.choice([1, -1])) for i, v in enumerate(values)]
    frame = spark.createDataFrame(data, "g string, id int, v double")
    own = lambda g: [(i, v) for h, i, v in data if h == g and v is not None]
    ranks = {r.id: r["rank"] for r in R.ranked_whole(frame, ["g"], "v", "id").collect()}
    shares = {r.id: r.percentile for r in R.percentile_of(frame, ["g"], "v").collect()}
    means = {r.id: r.m for r in R.with_average_rank(frame.where("v IS NOT NULL"), ["g"], "v", "m").collect()}
    for g in ("a", "b", None):
        rows = own(g)
        for n, (i, v) in enumerate(sorted(rows, key=lambda r: (-abs(r[1]), r[0])), 1):
            assert ranks[i] == n
            assert abs(shares[i] - 100 * sum(abs(w) < abs(v) for _, w in rows) / len(rows)) < 1e-9
            assert means[i] == sum(w < v for _, w in rows) + (sum(w == v for _, w in rows) + 1) / 2
    assert len(ranks) == len(shares) == len(means) == sum(v is not None for *_, v in data)
    spread = spark.createDataFrame([(v,) for v in sorted(v * k for v in values for k in (1, -1))], "v double").coalesce(1).select(R.value_bucket(F.col("v"))).collect()
    assert spread == sorted(spread)


def test_top_tables_equal_two_by_two(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.choice(["a", "b", None]), i, rng.choice([None, rng.uniform(-1, 1), 0.5]), rng.random() < 0.3) for i in range(120)], "g string, id int, v double, f boolean")
    want = R.two_by_two(R.ranked(rows, ["g"], "v", "id"), ["g"], "f", (5, 20, 33)).collect()
    got = R.top_tables(rows, ["g"], "v", "id", "f", (5, 20, 33)).collect()
    key = lambda r: (str(r.g), r.depth)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len({key(r) for r in got}) == len(got)
    assert R.top_tables(rows.limit(0), ["g"], "v", "id", "f").count() == 0


def test_null_keys_are_equal_in_dedup(spark):
    d = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "k string, id int")
    assert sorted(r.id for r in R.first_by(d, ["k"], ["id"]).collect()) == [1, 3]
    assert d.select(R.allele_key("k", "id").alias("x")).first().x == "nan_1"


def test_weighted_cells_equal_copies(spark):
    rng = random.Random(5)
    data = [(i, rng.uniform(-1, 1), rng.random() < 0.4, rng.randint(0, 3)) for i in range(60)]
    frame = spark.createDataFrame(data, "id int, score double, f boolean, k long").withColumn("g", F.lit("g"))
    got = B.weighted_cells(frame, ["g"], "score", "id", ["f"], 25).first()
    copies = [(s, i, f) for i, s, f, k in data for _ in range(k)]
    copies.sort(key=lambda c: (-abs(c[0]), c[1]))
    top, rest = copies[:25], copies[25:]
    want = (sum(c[2] for c in top), sum(not c[2] for c in top), sum(c[2] for c in rest), sum(not c[2] for c in rest))
    assert (got.f_a, got.f_b, got.f_c, got.f_d) == want


@pytest.mark.parametrize("n_fixed", [0, 10, 120])
def test_bootstrap_cells_against_copied_records(spark, n_fixed):
    """Every replicate of two rankings with its records copied out, ties in the score included; without, with few and with many fixed records."""
    rng = random.Random(n_fixed)
    data = []
    for ranking in ("r1", "r2"):
        for i in range(n_fixed + 90):
            elem = None if i < n_fixed else rng.randrange(6)
            data.append((ranking, i, None if rng.random() < 0.05 else round(rng.uniform(-1, 1), 1), rng.random() < 0.4, elem is not None, elem))
    rows = spark.createDataFrame(data, "ranking string, id int, score double, f boolean, g boolean, elem int")
    made = B.draws(spark, [1, 2], 7, 6)
    times = {(r.seed, r.rep, r.elem): r.k for r in made.collect()}
    assert all(sum(times.get((s, r, e), 0) for e in range(6)) == 6 for s in (1, 2) for r in range(7))
    assert {k: n for k, n in times.items() if k[1] < 3} == {(r.seed, r.rep, r.elem): r.k for r in B.draws(spark, [1, 2], 3, 6).collect()}
    got = B.bootstrap_cells(rows, 6, [1, 2], 7, "ranking", "score", "id", ["f", "g"], 25).collect()
    assert len(got) == 28
    for r in got:
        copies = [(-abs(x[2]), x[1], x[3], x[4]) for x in data if x[0] == r.ranking and x[2] is not None for _ in range(1 if x[5] is None else times.get((r.seed, r.rep, x[5]), 0))]
        copies.sort()
        for at, name in ((2, "f"), (3, "g")):
            top, rest = [c[at] for c in copies[:25]], [c[at] for c in copies[25:]]
            assert [r[f"{name}_{c}"] for c in "abcd"] == [sum(top), len(top) - sum(top), sum(rest), len(rest) - sum(rest)]


@pytest.mark.parametrize("n, p", [(0, 0.3), (1, 0.5), (12, 0.1), (60, 0.93), (7, 0.0), (7, 1.0)])
def test_binomial_quantiles_by_fractions(n, p):
    exact, cdf = Fraction(p), []
    for k in range(n + 1):
        cdf.append((cdf[-1] if cdf else 0) + math.comb(n, k) * exact**k * (1 - exact) ** (n - k))
    u = np.array([(i + 0.5) / 997 for i in range(997)])
    assert B.binomial_quantiles(u, n, p).tolist() == [min(n, sum(f <= Fraction(x) for f in cdf)) for x in u]


def test_resampled_pairs_follow_the_law(spark):
    """Means and covariances of the multinomial law over many replicates; a panel of 10^7 haplotypes takes seconds; empty classes stay empty."""
    rows = [("small", 200, 90, 60, 40), ("large", 10**7, 4 * 10**6, 10**6, 5 * 10**5), ("none", 50, 0, 20, 0), ("all", 30, 30, 30, 30), (None, 40, 20, 20, 20)]
    frame = spark.createDataFrame(rows, "population string, n long, x long, y long, xy long")
    began = time.time()
    got = B.resampled_pairs(frame, ["population"], 9, 4000).toPandas()
    assert len(got) == 5 * 4000 and time.time() - began < 60
    for name, n, x, y, xy in rows[:2]:
        own = got[got.population == name]
        for column, members in (("x", x), ("y", y), ("xy", xy)):
            p = members / n
            assert abs(own[column].mean() - members) < 5 * (n * p * (1 - p) / 4000) ** 0.5
            assert own[column].var() == pytest.approx(n * p * (1 - p), rel=0.1)
        assert np.cov(own.x, own.y)[0, 1] == pytest.approx(xy - x * y / n, rel=0.35)
    none = got[got.population == "none"]
    assert (none.x == 0).all() and (none.xy == 0).all() and none.y.std() > 0
    assert (got[got.population == "all"][["x", "y", "xy"]] == 30).all().all()
    assert (got[got.population.isna()].x == got[got.population.isna()].xy).all()


def test_stability_grid_against_copied_records(spark, small):
    """The first and last replicates of every seed of the grid with all records copied out, and its intervals from all deltas."""
    from strandwise.plans import statistics_queries as Q

    rows = Q.boot_rows(spark, small).toPandas()
    elements = sorted(rows.start[rows.narrow].unique())
    number = {s: i for i, s in enumerate(elements)}
    rows["elem"] = [number[s] if n else -1 for s, n in zip(rows.start, rows.narrow)]
    rows = rows[rows.score.notna()].assign(size=lambda r: r.score.abs()).sort_values(["size", "event_id"], ascending=[False, True])
    deltas = Q.boot_deltas(spark, small, Q.GRID_SEEDS, max(Q.GRID)).toPandas()
    assert len(deltas) == 3 * 5000 * 6
    known = {(r.seed, r.rep, r.comparator): r.delta for r in deltas.itertuples()}
    for seed in Q.GRID_SEEDS:
        for rep in (0, 1, 2499, 4999):
            drawn = [int(hashlib.md5(f"{seed}|{rep}|{slot}".encode()).hexdigest()[:8], 16) % len(elements) for slot in range(len(elements))]
            value = {}
            for ranking, own in rows.groupby("ranking"):
                times = np.array([1 if e < 0 else drawn.count(e) for e in own.elem])
                top = np.arange(times.sum()) < 200
                logs = []
                for flag in (own.narrow, own.wide):
                    f = np.repeat(flag.to_numpy(dtype=bool), times)
                    a, b, c, d = (top & f).sum(), (top & ~f).sum(), (~top & f).sum(), (~top & ~f).sum()
                    logs.append(math.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))))
                value[ranking] = logs[0] - logs[1]
            for ranking in value:
                if ranking != "score_1":
                    assert abs(known[seed, rep, ranking] - (value["score_1"] - value[ranking])) < 1e-9
    grid = {(r.seed, r.replicates, r.comparator): r for r in Q.stability_grid(spark, small).collect()}
    assert len(grid) == 3 * 3 * 6
    for (seed, n, comparator), r in grid.items():
        own = deltas[(deltas.seed == seed) & (deltas.comparator == comparator) & (deltas.rep < n)].delta
        low, high = np.quantile(own, [0.025, 0.975])
        assert abs(r.ci_low - low) < 1e-9 and abs(r.ci_high - high) < 1e-9 and r.excludes_zero == (low > 0 or high < 0) and r.n == n


def test_whole_rankings_and_hits_against_brute_force(spark, small):
    from strandwise.plans import catalog, roles

    scores = roles.scores(spark, small).select("ranking", "event_id", "score").collect()
    want = set()
    for ranking in {r.ranking for r in scores}:
        own = sorted((-abs(r.score), r.event_id) for r in scores if r.ranking == ranking and r.score is not None)
        want |= {(ranking, e, i) for i, (_, e) in enumerate(own, 1)}
    got = [(r.ranking, r.event_id, r["rank"]) for r in catalog.QUERIES["W1_rank_by_abs"](spark, small).collect()]
    assert len(got) == len(want) > 700 and set(got) == want
    points = roles.records(spark, small).select("event_id", "pos").toPandas()
    peaks = roles.peaks(spark, small).where("set_id = 'purchase'").toPandas()
    hits = {}
    for p in peaks.itertuples():
        for e in points.event_id[(points.pos >= p.start) & (points.pos < p.end)]:
            hits[e, p.accession] = hits.get((e, p.accession), 0) + 1
    assert {(r.event_id, r.accession): r.n for r in catalog.QUERIES["J5_open_in_files"](spark, small).collect()} == hits


def test_perfect_lines_and_flat_columns(spark):
    """Defined results where a division by zero lurks: perfect lines, constant columns, two pairs."""
    up, flat = [(float(i), 2.0 * i + 1) for i in range(15)], [(float(i), 4.0) for i in range(15)]
    groups = {"up": up, "down": [(x, -y) for x, y in up], "flat y": flat, "flat x": [(y, x) for x, y in flat], "two": up[:2]}
    rows = spark.createDataFrame([(g, *p) for g, ps in groups.items() for p in ps], "g string, x double, y double")
    got = {r.g: r for r in S.regression(rows, ["g"], "x", "y").collect()}
    assert abs(got["up"].slope - 2) < 1e-12 and abs(got["up"].r - 1) < 1e-12 > abs(got["down"].r + 1) and got["up"].p == got["up"].se == got["down"].p == 0
    assert got["flat y"].slope == 0 and got["flat y"].r is None and got["flat y"].p is None and got["flat x"].slope is None and got["flat x"].p is None
    assert got["two"].p is None and got["two"].se is None
    rho = {r.g: (r.rho, r.p) for r in S.spearman(rows, ["g"], "x", "y").collect()}
    assert {g: (r if r is None else round(r, 9), p) for g, (r, p) in rho.items()} == {"up": (1.0, 0.0), "down": (-1.0, 0.0), "flat y": (None, None), "flat x": (None, None)}


def test_listwise_against_pairwise_missing(spark):
    """Zeros below 20 complete haplotypes, one against many; a haplotype with a gap in any partner is left out for all of them."""
    import numpy as np

    rng = np.random.default_rng(4)
    a = rng.integers(0, 2, (4, 60)).astype(float)
    a[1] = np.where(rng.random(60) < 0.8, a[0], 1 - a[0])
    a[2, ::7] = np.nan
    a[0, 3] = np.nan
    rows = [(p, h, v, None if np.isnan(a[v, h]) else int(a[v, h])) for p, n in (("big", 60), ("small", 22)) for h in range(n) for v in range(4)]
    haps = spark.createDataFrame(rows, "population string, hap long, variant int, allele int")
    got = {(r.population, r.v2): (r.n, r.r2) for r in L.linkage(L.listwise_counts(haps.where("variant = 0"), haps.where("variant > 0")), small_n="zero").collect()}
    for p, n in (("big", 60), ("small", 22)):
        ok = ~np.isnan(a[:, :n]).any(axis=0)
        for v in (1, 2, 3):
            x, y = a[0, :n][ok], a[v, :n][ok]
            want = np.corrcoef(x, y)[0, 1] ** 2 if ok.sum() >= 20 else 0.0
            assert got[p, v][0] == ok.sum() and abs(got[p, v][1] - want) < 1e-9


@pytest.mark.parametrize("hot", [1, 5, 10**9])
def test_duplicate_marks_of_hot_keys(spark, monkeypatch, hot):
    """Repeated keys by broadcast and by hash, null parts apart, against a plain count."""
    monkeypatch.setattr(R, "HOT", hot)
    rng = random.Random(16)
    data = [(rng.choice([None, "x", "x", "x", "x", "yy", str(i)]), rng.choice([None, "x", ""]), i, "kept") for i in range(300)]
    frame = spark.createDataFrame(data, "a string, b string, id int, _n string").repartition(5)
    groups = {}
    for a, b, i, _ in data:
        groups.setdefault((a, b), []).append(i)
    got = {r.id: (r.in_duplicate, r.later_duplicate) for r in R.mark_duplicates(frame.drop("_n"), ["a", "b"], ["id"]).collect()}
    assert got == {i: (len(ids) > 1, i != min(ids)) for ids in groups.values() for i in ids}
    assert {r.id for r in R.first_by(frame, ["a", "b"], ["id"]).collect()} == {min(ids) for ids in groups.values()}
    assert R.first_by(frame, ["a", "b"], ["id"]).columns == frame.columns and R.mark_duplicates(frame.limit(0), ["a"], ["id"]).count() == 0
    only = R.first_by(frame.select("a"), ["a"], ["a"])
    assert only.count() == len({a for a, *_ in data})
