"""Interval algebra against brute force, and the boundary rules."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators import intervals as iv


def brute_merge(items):
    """Hulls of the connected groups, where intervals that share a position or only touch are neighbours."""
    groups = [{x} for x in items]
    meet = lambda g, h: any(a[0] <= b[1] and b[0] <= a[1] for a in g for b in h)
    while pair := next(((g, h) for n, g in enumerate(groups) for h in groups[:n] if meet(g, h)), None):
        groups = [g for g in groups if g is not pair[0] and g is not pair[1]] + [pair[0] | pair[1]]
    return sorted((min(s for s, _ in g), max(e for _, e in g)) for g in groups)


def brute_support(items, k):
    """Runs of unit cells that k intervals cover, cut where fewer than k intervals reach over the edge between two cells."""
    last = max((e for _, e in items), default=0)
    deep = [p for p in range(last) if sum(s <= p < e for s, e in items) >= k]
    cuts = [p for p in deep if p - 1 not in deep or sum(s < p < e for s, e in items) < k]
    return [(p, next(q for q in range(p + 1, last + 1) if q not in deep or q in cuts)) for p in cuts]


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(1)
    sets = {f"s{i}": [(a := rng.randint(0, 60), a + rng.randint(0, 15)) for _ in range(rng.randint(1, 12))] for i in range(40)}
    sets["touch"], sets["nested"], sets["same"], sets["zero"] = [(0, 5), (5, 9)], [(0, 20), (3, 4)], [(2, 6), (2, 6)], [(4, 4)]
    frame = spark.createDataFrame([(k, s, e) for k, items in sets.items() for s, e in items], "set_id string, start long, `end` long")
    return sets, frame


def by_set(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.set_id, []).append((r.start, r.end))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("width", [None, 7, 1000])
def test_merge(cases, width):
    sets, frame = cases
    assert by_set(iv.merge(frame, ["set_id"], width)) == {k: brute_merge(v) for k, v in sets.items()}


@pytest.mark.parametrize("k,width", [(1, 1), (1, 1000), (2, 7), (3, 2), (3, 1000)])
def test_support(cases, k, width):
    sets, frame = cases
    assert by_set(iv.support_regions(frame, ["set_id"], k, bin_width=width)) == {k_: r for k_, v in sets.items() if (r := brute_support(v, k))}


def test_touching_merge_but_stay_split_by_depth(cases):
    _, frame = cases
    touch = frame.where("set_id = 'touch'")
    assert by_set(iv.merge(touch, ["set_id"])) == {"touch": [(0, 9)]}
    assert by_set(iv.support_regions(touch, ["set_id"], 1)) == {"touch": [(0, 5), (5, 9)]}


@pytest.mark.parametrize("inclusive", [False, True])
def test_hits(spark, cases, inclusive):
    sets, frame = cases
    points = spark.range(80).select(F.col("id").alias("event_id"), F.col("id").alias("pos"))
    for name in ("s3", "touch", "zero"):
        want = {(p, s, e) for p in range(80) for s, e in sets[name] if s <= p and (p <= e if inclusive else p < e)}
        for width in (3, 50):
            got = iv.hits(points, frame.where(F.col("set_id") == name), width, inclusive=inclusive)
            assert {(r.pos, r.start, r.end) for r in got.collect()} == want


def test_sweep_equals_binned(spark, cases):
    _, frame = cases
    merged = iv.with_elem_id(iv.merge(frame.where("set_id = 's5'"), ["set_id"]), ["set_id"])
    points = spark.range(80).select(F.col("id").alias("event_id"), F.col("id").alias("pos"))
    swept = {(r.pos, r.elem_id) for r in iv.locate_in_disjoint(points, merged).collect() if r.elem_id is not None}
    assert swept == {(r.pos, r.elem_id) for r in iv.hits(points, merged, 8).collect()}
    nowhere = points.unionByName(spark.createDataFrame([(90, None), (91, -7)], "event_id long, pos long"))
    for width in (1, 3, 8, 1000):
        found = iv.locate_in_disjoint(nowhere, merged, bin_width=width).collect()
        assert len(found) == 82 and {(r.pos, r.elem_id) for r in found if r.elem_id is not None} == swept
    assert iv.locate_in_disjoint(points, merged, pos_base=1).where("elem_id IS NOT NULL").count() == len(swept)


def test_overlap_bounds(spark):
    one = spark.createDataFrame([(0, 10), (20, 30)], "start long, `end` long")
    assert one.where(iv.overlaps(F.col("start"), F.col("end"), 10, 20)).count() == 0
    assert one.where(iv.overlaps(F.col("start"), F.col("end"), 10, 20, inclusive=True)).count() == 2


def test_nearest_ties_and_reach(spark):
    points = spark.createDataFrame([(1, 50), (2, 5), (3, 900)], "event_id long, pos long")
    features = spark.createDataFrame([(0, 10, "a"), (40, 45, "b"), (55, 60, "c")], "start long, `end` long, feature string")
    got = {r.event_id: (r.feature, r.distance) for r in iv.nearest(points, features, 100, "event_id").collect()}
    assert got == {1: ("b", 5), 2: ("a", 0), 3: (None, None)}


@pytest.mark.parametrize("width", [1, 3, 64])
def test_long_intervals_are_two_rows_at_most(spark, width):
    """Intervals from points to whole chromosomes, negative positions too, found in bins of their own size."""
    rng = random.Random(13)
    items = [(s := rng.randint(-500, 3000), s + rng.choice([0, 1, 2, 17, 300, 4000, 10**6, 10**12])) for _ in range(120)]
    frame = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(items)], "id int, start long, `end` long")
    dealt = iv.by_size(frame, F.col("start"), F.greatest(F.col("end") - 1, F.col("start")), width)
    assert dealt.groupBy("id").count().agg(F.max("count")).first()[0] <= 2
    points = spark.createDataFrame([(i, rng.randint(-600, 5000)) for i in range(150)] + [(150, 10**11), (151, None)], "event_id int, pos long")
    for inclusive in (False, True):
        want = sorted((p.event_id, i) for p in points.collect() if p.pos is not None for i, (s, e) in enumerate(items) if s <= p.pos and (p.pos <= e if inclusive else p.pos < e))
        assert sorted((r.event_id, r.id) for r in iv.hits(points, frame, width, inclusive=inclusive).collect()) == want


def test_nearest_among_long_and_short_features(spark):
    rng = random.Random(14)
    items = sorted({(s := rng.randint(0, 20_000), s + rng.choice([0, 5, 200, 15_000])) for _ in range(40)})
    features = spark.createDataFrame([(s, e, f"{s}-{e}") for s, e in items], "start long, `end` long, feature string")
    points = spark.createDataFrame([(i, rng.randint(-200, 40_000)) for i in range(200)], "event_id int, pos long")
    for reach in (0, 10, 900):
        got = {r.event_id: (r.feature, r.distance) for r in iv.nearest(points, features, reach, "event_id").collect()}
        for p in points.collect():
            near = sorted((max(s - p.pos, p.pos - e, 0), s, f"{s}-{e}") for s, e in items)[0]
            assert got[p.event_id][1] == (near[0] if near[0] <= reach else None)
            assert near[0] > reach or got[p.event_id][0] in {f"{s}-{e}" for s, e in items if (max(s - p.pos, p.pos - e, 0), s) == near[:2]}


def test_numbers_over_bins(spark):
    rng = random.Random(15)
    data = [(rng.choice(["a", "b", None]), rng.randint(-300, 300), i) for i in range(400)]
    frame = spark.createDataFrame(data, "k string, pos long, id int")
    for width in (1, 50, 10_000):
        got = {r.id: r.n for r in iv.numbered(frame, ["k"], "pos", ["id"], "n", width).collect()}
        for key in ("a", "b", None):
            assert [got[i] for _, _, i in sorted((k or "", p, i) for k, p, i in data if k == key)] == list(range(sum(k == key for k, _, _ in data)))
    alone = [r.n for r in iv.numbered(frame, [], "pos", ["id"], "n", 7).orderBy("pos", "id").collect()]
    assert alone == list(range(400)) and iv.numbered(frame.limit(0), [], "pos", ["id"], "n").count() == 0


def test_no_window_holds_a_whole_key(spark, cases):
    """Every window over rows of a whole set has the bin in its partition; windows without it see one row a bin."""
    _, frame = cases
    for made in (iv.merge(frame, ["set_id"], 7), iv.with_elem_id(frame, ["set_id"], 7), iv.support_regions(frame, ["set_id"], 2, bin_width=7)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for line in (x for x in plan.splitlines() if "Window [" in x):
            assert "_bin" in line and ("_total" in line or line.split("], [")[1].count("_bin"))
