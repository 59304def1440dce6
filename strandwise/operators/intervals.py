"""Interval algebra on half-open, 0-based intervals (set_id, start, end), positions compared as given.

Zero-length and touching intervals follow the rules named on each operator. Everything is built from
joins, windows and aggregates on built-in functions; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import landed


def overlaps(start: Column, end: Column, lo, hi, inclusive: bool = False) -> Column:
    """Overlap with a locus; strict by default, so an interval that only touches the bound is out."""
    return (end >= lo) & (start <= hi) if inclusive else (end > lo) & (start < hi)


#: Width of the bins in which whole sets are scanned, and the growth of bins from one size to the next.
SCAN_WIDTH, GROWTH, SIZES = 1 << 16, 16, 16


def _same(keys: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in keys:
        out = out & F.col(c).eqNullSafe(F.col(prefix + c))
    return out


def _scanned(binned: DataFrame, keys: list[str], total: Column, carry, name: str) -> DataFrame:
    """binned (keys, _bin, ..) plus name: `carry` (an aggregate such as F.max) of `total` of all earlier bins of the key, null in the first.

    A bin's summary is one row, and only these rows meet in a window of a whole key.
    """
    summary = binned.groupBy(*keys, "_bin").agg(total.alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*[F.col(c).alias(f"_at_{c}") for c in (*keys, "_bin")], carry("_total").over(earlier).alias(name))
    return binned.join(summary, _same([*keys, "_bin"], "_at_")).drop(*[f"_at_{c}" for c in (*keys, "_bin")])


def numbered(rows: DataFrame, keys: list[str], at: str, order: list[str], name: str, bin_width: int = SCAN_WIDTH) -> DataFrame:
    """rows plus each row's number within its key, from 0, by position and then order; a task numbers one bin, after the count of earlier bins."""
    binned = rows.withColumn("_bin", F.floor(F.col(at) / bin_width))
    binned = _scanned(binned, keys, F.count("*"), F.sum, "_before")
    inside = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(at, *order)) - 1
    return binned.withColumn(name, (F.coalesce("_before", F.lit(0)) + inside).cast("long")).drop("_bin", "_before")


def _islands(iv: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    rows = iv.withColumn("_fresh", fresh)
    rows = rows.withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge(iv: DataFrame, keys: list[str], bin_width: int | None = None) -> DataFrame:
    """Union-merge per key; touching intervals merge, zero-length ones survive.

    With bin_width, intervals are first merged inside coarse bins of their start; how far the earlier bins reach
    and how many merged intervals begin in them is then carried into each bin, so no task sorts a whole key.
    """
    cols = iv.select(*keys, "start", "end")
    if not bin_width:
        return _islands(cols, keys)
    cols = _islands(cols.withColumn("_bin", F.floor(F.col("start") / bin_width)), [*keys, "_bin"])
    cols = _scanned(cols, keys, F.max("end"), F.max, "_carried")
    inside = Window.partitionBy(*keys, "_bin").orderBy("start", "end")
    reach = F.greatest("_carried", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    cols = cols.withColumn("_fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    cols = _scanned(cols, keys, F.sum("_fresh"), F.sum, "_before")
    island = F.coalesce("_before", F.lit(0)) + F.sum("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return cols.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def with_elem_id(merged: DataFrame, keys: list[str], bin_width: int = SCAN_WIDTH) -> DataFrame:
    """Number of each interval within its key, from 0, in order of start."""
    return numbered(merged, keys, "start", ["end"], "elem_id", bin_width)


def with_depth(iv: DataFrame, keys: list[str], bin_width: int = 1 << 16) -> DataFrame:
    """(keys, pos, d, depth): every start (d 1) and end (d -1) in order, ends first, with the depth after it.

    A position's depth is the sum of the bins before its own plus a running sum in its bin, so a task sorts a bin.
    """
    edges = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    events = iv.select(*keys, edges.alias("e")).select(*keys, "e.pos", "e.d").withColumn("_bin", F.floor(F.col("pos") / bin_width))
    inside = Window.partitionBy(*keys, "_bin").orderBy("pos", "d").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.coalesce("_before", F.lit(0)) + F.sum("d").over(inside)
    return _scanned(events, keys, F.sum("d"), F.sum, "_before").select(*keys, "pos", "d", depth.alias("depth"))


def support_regions(iv: DataFrame, keys: list[str], least: int, distinct_source: str | None = None, bin_width: int = 1 << 16) -> DataFrame:
    """Regions where at least `least` intervals overlap, by a sweep over +1 and -1 events.

    At one position ends come before starts, so touching intervals stay apart, even for least = 1, and
    zero-length ones give nothing. With distinct_source, each source is merged first and counts once.
    Regions are disjoint, so the n-th edge at which one opens belongs to the n-th at which one closes.
    """
    if distinct_source:
        iv = merge(iv, [*keys, distinct_source], bin_width)
    depth = with_depth(iv.where("end > start"), keys, bin_width).withColumn("was", F.col("depth") - F.col("d"))
    edges = depth.where(((F.col("was") < least) & (F.col("depth") >= least)) | ((F.col("was") >= least) & (F.col("depth") < least)))
    opens, closes = (numbered(edges.where(F.col("d") == d).select(*keys, "pos"), keys, "pos", [], "_n", bin_width) for d in (1, -1))
    closes = closes.select(*[F.col(c).alias(f"_at_{c}") for c in (*keys, "_n")], F.col("pos").alias("end"))
    return opens.join(closes, _same([*keys, "_n"], "_at_")).select(*keys, F.col("pos").alias("start"), "end")


def locate_in_disjoint(points: DataFrame, merged: DataFrame, pos: str = "pos", keys: list[str] = (), pos_base: int = 0, bin_width: int = 1 << 16) -> DataFrame:
    """points plus elem_id of the disjoint interval that holds them, or null: one sort per key and bin, no join.

    Points and interval starts are swept together; the last start at or before a point decides. An interval is
    dealt to each bin it reaches, from the bin's start on; as intervals are disjoint, that adds one row a bin at
    most. Null positions stay unmatched and keep their task. pos_base=1 treats positions as 1-based.
    """
    keys = list(keys)
    at = (F.col(pos) - pos_base).cast("long")
    rows = points.withColumn("_row", F.struct(*points.columns))
    nowhere = F.when(at.isNull(), F.spark_partition_id())
    left = rows.select(*keys, F.floor(at / bin_width).alias("_bin"), nowhere.alias("_part"), at.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.lit(None).cast("long").alias("_elem"), "_row")
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    bins = F.explode(F.sequence(F.floor(start / bin_width), F.floor(F.greatest(end - 1, start) / bin_width)))
    right = merged.select(*keys, start.alias("start"), end.alias("_end"), F.col("elem_id").cast("long").alias("_elem"), bins.alias("_bin"))
    right = right.select(*keys, "_bin", F.lit(None).cast("int").alias("_part"), F.greatest(F.col("start"), F.col("_bin") * bin_width).alias("_at"), F.lit(0).alias("_kind"), "_end", "_elem", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*keys, "_bin", "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = left.unionByName(right).withColumn("_e", F.last("_end", True).over(order)).withColumn("_i", F.last("_elem", True).over(order))
    return swept.where("_kind = 1").select("_row.*", F.when(F.col("_at") < F.col("_e"), F.col("_i")).alias("elem_id"))


def by_size(iv: DataFrame, first: Column, last: Column, width: int) -> DataFrame:
    """iv with _size and _bin: an interval of positions first to last lies in bins of the smallest size that is not shorter than it, so it is two rows at most."""
    size = F.lit(SIZES - 1)
    for k in reversed(range(SIZES - 1)):
        size = F.when(last - first < F.lit(float(width * GROWTH**k)), k).otherwise(size)
    edge = lambda x: F.floor(x / F.pow(F.lit(float(GROWTH)), F.col("_size")) / width)
    return iv.withColumn("_size", size).withColumn("_bin", F.explode(F.sequence(edge(first), edge(last))))


def probes(points: DataFrame, pos: Column, sizes: list[int], width: int) -> DataFrame:
    """points with _size and _bin: the one bin of each size that holds the position."""
    at = [F.struct(F.lit(k).alias("_size"), F.floor(pos / F.lit(float(GROWTH**k)) / width).alias("_bin")) for k in sizes]
    return points.withColumn("_at", F.explode(F.array(*at))).select("*", "_at._size", "_at._bin").drop("_at")


def sizes_of(dealt: DataFrame) -> list[int]:
    """The sizes of bins that hold an interval, of a written table: at most SIZES numbers on the driver."""
    return sorted(r["_size"] for r in dealt.select("_size").distinct().collect()) or [0]


def hits(points: DataFrame, iv: DataFrame, bin_width: int, pos: str = "pos", keys: list[str] = (), inclusive: bool = False) -> DataFrame:
    """Every (point, interval) pair with the point inside: an equi-join on bins with a residual test.

    Intervals may overlap and be of any length: each lies in one or two bins of about its own size, and a point
    looks into one bin of each size that there is, so a pair is found once. inclusive also counts the end position.
    """
    keys = list(keys)
    last = F.col("end") if inclusive else F.greatest(F.col("end") - 1, F.col("start"))
    right = landed(by_size(iv, F.col("start"), last, bin_width), "dealt-intervals")
    left = probes(points, F.col(pos), sizes_of(right), bin_width)
    inside = (F.col(pos) >= F.col("start")) & (F.col(pos) <= F.col("end") if inclusive else F.col(pos) < F.col("end"))
    return left.join(right, [*keys, "_size", "_bin"]).where(inside).drop("_size", "_bin")


def open_counts(points: DataFrame, iv: DataFrame, by: str, pos: str = "pos", bin_width: int = SCAN_WIDTH) -> DataFrame:
    """(pos, by, n): how many intervals of each `by` hold each position of the points, where any does; a position is told once.

    Depths are summed over starts and ends, so the work follows the rows and the positions, not the pairs of a
    point and an interval. Depths are carried from bin to bin over one row a bin and `by`; within a bin only the
    `by` that are open at its start or change in it meet its positions.
    """
    at = points.select(F.col(pos).cast("long").alias("pos")).where("pos IS NOT NULL").distinct().withColumn("_bin", F.floor(F.col("pos") / bin_width))
    edges = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    edges = iv.where("end > start").select(F.col(by).alias("_by"), edges.alias("e")).groupBy("_by", F.col("e.pos").cast("long").alias("pos")).agg(F.sum("e.d").alias("_d"))
    edges = landed(edges.withColumn("_bin", F.floor(F.col("pos") / bin_width)), "edges")
    none = F.lit(0).cast("long")
    own = edges.groupBy("_by", "_bin").agg(F.sum("_d").alias("_total"))
    seen = own.select("_by").distinct().crossJoin(at.select("_bin").distinct()).select("_by", "_bin", none.alias("_total"), F.lit(False).alias("_own"))
    grid = own.withColumn("_own", F.lit(True)).unionByName(seen).groupBy("_by", "_bin").agg(F.sum("_total").alias("_total"), F.max("_own").alias("_own"))
    earlier = Window.partitionBy("_by").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_d", F.coalesce(F.sum("_total").over(earlier), none)).where("_own OR _d > 0").select("_by", "_bin", "_d")
    # What is open where a bin begins counts from its first position.
    steps = edges.select("_by", "_bin", "pos", "_d").unionByName(grid.select("_by", "_bin", (F.col("_bin") * bin_width).alias("pos"), "_d")).withColumn("_asked", F.lit(False))
    asked = at.join(grid, "_bin").select("_by", "_bin", "pos", none.alias("_d"), F.lit(True).alias("_asked"))
    steps = steps.unionByName(asked).groupBy("_by", "_bin", "pos").agg(F.sum("_d").alias("_d"), F.max("_asked").alias("_asked"))
    inside = Window.partitionBy("_by", "_bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return landed(steps.withColumn("n", F.sum("_d").over(inside)).where("_asked AND n > 0").select("pos", F.col("_by").alias(by), "n"), "open-counts")


def places(points: DataFrame, key: str, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The points' (key, pos, times), those of keys with one position and those of keys with several; null positions are left out."""
    points = points.select(key, pos).where(F.col(pos).isNotNull())
    per = points.groupBy(key).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"), F.count("*").alias("times"))
    # Both filters read all three aggregates, so both sides have the same exchange and it runs once.
    several = per.where("_lo < _hi AND times > 0").select(F.col(key).alias("_key"))
    several = points.join(several, F.col(key).eqNullSafe(F.col("_key")), "left_semi").groupBy(key, pos).agg(F.count("*").alias("times"))
    return per.where("_lo = _hi AND times > 0").select(key, F.col("_lo").alias(pos), "times"), several


def is_hit(points: DataFrame, iv: DataFrame, bin_width: int, key: str, pos: str = "pos", inclusive: bool = False, name: str = "in_peak") -> DataFrame:
    """points plus a flag: whether any interval holds the position. key identifies a point."""
    found = hits(points.select(key, pos), iv.select("start", "end"), bin_width, pos, (), inclusive).select(key).distinct().withColumn(name, F.lit(True))
    return points.join(found, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def midpoint() -> Column:
    return F.floor((F.col("start") + F.col("end")) / 2)


def split_by_midpoint(reference: DataFrame, comparison: DataFrame) -> DataFrame:
    """reference plus `shared`: whether its midpoint lies in the (merged) comparison set; else it is restricted."""
    ref = reference.withColumn("_mid", midpoint())
    cmp = comparison if "elem_id" in comparison.columns else with_elem_id(comparison, [])
    return locate_in_disjoint(ref, cmp, "_mid").withColumn("shared", F.col("elem_id").isNotNull()).drop("_mid", "elem_id")


def distance(pos: Column, lo, hi) -> Column:
    """0 inside [lo, hi], else the gap to the nearer edge."""
    return F.greatest(F.lit(lo) - pos, pos - F.lit(hi), F.lit(0))


def nearest(points: DataFrame, features: DataFrame, reach: int, key: str, pos: str = "pos", order: str = "start") -> DataFrame:
    """Each point's nearest feature within reach: distance 0 if it overlaps, else to the nearer edge; the first by order wins ties.

    Features lie, with their reach, in bins of about their size, so the search is an equi-join; points with none in reach get nulls.
    """
    width = 2 * max(1, reach)
    right = landed(by_size(features, F.col("start") - reach, F.col("end") + reach, width), "dealt-features")
    near = probes(points.select(key, pos), F.col(pos), sizes_of(right), width).join(right, ["_size", "_bin"])
    gap = distance(F.col(pos), F.col("start"), F.col("end"))
    near = near.withColumn("distance", gap).where(F.col("distance") <= reach)
    best = near.groupBy(key).agg(F.min(F.struct("distance", order, "feature")).alias("b")).select(key, F.col("b.feature").alias("feature"), F.col("b.distance").alias("distance"))
    return points.join(best, key, "left")


def centred_window(pos: Column, width: int) -> Column:
    start = F.greatest(F.lit(0), pos - width // 2)
    return F.struct(start.alias("start"), (start + width).alias("end"))


def coverage(iv: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """Per key: intervals, base pairs unclipped and within [lo, hi), overhang, boundary crossings, percent of the locus."""
    clipped = F.greatest(F.lit(0), F.least("end", F.lit(hi)) - F.greatest("start", F.lit(lo)))
    return iv.groupBy(*keys).agg(
        F.count("*").alias("peaks"),
        F.sum(F.col("end") - F.col("start")).alias("bp_unclipped"),
        F.sum(clipped).alias("bp_within_locus"),
        (F.sum(F.col("end") - F.col("start")) - F.sum(clipped)).alias("overhang_bp"),
        F.count_if((F.col("start") < lo) | (F.col("end") > hi)).alias("peaks_crossing_boundary"),
        (F.sum(clipped) * 100.0 / (hi - lo)).alias("pct_of_locus"),
    )
