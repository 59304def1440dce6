"""Exact quantiles by distributed selection of order statistics.

A quantile of n values is read off between two ranks. Counts by value bucket (from the logarithm's first digits)
say in which bucket a rank lies; only that bucket is refined, in equal parts of its own range, until a part holds one
value or few rows. Every round is one count with map-side sums: no task sorts or holds a group, and repeated values
are one row with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import landed
from .ranking import value_bucket

#: Equal parts of a bucket's range in a round of refinement, and the rows up to which a range is counted value by value.
PARTS, FEW = 1 << 16, 1 << 16


def _same(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out


def _ranks(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """counts (.., n) plus before: how many values of the group lie in lower parts."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks_of: Column) -> DataFrame:
    """(by.., total, target, rank, x): the value x at each rank (from 0) that ranks_of names for a group.

    ranks_of: array of struct(target, rank) from the column `total`, the group's number of values. Nulls and NaN are
    no values; a null group is a group; a group without a value is left out. Infinities are ordinary values.
    """
    at = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    keys = [f"_by{i}" for i in range(len(by))]
    x = F.col(value).cast("double")
    values = rows.select(*at, x.alias("x")).where("x IS NOT NULL AND NOT isnan(x)").withColumn("_bucket", value_bucket(F.col("x")))
    buckets = values.groupBy(*keys, "_bucket").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    buckets = _ranks(buckets, keys, "_bucket").withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    found = buckets.withColumn("_t", F.explode(ranks_of)).select("*", "_t.target", "_t.rank").where("rank >= before AND rank < before + n")
    columns = [*keys, "total", "target", "rank", "_bucket", "lo", "hi", "n", (F.col("rank") - F.col("before")).alias("inside")]
    found = landed(found.select(*columns), "ranks")
    while found.where("lo < hi").limit(1).count():
        open_ = found.where("lo < hi")
        ranges = open_.select(*[F.col(k).alias(f"_r{k}") for k in keys], F.col("_bucket").alias("_rb"), "lo", "hi", F.col("n").alias("_size")).distinct()
        inside = values.join(ranges, _same([F.col(k) for k in keys], [F.col(f"_r{k}") for k in keys]) & (F.col("_bucket") == F.col("_rb")) & F.col("x").between(F.col("lo"), F.col("hi")))
        part = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1)).cast("double")
        inside = inside.withColumn("_part", F.when(F.col("_size") <= FEW, F.col("x")).otherwise(part))
        counts = inside.groupBy(*keys, "_bucket", "lo", "hi", "_part").agg(F.count("*").alias("n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
        counts = _ranks(counts, [*keys, "_bucket", "lo", "hi"], "_part").select(*[F.col(c).alias(f"_c{c}") for c in (*keys, "_bucket", "lo", "hi")], "n", "before", "_lo", "_hi")
        on = [*keys, "_bucket", "lo", "hi"]
        next_ = open_.drop("n").join(counts, _same([F.col(c) for c in on], [F.col(f"_c{c}") for c in on]) & (F.col("inside") >= F.col("before")) & (F.col("inside") < F.col("before") + F.col("n")))
        next_ = next_.select(*keys, "total", "target", "rank", "_bucket", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "n", (F.col("inside") - F.col("before")).alias("inside"))
        found = landed(found.where("lo = hi").unionByName(next_), "ranks")
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "total", "target", "rank", F.col("lo").alias("x"))


def quantiles(rows: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(by.., n, a column a name of probs): quantiles with linear interpolation between neighbouring values, as doubles.

    The p-quantile of n sorted values lies at p * (n - 1), counted from 0. Nulls and NaN are no values; a null in a
    by column is a group of its own; a group without a value has no row. Without by there is one row, of nulls and n 0 for no values.
    """
    below = {name: f"CAST(floor({p}D * (total - 1)) AS BIGINT)" for name, p in probs.items()}
    wanted = F.expr("array(" + ", ".join(f"named_struct('target', '{name}', 'rank', {lo}), named_struct('target', '{name}', 'rank', least({lo} + 1, total - 1))" for name, lo in below.items()) + ")")
    found = order_statistics(rows, by, value, F.array_distinct(wanted))
    out = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.max("total") - 1)
        mine = F.when(F.col("target") == name, F.col("x"))
        low, high = F.min(mine), F.max(mine)
        part = place - F.floor(place)
        # A rank that is met, and equal ends, infinite ones too, need no arithmetic.
        out.append(F.when((low == high) | (part == 0), low).otherwise(low + (high - low) * part).alias(name))
    return found.groupBy(*by).agg(F.coalesce(F.max("total"), F.lit(0)).cast("long").alias("n"), *out)
