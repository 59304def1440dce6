"""Dedup, ranking, and the 2x2 tables of a ranking against a membership flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import landed

DEPTHS = (25, 50, 100, 200)


def allele_key(*cols: str) -> Column:
    """The literal key; a null part is the text 'nan'."""
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])


#: Copies of one key from which it is hot: such keys are at most rows / HOT in number, and their counts are broadcast.
HOT = 1_000_000


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key in an explicit order; null keys equal one another. Each task keeps its first rows, so a key of many copies fills none."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first") if rest else F.count("*").alias("_first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*[F.col(c) if c in keys else F.col(f"_first.`{c}`") for c in df.columns])


def mark_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df plus in_duplicate (all members of a repeated key) and later_duplicate (all but its first). order tells the rows of a key apart, nulls last.

    Keys are counted by 128 bits of their hash, nulls apart, so no long value is shuffled. Counts and firsts of
    repeated keys are joined back: those of hot keys by broadcast, which moves none of their rows, others by hash.
    """
    flags = [F.col(c).isNull() for c in keys]
    rows = df.withColumn("_k1", F.xxhash64(*keys, *flags)).withColumn("_k2", F.xxhash64(F.lit(1), *keys, *flags)).withColumn("_o", F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"_null_{i}"), F.col(c))]))
    per = landed(rows.groupBy("_k1", "_k2").agg(F.count("*").alias("_n"), F.min("_o").alias("_first")).where("_n > 1"), "repeated-keys")
    hot = per.where(F.col("_n") > HOT).select(F.col("_k1").alias("_h1"), F.col("_k2").alias("_h2"), F.col("_first").alias("_hot"))
    cold = per.where(F.col("_n") <= HOT).select(F.col("_k1").alias("_c1"), F.col("_k2").alias("_c2"), F.col("_first").alias("_cold"))
    rows = rows.join(F.broadcast(hot), (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")), "left")
    # A hot key's rows are settled; they pass the second join spread by their order.
    spread = F.when(F.col("_hot").isNull(), F.col("_k1")).otherwise(F.xxhash64("_o"))
    rows = rows.withColumn("_k1", spread).join(cold, (F.col("_k1") == F.col("_c1")) & (F.col("_k2") == F.col("_c2")), "left")
    first = F.coalesce("_hot", "_cold")
    return rows.select(*df.columns, first.isNotNull().alias("in_duplicate"), F.coalesce(F.col("_o") > first, F.lit(False)).alias("later_duplicate"))


#: Most copies of a row that are made from one count at a time.
COPIES = 1 << 16


def dedup_ledger(df: DataFrame, name: str, key: list[str], order: list[str]) -> DataFrame:
    """Rows of names that occur more than once: whether keeping one row a name would drop the row, and whether the allele key would too.

    Exactly one row of a name and of a key is kept. Rows that order leaves first together are marked again by all
    columns; those alike in all are counted, marked as one and written out again, one of them as the first.
    """
    columns = df.columns
    marked = mark_duplicates(df, [name], order).withColumnsRenamed({"in_duplicate": "_named", "later_duplicate": "removed_by_name"})
    marked = landed(mark_duplicates(marked, key, order).withColumnRenamed("later_duplicate", "same_allele_key"), "ledger")
    first = F.expr("_named AND NOT removed_by_name OR in_duplicate AND NOT same_allele_key")
    whole = [*order, *[c for c in columns if c not in order]]
    again = mark_duplicates(marked.where(first).groupBy(*columns, "_named").agg(F.count("*").alias("_copies")), [name], whole).withColumnRenamed("later_duplicate", "removed_by_name").drop("in_duplicate")
    again = mark_duplicates(again, key, whole).withColumnRenamed("later_duplicate", "same_allele_key")
    again = again.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPIES))))
    again = again.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("_copies") - F.col("_lot") * COPIES))))
    later = (F.col("_lot") > 0) | (F.col("_copy") > 1)
    again = again.withColumns({c: F.col(c) | later for c in ("removed_by_name", "same_allele_key")})
    return marked.where(~first).unionByName(again.select(*marked.columns)).where("_named").drop("_named", "in_duplicate")


def long_scores(df: DataFrame, ids: list[str], prefix: str = "score_") -> DataFrame:
    """Wide score columns found by prefix, as (ids, ranking, score); NaN becomes null."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    out = df.unpivot(ids, cols, "ranking", "score")
    return out.withColumn("score", F.when(F.isnan("score"), None).otherwise(F.col("score")))


def ranked(scores: DataFrame, by: list[str], score: str, tie: str, nulls: str = "drop") -> DataFrame:
    """rank from 1 by |score| descending, ties by the tie column. nulls: drop (default), last or first."""
    if nulls == "drop":
        scores = scores.where(F.col(score).isNotNull())
    key = F.abs(F.col(score))
    order = key.desc_nulls_first() if nulls == "first" else key.desc_nulls_last()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, F.col(tie))))


def value_bucket(x: Column) -> Column:
    """A whole number that never falls as x grows, from the logarithm's first digits: equal values share it, and
    values 0.4% apart do not. Bounded by about 400,000 of either sign. Null for null."""
    x = x.cast("double")
    size = F.abs(x)
    far = F.when(F.isnan(size) | (size == float("inf")), 500_000).otherwise(F.lit(200_000) + F.floor(F.ln(F.when(size > 0, size)) * 256))
    far = F.when(size == 0, 0).otherwise(far).cast("long")
    return F.when((x < 0) & ~F.isnan(x), -far).otherwise(far)


def in_buckets(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """rows plus _bucket, _before (rows of the group in lower buckets) and _total (rows of the group).

    A rank in the group is _before plus a rank in the bucket, so no task sorts a whole group. Counts by bucket are
    the only thing shared; only rows of nearly one value meet in a task.
    """
    rows = rows.withColumn("_bucket", value_bucket(value))
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    below = F.coalesce(F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_at"), below.alias("_before"), F.sum("_n").over(group).alias("_total"))
    same = F.col("_bucket").eqNullSafe(F.col("_at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(counts, same).drop("_at", *[f"_by_{c}" for c in by])


def ranked_whole(scores: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """ranked for rankings of any length, null scores left out: every row's rank, buckets of scores in tasks of their own."""
    rows = in_buckets(scores.where(F.col(score).isNotNull()), by, -F.abs(F.col(score)))
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.abs(F.col(score)).desc(), F.col(tie))
    return rows.withColumn("rank", F.col("_before") + F.row_number().over(inside)).drop("_bucket", "_before", "_total")


def top_tables(scores: DataFrame, by: list[str], score: str, tie: str, flag: str, depths=DEPTHS) -> DataFrame:
    """two_by_two of the ranking by |score|, null scores left out, without ranking what lies below the largest depth.

    Each task keeps its best rows, so the sort sees those only; the rest enters as counts.
    """
    rows = scores.where(F.col(score).isNotNull()).select(*by, F.abs(F.col(score)).alias("_size"), F.col(tie).alias("_tie"), F.col(flag).alias("_flag"))
    levels = F.explode(F.array(*[F.lit(x) for x in depths]))
    order = Window.partitionBy(*by).orderBy(F.desc("_size"), F.col("_tie"))
    best = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(depths)).withColumn("depth", levels).where("_n <= depth")
    tops = best.groupBy(*by, "depth").agg(F.count_if("_flag").alias("a"), F.count_if(~F.col("_flag")).alias("b"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    none = F.lit(0).cast("long")
    totals = rows.groupBy(*by).agg(F.count_if("_flag").alias("p"), F.count_if(~F.col("_flag")).alias("q")).select(*by, levels.alias("depth"), none.alias("a"), none.alias("b"), "p", "q")
    cells = tops.unionByName(totals).groupBy(*by, "depth").agg(*[F.sum(c).alias(c) for c in "abpq"])
    return cells.select(*by, "depth", "a", "b", (F.col("p") - F.col("a")).alias("c"), (F.col("q") - F.col("b")).alias("d")).where("c + d > 0")


def two_by_two(rows: DataFrame, by: list[str], flag: str, depths=DEPTHS) -> DataFrame:
    """Per by-group and depth: a top in, b top out, c rest in, d rest out. Depths that reach the group's size are left out.

    Each row is expanded by the few depths and summed map-side, so the shuffle carries one row per group.
    """
    top = F.col("rank") <= F.col("depth")
    inside = F.col(flag)
    cells = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).groupBy(*by, "depth").agg(
        F.count_if(top & inside).alias("a"), F.count_if(top & ~inside).alias("b"), F.count_if(~top & inside).alias("c"), F.count_if(~top & ~inside).alias("d")
    )
    return cells.where("c + d > 0")


def percentile_of(df: DataFrame, by: list[str], value: str, name: str = "percentile") -> DataFrame:
    """Percent of the group's |values| that are strictly smaller; null values are left out."""
    rows = in_buckets(df.where(F.col(value).isNotNull()).withColumn("_abs", F.abs(F.col(value))), by, F.col("_abs"))
    below = F.col("_before") + F.rank().over(Window.partitionBy(*by, "_bucket").orderBy("_abs")) - 1
    return rows.withColumn(name, below * 100.0 / F.col("_total")).drop("_abs", "_bucket", "_before", "_total")


def with_average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df plus the rank of value in its group from 1; tied values share their mean rank. Values are not null."""
    rows = in_buckets(df, by, F.col(value))
    inside = Window.partitionBy(*by, "_bucket")
    ties = F.count("*").over(Window.partitionBy(*by, "_bucket", value))
    return rows.withColumn(name, F.col("_before") + F.rank().over(inside.orderBy(value)) + (ties - 1) / 2.0).drop("_bucket", "_before", "_total")
