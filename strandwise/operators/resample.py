"""Stratified subsampling and the shared-draw cluster bootstrap, with draws derived from md5.

Copies of a record share score and flag, so a bootstrap replicate is a weighted ranking: a record weighs as
often as its element was drawn. The few records that can reach the top are sorted once a ranking; a replicate is
a fold of its weights over them. Nothing loops on the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import log_or

#: Replicates that a task folds at a time; with the sorted records, what a task holds.
BLOCK = 250


def hash_number(*parts: Column) -> Column:
    """A 32-bit number from md5 of the parts joined by '|'; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def stratified(pool: DataFrame, target: DataFrame, value: str, edges: list[float], key: str, seed: int = 0) -> DataFrame:
    """A subsample of pool whose bins (lo, hi] hold as many rows as target's, or all there are; rows in no bin are left out."""
    bin_of = lambda c: F.coalesce(*[F.when((c > lo) & (c <= hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    quota = target.withColumn("bin", bin_of(F.col(value))).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("quota"))
    rows = pool.withColumn("bin", bin_of(F.col(value))).where("bin IS NOT NULL")
    order = Window.partitionBy("bin").orderBy(hash_number(F.lit(str(seed)), F.col(key).cast("string")), key)
    return rows.withColumn("_n", F.row_number().over(order)).join(quota, "bin").where("_n <= quota").drop("_n", "quota")


def replicated(df: DataFrame, seeds: list[int], replicates: int) -> DataFrame:
    """df once per seed and replicate, as columns seed and rep; for narrow tables of bounded size only."""
    out = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return out.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def draws(spark, seeds: list[int], replicates: int, n_elements: int) -> DataFrame:
    """(seed, rep, elem, k): how often each of n_elements elements is drawn in each replicate, n_elements draws a replicate.

    The same draws serve every comparator and both reference sets. A replicate's draws depend on its seed and
    number alone, so the first 500 of 5,000 replicates are those of a run of 500. Slots are dealt over tasks.
    """
    slots = replicated(spark.range(n_elements).withColumnRenamed("id", "slot"), seeds, replicates)
    elem = F.pmod(hash_number(F.col("seed").cast("string"), F.col("rep").cast("string"), F.col("slot").cast("string")), F.lit(n_elements))
    return slots.withColumn("elem", elem).groupBy("seed", "rep", "elem").agg(F.count("*").alias("k"))


def weighted_cells(rows: DataFrame, by: list[str], score: str, tie: str, flags: list[str], depth: int) -> DataFrame:
    """The 2x2 cells of the top `depth` copies for each flag column: rows weigh k copies, a row that crosses the cut counts in part."""
    order = Window.partitionBy(*by).orderBy(F.abs(F.col(score)).desc(), F.col(tie))
    before = F.coalesce(F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = rows.withColumn("_top", F.greatest(F.least(F.col("k"), F.lit(depth) - before), F.lit(0)))
    cells = []
    for f in flags:
        inside = F.col(f)
        cells += [F.sum(F.when(inside, F.col("_top")).otherwise(0)).alias(f"{f}_a"), F.sum(F.when(~inside, F.col("_top")).otherwise(0)).alias(f"{f}_b")]
        cells += [F.sum(F.when(inside, F.col("k") - F.col("_top")).otherwise(0)).alias(f"{f}_c"), F.sum(F.when(~inside, F.col("k") - F.col("_top")).otherwise(0)).alias(f"{f}_d")]
    return top.groupBy(*by).agg(*cells)


def binomial_quantiles(u: np.ndarray, n: int, p: float) -> np.ndarray:
    """For each u in (0, 1) the number of values of Binomial(n, p) whose distribution function is at most u.

    Weights are multiplied outward from the mode by the ratio of neighbours as far as they count, so time and memory
    follow the standard deviation, not n.
    """
    if n <= 0 or p <= 0 or p >= 1:
        return np.full(len(u), n if p >= 1 else 0, dtype=np.int64)
    mode = min(n, int((n + 1) * p))
    reach = 40 + int(12 * (n * p * (1 - p)) ** 0.5)
    while True:
        lo, hi = max(0, mode - reach), min(n, mode + reach)
        up, down = np.arange(mode, hi, dtype=float), np.arange(mode, lo, -1, dtype=float)
        above = np.cumprod((n - up) / (up + 1) * (p / (1 - p)))
        below = np.cumprod(down / (n - down + 1) * ((1 - p) / p))
        if (hi == n or above[-1] < 1e-18) and (lo == 0 or below[-1] < 1e-18):
            break
        reach *= 2
    cdf = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return lo + np.searchsorted(cdf / cdf[-1], u, side="right")


def resampled_pairs(counts: DataFrame, keys: list[str], seed: int, replicates: int) -> DataFrame:
    """(keys, rep, n, x, y, xy): a pair's counts in each of its resamples of n haplotypes with replacement.

    counts: (keys, n, x, y, xy) as linkage.pair_counts gives them. Only the numbers of the four joint classes matter, and
    those follow the multinomial law: each is drawn from a binomial of what is left, by a number from md5 of
    'seed|keys|rep|class'. So a replicate costs a few standard deviations of its binomials, not the panel. A null key counts as an empty text.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    fields = [f for f in counts.schema.fields if f.name in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", rep long, n long, x long, y long, xy long"

    def run(batches):
        for b in batches:
            schema = pa.schema([*[b.schema.field(i) for i in range(len(keys))], *[(c, pa.int64()) for c in ("rep", "n", "x", "y", "xy")]])
            for i, (name, n, x, y, xy) in enumerate(zip(*(b.column(len(keys) + j).to_pylist() for j in range(5)))):
                left, drawn = np.full(replicates, n, dtype=np.int64), []
                weight = n
                for c, members in enumerate((xy, x - xy, y - xy)):
                    u = np.array([(int(hashlib.md5(f"{seed}|{name}|{rep}|{c}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for rep in range(replicates)])
                    k = np.zeros(replicates, dtype=np.int64)
                    for m in np.unique(left):
                        k[left == m] = binomial_quantiles(u[left == m], int(m), members / weight if weight else 0.0)
                    drawn.append(k)
                    left, weight = left - k, weight - members
                both, only_x, only_y = drawn
                own = [pa.array([b.column(j)[i].as_py()] * replicates, b.schema.field(j).type) for j in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(replicates)), pa.array(np.full(replicates, n)), pa.array(both + only_x), pa.array(both + only_y), pa.array(both)], schema=schema)

    return counts.select(*keys, text.alias("_name"), *[F.col(c).cast("long").alias(c) for c in ("n", "x", "y", "xy")]).mapInArrow(run, ddl)


def presorted(rows: DataFrame, ranking: str, score: str, tie: str, flags: list[str], depth: int) -> DataFrame:
    """One row a ranking: `top`, the records that can reach the top of a replicate, best first, and `counts`, all its records by element and flag.

    rows have elem: null for fixed records, else the number of the record's element. The records that can reach the
    top are the depth best fixed ones and those of elements that beat the last of these, depth an element at most;
    so a row is bounded by depth times the elements, however many records there are.
    """
    size = F.abs(F.col(score))
    rows = rows.where(F.col(score).isNotNull()).select(F.col(ranking).alias("_ranking"), F.col(tie).alias("_tie"), size.alias("_size"), F.col("elem").cast("long").alias("elem"), *flags)
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("_size"), F.col("_tie"))
    best = lambda df, *by: df.withColumn("_n", F.row_number().over(order(*by))).where(F.col("_n") <= depth)
    fixed = best(rows.where("elem IS NULL"), "_ranking")
    bar = fixed.where(F.col("_n") == depth).select("_ranking", F.col("_size").alias("_bar"), F.col("_tie").alias("_bar_tie"))
    beats = F.col("_bar").isNull() | (F.col("_size") > F.col("_bar")) | ((F.col("_size") == F.col("_bar")) & (F.col("_tie") < F.col("_bar_tie")))
    live = best(rows.where("elem IS NOT NULL").join(bar, "_ranking", "left").where(beats).drop("_bar", "_bar_tie"), "_ranking", "elem")
    elem = F.coalesce("elem", F.lit(-1).cast("long")).alias("elem")
    one = F.struct((-F.col("_size")).alias("_key"), "_tie", elem, *flags)
    tops = fixed.unionByName(live).groupBy("_ranking").agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: F.struct(r["elem"].alias("elem"), *[r[f].alias(f) for f in flags])).alias("top"))
    sums = rows.groupBy("_ranking", elem).agg(*[F.count_if(c).alias(f"{f}_{n}") for f in flags for n, c in (("in", F.col(f)), ("out", ~F.col(f)))])
    counts = sums.groupBy("_ranking").agg(F.collect_list(F.struct("elem", *[f"{f}_{n}" for f in flags for n in ("in", "out")])).alias("counts"))
    return counts.join(tops, "_ranking", "left").withColumnRenamed("_ranking", "ranking")


def bootstrap_cells(rows: DataFrame, n_elements: int, seeds: list[int], replicates: int, ranking: str, score: str, tie: str, flags: list[str], depth: int) -> DataFrame:
    """(seed, rep, ranking, the cells a b c d of each flag at depth) of every replicate, without a copy or a sort of the records per replicate.

    rows have elem: null for fixed records, which count once in every replicate; others count as often as draws()
    draws their element. Rows without score are left out. The rankings' sorted records travel as one row to each
    block of replicates; draws are made there, once for all rankings, and folded over each as a matrix of weights.
    """
    one = F.struct("ranking", "top", "counts")
    together = presorted(rows, ranking, score, tie, flags, depth).groupBy().agg(F.array_sort(F.collect_list(one)).alias("rankings"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(len(seeds) * -(-replicates // BLOCK) - 1)))
    dealt = together.select("rankings", blocks.alias("block")).repartition(len(seeds) * -(-replicates // BLOCK), "block")
    names = [f"{f}_{c}" for f in flags for c in "abcd"]
    schema = pa.schema([("seed", pa.int64()), ("rep", pa.int64()), (ranking, pa.string()), *[(n, pa.int64()) for n in names]])

    def run(batches):
        for b in batches:
            for rankings, block in zip(b.column(0), b.column(1).to_pylist()):
                seed, first = seeds[block // -(-replicates // BLOCK)], block % -(-replicates // BLOCK) * BLOCK
                reps = np.arange(first, min(replicates, first + BLOCK))
                k = np.zeros((len(reps), n_elements + 1), dtype=np.int64)
                # The last column is the weight of fixed records, whose element is -1.
                k[:, -1] = 1
                for row, rep in zip(k, reps):
                    drawn = [int(hashlib.md5(f"{seed}|{rep}|{slot}".encode()).hexdigest()[:8], 16) % n_elements for slot in range(n_elements)]
                    row[:-1] = np.bincount(drawn, minlength=n_elements) if drawn else 0
                for r in (rankings.as_py() or []):
                    elem = np.array([t["elem"] for t in r["top"] or []], dtype=np.int64)
                    weight = k[:, elem]
                    before = np.cumsum(weight, axis=1) - weight
                    top = np.clip(depth - before, 0, weight)
                    at = np.array([c["elem"] for c in r["counts"]], dtype=np.int64)
                    cells = {}
                    for f in flags:
                        inside = np.array([t[f] for t in r["top"] or []], dtype=bool)
                        cells[f"{f}_a"], cells[f"{f}_b"] = top[:, inside].sum(axis=1), top[:, ~inside].sum(axis=1)
                        for cell, less, side in (("c", "a", "in"), ("d", "b", "out")):
                            cells[f"{f}_{cell}"] = k[:, at] @ np.array([c[f"{f}_{side}"] for c in r["counts"]], dtype=np.int64) - cells[f"{f}_{less}"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), seed)), pa.array(reps), pa.array([r["ranking"]] * len(reps), pa.string()), *[pa.array(cells[n], pa.int64()) for n in names]], schema=schema)

    return dealt.mapInArrow(run, f"seed long, rep long, {ranking} string, " + ", ".join(f"{n} long" for n in names))


def contrast_change(cells: DataFrame, by: list[str], reference: str, narrow: str, wide: str) -> DataFrame:
    """Per comparator ranking: (log OR of the reference ranking less the comparator's) on the narrow flag, less the same on the wide flag."""
    rows = cells.withColumn("_n", log_or(*[f"{narrow}_{c}" for c in "abcd"])).withColumn("_w", log_or(*[f"{wide}_{c}" for c in "abcd"])).select(*by, "ranking", (F.col("_n") - F.col("_w")).alias("_v"))
    ref = rows.where(F.col("ranking") == reference).select(*by, F.col("_v").alias("_ref"))
    return rows.where(F.col("ranking") != reference).join(ref, by).select(*by, F.col("ranking").alias("comparator"), (F.col("_ref") - F.col("_v")).alias("delta"))


def interval_summary(deltas: DataFrame, by: list[str]) -> DataFrame:
    """The 2.5 and 97.5 percentiles (linear interpolation) and whether they exclude 0."""
    out = deltas.groupBy(*by).agg(F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"), F.count("*").alias("n"))
    return out.select(*by, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), ((F.col("_q")[0] > 0) | (F.col("_q")[1] < 0)).alias("excludes_zero"), "n")
