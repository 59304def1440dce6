"""Linkage statistics of pairs of alleles from phased haplotypes, by sufficient statistics.

Haplotypes are rows (population, hap, variant, allele) with a whole number hap and allele 0, 1 or null (missing).
They are packed 64 to a row: one long holds the ALT bits of a variant, another the bits of those that are not
missing. A pair's counts are bit counts of ANDs, so a self-join has a row for 64 haplotypes of a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = 20


def genotype_alleles(gt: Column, collapse: bool = False) -> Column:
    """The two alleles of a phased or unphased genotype; '.' is null. collapse: any non-reference allele is 1."""
    value = lambda x: F.when(x == ".", None).otherwise(x.cast("int"))
    alleles = F.transform(F.split(gt, r"[|/]"), value)
    return F.transform(alleles, lambda a: F.when(a > 0, 1).otherwise(a)) if collapse else alleles


def packed(haps: DataFrame) -> DataFrame:
    """(population, variant, word, alt, known): 64 haplotypes a row, haplotype h at bit h mod 64 of word floor(h / 64).

    A repeated row of a haplotype and variant counts once; the ALT of two that differ wins. Numbers without gaps
    fill the words best; others work, too. A null population is none and left out, as in a join.
    """
    bit = F.expr("shiftleft(1L, CAST(pmod(hap, 64) AS INT))")
    zero = F.lit(0).cast("long")
    return haps.where("population IS NOT NULL").groupBy("population", "variant", F.floor(F.col("hap") / 64).alias("word")).agg(
        F.bit_or(F.when(F.col("allele") == 1, bit).otherwise(zero)).alias("alt"), F.bit_or(F.when(F.col("allele").isNotNull(), bit).otherwise(zero)).alias("known")
    )


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    a = packed(left).select("population", "word", F.col("variant").alias("v1"), F.col("alt").alias("_x"), F.col("known").alias("_kx"))
    b = packed(right).select("population", "word", F.col("variant").alias("v2"), F.col("alt").alias("_y"), F.col("known").alias("_ky"))
    return a.join(b, ["population", "word"]).where("v1 <> v2")


def _counted(pairs: DataFrame, ok: Column) -> DataFrame:
    """Bit counts of each pair under the mask ok, summed over words."""
    total = lambda mask: F.sum(F.bit_count(mask).cast("long"))
    both = F.col("_x").bitwiseAND(F.col("_y"))
    counts = {"n": ok, "x": ok.bitwiseAND(F.col("_x")), "y": ok.bitwiseAND(F.col("_y")), "xy": ok.bitwiseAND(both)}
    return pairs.groupBy("population", "v1", "v2").agg(*[total(mask).alias(c) for c, mask in counts.items()])


def pair_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(population, v1, v2, n, x, y, xy): pairwise-complete haplotypes, ALT counts, and joint ALT count; pairs without a complete haplotype are left out."""
    return _counted(_pairs(left, right), F.col("_kx").bitwiseAND(F.col("_ky"))).where("n > 0")


def listwise_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(population, v1, v2, n, x, y, xy) over haplotypes that are complete in v1 and in every variant of right; n may be 0.

    A word's complete haplotypes are the AND of its partners' masks, or none if a partner has no row there. The
    number of partners is one broadcast row.
    """
    partners = right.agg(F.countDistinct("variant").alias("_all"))
    masks = packed(right).groupBy("population", "word").agg(F.bit_and("known").alias("_mask"), F.count("*").alias("_k"))
    whole = masks.join(F.broadcast(partners)).select("population", "word", F.when(F.col("_k") == F.col("_all"), F.col("_mask")).otherwise(F.lit(0).cast("long")).alias("_whole"))
    return _counted(_pairs(left, right).join(whole, ["population", "word"]), F.col("_whole").bitwiseAND(F.col("_kx")))


def linkage(counts: DataFrame, least: int = LEAST, small_n: str = "null") -> DataFrame:
    """counts plus p, q, r2 (capped at 1), d_prime, r2_max (most that the frequencies allow) and r2_fraction.

    Monomorphic pairs have r2 = d_prime = 0. Pairs with fewer than least haplotypes are null, zero or
    dropped, as small_n says.
    """
    p, q, pq = (F.try_divide(F.col(c), F.col("n")) for c in ("x", "y", "xy"))
    rows = counts.withColumn("p", p).withColumn("q", q).withColumn("_d", pq - p * q)
    var = F.col("p") * (1 - F.col("p")) * F.col("q") * (1 - F.col("q"))
    top = F.when(F.col("_d") >= 0, F.least(F.col("p") * (1 - F.col("q")), (1 - F.col("p")) * F.col("q"))).otherwise(F.least(F.col("p") * F.col("q"), (1 - F.col("p")) * (1 - F.col("q"))))
    poly = var > 0
    rows = rows.withColumn("r2", F.when(poly, F.least(F.lit(1.0), F.col("_d") * F.col("_d") / var)).otherwise(0.0))
    rows = rows.withColumn("d_prime", F.when(poly & (top > 0), F.abs(F.col("_d")) / top).otherwise(0.0))
    rows = rows.withColumn("r2_max", F.when(poly, F.least(F.lit(1.0), top * top / var)).otherwise(0.0))
    rows = rows.withColumn("r2_fraction", F.when(F.col("r2_max") > 0, F.col("r2") / F.col("r2_max")).otherwise(0.0)).drop("_d")
    if small_n == "drop":
        return rows.where(F.col("n") >= least)
    blank = None if small_n == "null" else 0.0
    for c in ("r2", "d_prime", "r2_max", "r2_fraction"):
        rows = rows.withColumn(c, F.when(F.col("n") >= least, F.col(c)).otherwise(F.lit(blank)))
    return rows


def allele_frequencies(haps: DataFrame) -> DataFrame:
    return haps.groupBy("population", "variant").agg(F.avg("allele").alias("alt_af"), F.count("allele").alias("n"))


def common_somewhere(haps: DataFrame, min_alt_af: float) -> DataFrame:
    """Variants whose ALT frequency reaches min_alt_af in some population (near-fixed alleles pass too)."""
    return allele_frequencies(haps).groupBy("variant").agg(F.max("alt_af").alias("max_af")).where(F.col("max_af") >= min_alt_af)


def verdict(r2: Column, strong: float = 0.8, weak: float = 0.2) -> Column:
    return F.when(r2.isNull(), "not evaluable").when(r2 >= strong, "tags the gene").when(r2 >= weak, "partial").otherwise("independent")


def best_partner(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each candidate's partner and population of largest r2, above 0 only; ties go to the smaller partner, then population."""
    order = Window.partitionBy("v1").orderBy(F.desc("r2"), "v2", "population")
    best = pairs.where("r2 > 0").withColumn("_n", F.row_number().over(order)).where("_n = 1").select(F.col("v1").alias("variant"), F.col("v2").alias("partner"), "population", F.col("r2").alias("max_r2"), F.col("d_prime").alias("d_prime_at_max"))
    return candidates.join(best, "variant", "left").withColumn("verdict", verdict(F.col("max_r2")))
