"""Queries over rankings, contingency tables, statistics, linkage and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import linkage as L
from ..operators import ranking as R
from ..operators import resample as B
from ..operators import stats as S
from ..operators.quantiles import quantiles
from ..sources.landing import landed
from .roles import BIN, HAP, HAPM, MG, REC, SC, elements, haplotypes, haplotypes_with_gaps, merged, merged_sql, records, scores, scores_wide, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


SM = SC + ", " + MG[len(REC) + 2 :]
FLAG = SM + """, fl AS (SELECT event_id, EXISTS (SELECT 1 FROM mg WHERE rec.pos >= mg.start AND rec.pos < mg."end") AS in_peak FROM rec),
rk AS (SELECT sc.*, in_peak, row_number() OVER (PARTITION BY ranking ORDER BY abs(score) DESC, event_id) AS rank FROM sc JOIN fl USING (event_id))"""
CELLS = FLAG + """, tb AS (SELECT ranking, depth, count(*) FILTER (rank <= depth AND in_peak) AS a, count(*) FILTER (rank <= depth AND NOT in_peak) AS b,
 count(*) FILTER (rank > depth AND in_peak) AS c, count(*) FILTER (rank > depth AND NOT in_peak) AS d FROM rk, (VALUES (25), (50), (100), (200)) v(depth) GROUP BY ALL)"""
LOGOR = "ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))"


def flagged(spark, d):
    flags = iv.is_hit(records(spark, d).select("event_id", "pos"), merged(spark, d), BIN, "event_id").select("event_id", "in_peak")
    return scores(spark, d).join(flags, "event_id")


def tables(spark, d):
    return R.top_tables(flagged(spark, d), ["ranking"], "score", "event_id", "in_peak")


@query("enrich_top200", f"WITH {CELLS} SELECT ranking, CAST(depth AS BIGINT) AS depth, a, b, c, d, round({LOGOR}, 9) AS log_or FROM tb WHERE depth = 200")
def enrich_top200(spark, d):
    """The flagship: merged intervals, hits, rankings, 2x2 cells and log odds ratios."""
    return tables(spark, d).where("depth = 200").select("ranking", F.col("depth").cast("long").alias("depth"), "a", "b", "c", "d", F.round(S.log_or(), 9).alias("log_or"))


@query("TCT_contingency_cells", f"WITH {CELLS} SELECT ranking, CAST(depth AS BIGINT) AS depth, a, b, c, d FROM tb")
def contingency(spark, d):
    return tables(spark, d).withColumn("depth", F.col("depth").cast("long"))


@query("O5_multi_depth", f"WITH {CELLS} SELECT ranking, count(*) AS depths, CAST(sum(a) AS BIGINT) AS hits FROM tb GROUP BY 1")
def multi_depth(spark, d):
    return tables(spark, d).groupBy("ranking").agg(F.count("*").alias("depths"), F.sum("a").alias("hits"))


@query("TLOR_haldane", f"WITH {CELLS} SELECT ranking, CAST(depth AS BIGINT) AS depth, round({LOGOR}, 9) AS log_or, CASE WHEN a > 0 AND c > 0 THEN round({LOGOR}, 9) END AS log_or_or_null FROM tb")
def haldane(spark, d):
    return tables(spark, d).select("ranking", F.col("depth").cast("long").alias("depth"), F.round(S.log_or(), 9).alias("log_or"), F.round(S.log_or(null_if_empty=True), 9).alias("log_or_or_null"))


@query("TSOR_sample_odds_ratio", f"WITH {CELLS} SELECT ranking, CAST(depth AS BIGINT) AS depth, round(CASE WHEN b * c > 0 THEN a * d / (b * c) END, 9) AS odds_ratio FROM tb")
def sample_ratio(spark, d):
    return tables(spark, d).select("ranking", F.col("depth").cast("long").alias("depth"), F.round(S.sample_or(), 9).alias("odds_ratio"))


FISHER = """, xs AS (SELECT ranking, depth, a, b, c, d, x, exp(lgamma(a+b+1) - lgamma(x+1) - lgamma(a+b-x+1) + lgamma(c+d+1) - lgamma(a+c-x+1) - lgamma(c+d-(a+c-x)+1)
 - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1)) AS p FROM (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM tb))"""


@query("TFE1_fisher_greater", f"WITH {CELLS}{FISHER} SELECT ranking, CAST(depth AS BIGINT) AS depth, round(sum(p) FILTER (x >= a), 6) AS p FROM xs GROUP BY ALL")
def fisher_greater(spark, d):
    return S.with_exact(tables(spark, d)).select("ranking", F.col("depth").cast("long").alias("depth"), F.round("p_greater", 6).alias("p"))


@query("TFE2_fisher_two_sided", f"WITH {CELLS}{FISHER}, pt AS (SELECT ranking, depth, p AS pa FROM xs WHERE x = a) SELECT ranking, CAST(depth AS BIGINT) AS depth, round(least(1, sum(p) FILTER (p <= pa * (1 + 1e-7))), 6) AS p FROM xs JOIN pt USING (ranking, depth) GROUP BY ALL")
def fisher_two(spark, d):
    return S.with_exact(tables(spark, d)).select("ranking", F.col("depth").cast("long").alias("depth"), F.round("p_two_sided", 6).alias("p"))


# The conditional estimate and both ends of its interval by halving the log odds ratio's range 80 times.
EXACT = f"""WITH RECURSIVE {CELLS}, sp AS (SELECT *, greatest(0, a - d) AS x0, least(a + b, a + c) AS x1 FROM tb),
w AS (SELECT ranking, depth, a, x, -lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lw FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM sp)),
st AS (SELECT ranking, depth, kind, 0 AS i, CAST(-60 AS DOUBLE) AS lo, CAST(60 AS DOUBLE) AS hi FROM sp, (VALUES ('est'), ('low'), ('high')) k(kind)
 UNION ALL SELECT ranking, depth, kind, i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
  SELECT ranking, depth, kind, i, lo, hi, mid, CASE kind WHEN 'est' THEN sum(x * e) / sum(e) < a WHEN 'low' THEN sum(CASE WHEN x >= a THEN e ELSE 0 END) / sum(e) < 0.025 ELSE sum(CASE WHEN x <= a THEN e ELSE 0 END) / sum(e) > 0.025 END AS up
  FROM (SELECT st.*, (lo + hi) / 2 AS mid, x, a, exp(lw + x * (lo + hi) / 2 - max(lw + x * (lo + hi) / 2) OVER (PARTITION BY st.ranking, st.depth, kind)) AS e FROM st JOIN w ON st.ranking = w.ranking AND st.depth = w.depth WHERE i < 80)
  GROUP BY ranking, depth, kind, i, lo, hi, mid, a)),
sv AS (SELECT ranking, depth, exp(max(lo) FILTER (kind = 'est')) AS est, exp(max(lo) FILTER (kind = 'low')) AS low, exp(max(lo) FILTER (kind = 'high')) AS high FROM st WHERE i = 80 GROUP BY ALL),
ex AS (SELECT ranking, CAST(depth AS BIGINT) AS depth, CASE WHEN x0 = x1 THEN NULL WHEN a = x0 THEN 0 WHEN a < x1 THEN round(est, 6) END AS odds_ratio, CASE WHEN a = x0 THEN 0 ELSE round(low, 6) END AS ci_low,
 CASE WHEN a < x1 THEN round(high, 6) END AS ci_high, a = x1 AS ci_high_unbounded FROM sp JOIN sv USING (ranking, depth)) """


@query("TCOR_conditional_odds_ratio", EXACT + "SELECT * FROM ex")
def conditional_ratio(spark, d):
    x = S.with_exact(tables(spark, d))
    return x.select("ranking", F.col("depth").cast("long").alias("depth"), *[F.round(c, 6).alias(c) for c in ("odds_ratio", "ci_low", "ci_high")], "ci_high_unbounded")


@query("TCIX_excludes_one", EXACT + "SELECT ranking, coalesce(string_agg(CAST(depth AS VARCHAR), ',' ORDER BY depth) FILTER (ci_low > 1 OR ci_high < 1), '') AS depths_excluding_one FROM ex GROUP BY 1")
def excludes_one(spark, d):
    x = S.with_exact(tables(spark, d))
    out = (F.col("ci_low") > 1) | (F.coalesce(F.col("ci_high"), F.lit(float("inf"))) < 1)
    return x.groupBy("ranking").agg(F.array_join(F.array_sort(F.collect_list(F.when(out, F.col("depth")))), ",").alias("depths_excluding_one"))


@query("TCON_contrast", f"WITH {CELLS}, lo AS (SELECT ranking, depth, {LOGOR} AS v FROM tb) SELECT o.ranking AS comparator, CAST(o.depth AS BIGINT) AS depth, round(r.v - o.v, 9) AS contrast FROM lo o JOIN lo r ON r.depth = o.depth AND r.ranking = 'score_1' WHERE o.ranking <> 'score_1'")
def contrast(spark, d):
    lo = tables(spark, d).select("ranking", "depth", S.log_or().alias("v"))
    ref = lo.where("ranking = 'score_1'").select("depth", F.col("v").alias("r"))
    return lo.where("ranking <> 'score_1'").join(ref, "depth").select(F.col("ranking").alias("comparator"), F.col("depth").cast("long").alias("depth"), F.round(F.col("r") - F.col("v"), 9).alias("contrast"))


@query("A18_argmax_ranking", f"WITH {CELLS} SELECT CAST(depth AS BIGINT) AS depth, ranking AS best FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY {LOGOR} DESC, ranking) AS n FROM tb WHERE ranking <> 'score_1') WHERE n = 1")
def best_ranking(spark, d):
    rows = tables(spark, d).where("ranking <> 'score_1'").select("ranking", "depth", S.log_or().alias("v"))
    return rows.groupBy(F.col("depth").cast("long").alias("depth")).agg(F.min(F.struct((-F.col("v")).alias("v"), "ranking")).alias("b")).select("depth", F.col("b.ranking").alias("best"))


@query("A19_win_count", f"WITH {CELLS}, lo AS (SELECT ranking, depth, {LOGOR} AS v FROM tb), g AS (SELECT depth, max(v) FILTER (ranking IN ('score_1', 'score_2')) AS own, max(v) FILTER (ranking NOT IN ('score_1', 'score_2')) AS other FROM lo GROUP BY 1) SELECT count(*) FILTER (own > other) AS wins, count(*) AS depths FROM g")
def win_count(spark, d):
    own = F.col("ranking").isin("score_1", "score_2")
    g = tables(spark, d).withColumn("v", S.log_or()).groupBy("depth").agg(F.max(F.when(own, F.col("v"))).alias("own"), F.max(F.when(~own, F.col("v"))).alias("other"))
    return g.agg(F.count_if(F.col("own") > F.col("other")).alias("wins"), F.count("*").alias("depths"))


@query("A10_distribution_summary", f"WITH {SC} SELECT ranking, count(*) AS n, round(median(abs(score)), 9) AS median, round(quantile_cont(abs(score), 0.95), 9) AS p95, max(abs(score)) AS largest, round(avg(CAST(abs(score) > 0.01 AS INTEGER)), 9) AS over FROM sc GROUP BY 1")
def distribution(spark, d):
    s = scores(spark, d).withColumn("x", F.abs("score"))
    sums = s.groupBy("ranking").agg(F.count("*").alias("n"), F.max("x").alias("largest"), F.round(F.avg((F.col("x") > 0.01).cast("int")), 9).alias("over"))
    at = quantiles(s, ["ranking"], "x", {"median": 0.5, "p95": 0.95}).select("ranking", F.round("median", 9).alias("median"), F.round("p95", 9).alias("p95"))
    return sums.join(at, "ranking")


@query("W1_rank_by_abs", f"WITH {SC} SELECT ranking, event_id, row_number() OVER (PARTITION BY ranking ORDER BY abs(score) DESC, event_id) AS rank FROM sc")
def rank_by_abs(spark, d):
    return R.ranked_whole(scores(spark, d), ["ranking"], "score", "event_id").select("ranking", "event_id", F.col("rank").cast("long").alias("rank"))


@query("O2_top_k", f"WITH {SC} SELECT event_id, score FROM sc WHERE ranking = 'score_3' ORDER BY abs(score) DESC, event_id LIMIT 25")
def top_k(spark, d):
    return scores_wide(spark, d).select("event_id", F.col("score_3").alias("score")).orderBy(F.abs("score").desc(), "event_id").limit(25)


@query("O3_top_k_null_first", f"WITH {SC} SELECT event_id, CASE WHEN af > 0.99 THEN NULL ELSE score END AS score FROM sc WHERE ranking = 'score_3' ORDER BY abs(CASE WHEN af > 0.99 THEN NULL ELSE score END) DESC NULLS FIRST, event_id LIMIT 25")
def top_k_null_first(spark, d):
    s = scores_wide(spark, d).select("event_id", F.when(F.col("af") > 0.99, None).otherwise(F.col("score_3")).alias("score"))
    return s.orderBy(F.abs("score").desc_nulls_first(), "event_id").limit(25)


@query("W4_percentile_of", f"WITH {SC} SELECT event_id, round((rank() OVER (ORDER BY abs(score)) - 1) * 100.0 / count(*) OVER (), 9) AS percentile FROM sc WHERE ranking = 'score_1'")
def percentile_of(spark, d):
    return R.percentile_of(scores(spark, d).where("ranking = 'score_1'"), ["ranking"], "score").select("event_id", F.round("percentile", 9).alias("percentile"))


@query("W5_percentile_in_stratum", f"WITH {SC} SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY abs(score)) - 1) * 100.0 / count(*) OVER (PARTITION BY event_type), 9) AS percentile FROM sc WHERE ranking = 'score_1'")
def percentile_in_stratum(spark, d):
    return R.percentile_of(scores(spark, d).where("ranking = 'score_1'"), ["event_type"], "score").select("event_id", F.round("percentile", 9).alias("percentile"))


@query("TEX_extreme_any", f"WITH p AS ({ORACLE['W5_percentile_in_stratum']}), {REC} SELECT event_type, bool_or(percentile > 95) AS any_extreme, count(*) FILTER (percentile > 95) AS n FROM p JOIN rec USING (event_id) GROUP BY 1")
def extreme_any(spark, d):
    rows = R.percentile_of(scores(spark, d).where("ranking = 'score_1'"), ["event_type"], "score")
    return rows.groupBy("event_type").agg(F.bool_or(F.col("percentile") > 95).alias("any_extreme"), F.count_if(F.col("percentile") > 95).alias("n"))


@query("TLR_regression", "SELECT l_returnflag, count(*) AS n, round(regr_slope(ln(l_extendedprice), l_quantity), 9) AS slope, round(regr_intercept(ln(l_extendedprice), l_quantity), 6) AS intercept, round(corr(ln(l_extendedprice), l_quantity), 9) AS r FROM lineitem GROUP BY 1")
def regression(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.ln("l_extendedprice").alias("y"))
    return S.regression(rows, ["l_returnflag"], "x", "y").select("l_returnflag", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r", 9).alias("r"))


@query("TLR_residuals", f"WITH l AS (SELECT *, ln(l_extendedprice) AS y FROM lineitem), f AS (SELECT l_returnflag, regr_slope(y, l_quantity) AS s, regr_intercept(y, l_quantity) AS i FROM l GROUP BY 1) SELECT l_orderkey, l_linenumber, round(y - s * l_quantity - i, 6) AS residual FROM l JOIN f USING (l_returnflag)")
def residuals(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("x"), F.ln("l_extendedprice").alias("y"))
    fit = S.regression(rows, ["l_returnflag"], "x", "y").select("l_returnflag", "slope", "intercept")
    return rows.join(fit, "l_returnflag").select("l_orderkey", "l_linenumber", F.round(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"), 6).alias("residual"))


# With t = sqrt(v) tan(z), Student's tail is an integral of cos(z) ** (v - 1): Simpson's rule over 20,000 steps.
@query("TLR_p_values", """WITH f AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_quantity, l_discount) AS slope, regr_intercept(l_quantity, l_discount) AS intercept, corr(l_discount, l_quantity) AS r FROM lineitem WHERE l_discount IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1),
 t AS (SELECT *, n - 2 AS v, r * sqrt((n - 2) / (1 - r * r)) AS t FROM f), z AS (SELECT *, atan(abs(t) / sqrt(v)) AS z0, least(pi() / 2, atan(abs(t) / sqrt(v)) + 40 / sqrt(v)) AS z1 FROM t),
 q AS (SELECT l_returnflag, v, (z1 - z0) / 20000 AS h, z0 + i * (z1 - z0) / 20000 AS z, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM z, range(0, 20001) s(i)),
 p AS (SELECT l_returnflag, sum(w * exp((v - 1) * ln(greatest(cos(z), 1e-300)))) * max(h) / 3 * 2 / sqrt(pi()) * exp(lgamma((max(v) + 1) / 2) - lgamma(max(v) / 2)) AS p FROM q GROUP BY 1)
 SELECT l_returnflag, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 9) AS r, round(abs(slope / t), 6) AS se, round(p, 6) AS p FROM z JOIN p USING (l_returnflag)""")
def regression_p(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").alias("x"), F.col("l_quantity").alias("y"))
    out = S.regression(rows, ["l_returnflag"], "x", "y")
    return out.select("l_returnflag", "n", *[F.round(c, 9 if c == "r" else 6).alias(c) for c in ("slope", "intercept", "r", "se", "p")])


@query("TPR_pearson", "SELECT round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem WHERE isfinite(l_quantity) AND isfinite(l_extendedprice)")
def pearson(spark, d):
    rows = table(spark, d, "lineitem").where(~F.isnan("l_quantity") & ~F.isnan("l_extendedprice"))
    return rows.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("r"))


AVG_RANK = "(rank() OVER (PARTITION BY p_type ORDER BY {c}) + (count(*) OVER (PARTITION BY p_type, {c}) - 1) / 2.0)"


@query("TSP_spearman", f"WITH r AS (SELECT p_type, {AVG_RANK.format(c='p_size')} AS a, {AVG_RANK.format(c='p_retailprice')} AS b FROM part) SELECT p_type, count(*) AS n, round(corr(a, b), 9) AS rho FROM r GROUP BY 1 HAVING count(*) > 10")
def spearman(spark, d):
    return S.spearman(table(spark, d, "part"), ["p_type"], "p_size", "p_retailprice").select("p_type", "n", F.round("rho", 9).alias("rho"))


@query("W6_average_rank", f"SELECT p_partkey, {AVG_RANK.format(c='p_size')} AS avg_rank FROM part")
def average_rank(spark, d):
    return R.with_average_rank(table(spark, d, "part"), ["p_type"], "p_size", "avg_rank").select("p_partkey", "avg_rank")


LD = HAP + """, ct AS (SELECT a.population, a.variant AS v1, b.variant AS v2, count(*) AS n, CAST(sum(a.allele) AS BIGINT) AS x, CAST(sum(b.allele) AS BIGINT) AS y, CAST(sum(a.allele * b.allele) AS BIGINT) AS xy
 FROM hap a JOIN hap b ON a.population = b.population AND a.hap = b.hap AND a.variant <> b.variant WHERE a.variant < 8 AND b.variant >= 8 GROUP BY ALL),
fr AS (SELECT *, x / n AS p, y / n AS q, xy / n - (x / n) * (y / n) AS dd, (x / n) * (1 - x / n) * (y / n) * (1 - y / n) AS var FROM ct WHERE n >= 20),
tp AS (SELECT *, CASE WHEN dd >= 0 THEN least(p * (1 - q), (1 - p) * q) ELSE least(p * q, (1 - p) * (1 - q)) END AS top FROM fr),
ld AS (SELECT population, v1, v2, n, p, q, CASE WHEN var > 0 THEN least(1, dd * dd / var) ELSE 0 END AS r2, CASE WHEN var > 0 AND top > 0 THEN abs(dd) / top ELSE 0 END AS d_prime, CASE WHEN var > 0 THEN least(1, top * top / var) ELSE 0 END AS r2_max FROM tp)"""


def pairs(spark, d):
    h = haplotypes(spark, d)
    return L.linkage(L.pair_counts(h.where("variant < 8"), h.where("variant >= 8")), small_n="drop")


@query("G3_r2_dprime", f"WITH {LD} SELECT population, v1, v2, n, round(r2, 9) AS r2, round(d_prime, 9) AS d_prime FROM ld")
def r2_dprime(spark, d):
    return pairs(spark, d).select("population", "v1", "v2", "n", F.round("r2", 9).alias("r2"), F.round("d_prime", 9).alias("d_prime"))


# One against many: only haplotypes complete in the variant and all its partners count; fewer than 20 give zeros.
LISTWISE = HAPM + """, pr AS (SELECT count(DISTINCT variant) AS k FROM hap WHERE variant >= 8), wh AS (SELECT population, hap, count(allele) = any_value(k) AS whole FROM hap, pr WHERE variant >= 8 GROUP BY ALL),
 ct AS (SELECT a.population, a.variant AS v1, b.variant AS v2, count(*) FILTER (whole AND a.allele IS NOT NULL) AS n, avg(a.allele) FILTER (whole) AS p, avg(b.allele) FILTER (whole AND a.allele IS NOT NULL) AS q, avg(a.allele * b.allele) FILTER (whole) AS pq
 FROM hap a JOIN hap b USING (population, hap) JOIN wh USING (population, hap) WHERE a.variant < 8 AND b.variant >= 8 GROUP BY ALL)"""


@query("G4_r2_vector", f"WITH {LISTWISE} SELECT population, v1, v2, n, round(CASE WHEN n >= 20 AND p * (1 - p) * q * (1 - q) > 0 THEN least(1, (pq - p * q) * (pq - p * q) / (p * (1 - p) * q * (1 - q))) ELSE 0 END, 9) AS r2 FROM ct")
def r2_vector(spark, d):
    h = haplotypes_with_gaps(spark, d)
    rows = L.linkage(L.listwise_counts(h.where("variant < 8"), h.where("variant >= 8")), small_n="zero")
    return rows.select("population", "v1", "v2", "n", F.round("r2", 9).alias("r2"))


PAIRWISE = HAPM + """, af AS (SELECT population, variant, avg(allele) AS f FROM hap WHERE variant >= 8 GROUP BY ALL), cm AS (SELECT variant FROM af GROUP BY 1 HAVING max(f) >= 0.55),
 ct AS (SELECT a.population, a.variant AS v1, b.variant AS v2, count(*) AS n, avg(a.allele) AS p, avg(b.allele) AS q, avg(a.allele * b.allele) AS pq FROM hap a JOIN hap b USING (population, hap) JOIN cm ON cm.variant = b.variant
 WHERE a.variant < 8 AND b.variant >= 8 AND a.allele IS NOT NULL AND b.allele IS NOT NULL GROUP BY ALL)"""


@query("J7_candidates_partners_populations", f"WITH {PAIRWISE} SELECT population, v1, v2, n, round(CASE WHEN n < 20 THEN NULL WHEN p * (1 - p) * q * (1 - q) > 0 THEN least(1, (pq - p * q) * (pq - p * q) / (p * (1 - p) * q * (1 - q))) ELSE 0 END, 9) AS r2 FROM ct")
def candidates_partners(spark, d):
    """Every candidate with every partner that is common in some population, in every population: pairwise-complete haplotypes, null below 20."""
    h = haplotypes_with_gaps(spark, d)
    partners = h.where("variant >= 8")
    common = partners.join(L.common_somewhere(partners, 0.55), "variant", "left_semi")
    return L.linkage(L.pair_counts(h.where("variant < 8"), common)).select("population", "v1", "v2", "n", F.round("r2", 9).alias("r2"))


@query("G5_max_attainable", f"WITH {LD} SELECT population, v1, v2, round(r2_max, 9) AS r2_max, round(CASE WHEN r2_max > 0 THEN r2 / r2_max ELSE 0 END, 9) AS fraction FROM ld")
def max_attainable(spark, d):
    return pairs(spark, d).select("population", "v1", "v2", F.round("r2_max", 9).alias("r2_max"), F.round("r2_fraction", 9).alias("fraction"))


@query("G6_common_somewhere", f"WITH {HAP} SELECT variant FROM (SELECT population, variant, avg(allele) AS af FROM hap GROUP BY ALL) GROUP BY variant HAVING max(af) >= 0.6")
def common_somewhere(spark, d):
    return L.common_somewhere(haplotypes(spark, d), 0.6).select("variant")


@query("G7_best_partner", f"WITH {LD}, b AS (SELECT *, row_number() OVER (PARTITION BY v1 ORDER BY r2 DESC, v2, population) AS rn FROM (SELECT population, v1, v2, round(r2, 12) AS r2 FROM ld) WHERE r2 > 0) SELECT v1 AS variant, v2 AS partner, population, round(r2, 9) AS max_r2, CASE WHEN r2 >= 0.8 THEN 'tags the gene' WHEN r2 >= 0.2 THEN 'partial' ELSE 'independent' END AS verdict FROM b WHERE rn = 1")
def best_partner(spark, d):
    rounded = pairs(spark, d).withColumn("r2", F.round("r2", 12))
    candidates = spark.range(8).select(F.col("id").cast("int").alias("variant"))
    return L.best_partner(rounded, candidates).select("variant", "partner", "population", F.round("max_r2", 9).alias("max_r2"), "verdict")


@query("G9_high_dprime_low_r2", f"WITH {LD} SELECT population, v1, v2 FROM ld WHERE d_prime >= 0.8 AND r2 < 0.2")
def high_dprime(spark, d):
    return pairs(spark, d).where("d_prime >= 0.8 AND r2 < 0.2").select("population", "v1", "v2")


@query("G9_high_dprime_low_r2_at_0_3", f"WITH {LD} SELECT population, v1, v2, round(d_prime, 9) AS d_prime, round(r2, 9) AS r2 FROM ld WHERE d_prime >= 0.3 AND r2 < 0.2")
def high_dprime_lower(spark, d):
    """The same at a bound that pairs of these tables reach."""
    rows = pairs(spark, d).where("d_prime >= 0.3 AND r2 < 0.2")
    return rows.select("population", "v1", "v2", F.round("d_prime", 9).alias("d_prime"), F.round("r2", 9).alias("r2"))


@query("G8_internal_control", f"WITH {LD} SELECT population, v1, v2 FROM ld WHERE v1 = 0 AND v2 = 8 AND r2 < 0.8")
def internal_control(spark, d):
    """Pairs of the control that fall short; no rows means that the control holds."""
    return pairs(spark, d).where("v1 = 0 AND v2 = 8 AND r2 < 0.8").select("population", "v1", "v2")


@query("G10_population_frequency", f"WITH {HAP} SELECT population, variant, round(avg(allele), 9) AS alt_af FROM hap GROUP BY ALL")
def population_frequency(spark, d):
    return L.allele_frequencies(haplotypes(spark, d)).select("population", "variant", F.round("alt_af", 9).alias("alt_af"))


@query("G11_verdict_tally", f"WITH v AS ({ORACLE['G7_best_partner']}) SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def verdict_tally(spark, d):
    return best_partner(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("A24_minor_copies", f"WITH {HAP} SELECT variant, CAST(sum(allele) AS BIGINT) AS copies FROM hap GROUP BY 1")
def minor_copies(spark, d):
    return haplotypes(spark, d).groupBy("variant").agg(F.sum("allele").alias("copies"))


EDGES = [0.0, 1000.0, 3000.0, 6000.0, 10001.0]
BINS = "CASE WHEN {c} > 0 AND {c} <= 1000 THEN 0 WHEN {c} > 1000 AND {c} <= 3000 THEN 1 WHEN {c} > 3000 AND {c} <= 6000 THEN 2 WHEN {c} > 6000 AND {c} <= 10001 THEN 3 END"
MD5 = "CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


@query("B1_stratified_sample", f"WITH q AS (SELECT {BINS.format(c='s_acctbal')} AS bin, count(*) AS quota FROM supplier GROUP BY 1), p AS (SELECT c_custkey, {BINS.format(c='c_acctbal')} AS bin FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {MD5.format(x=chr(39) + '0|' + chr(39) + ' || c_custkey')}, c_custkey) AS rn FROM p WHERE bin IS NOT NULL) SELECT c_custkey, n.bin FROM n JOIN q ON n.bin = q.bin WHERE rn <= quota")
def stratified_sample(spark, d):
    pool = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    target = table(spark, d, "supplier").select(F.col("s_acctbal").alias("v"))
    return B.stratified(pool, target, "v", EDGES, "c_custkey").select("c_custkey", "bin")


@query("A22_bin_quota", f"SELECT {BINS.format(c='s_acctbal')} AS bin, count(*) AS quota FROM supplier WHERE s_acctbal > 0 AND s_acctbal <= 10001 GROUP BY 1")
def bin_quota(spark, d):
    v = F.col("s_acctbal")
    bins = F.coalesce(*[F.when((v > lo) & (v <= hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(EDGES, EDGES[1:]))])
    return table(spark, d, "supplier").withColumn("bin", bins).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("quota"))


#: Replicates of the shared-draw bootstrap; the stability grid's are below it.
REPS = 500
GRID_SEEDS, GRID = [1, 2, 3], [500, 2000, 5000]


def boot_rows(spark, d):
    """Scores with the element of their position, numbered anew over elements that hold records, and the two flags."""
    split = iv.split_by_midpoint(elements(spark, d).drop("elem_id"), merged(spark, d, "view").select("start", "end")).select("start", "end", "shared")
    found = iv.hits(records(spark, d).select("event_id", "pos"), split, BIN).select("event_id", "start", "shared")
    return scores(spark, d).join(found, "event_id", "left").withColumn("wide", F.col("start").isNotNull()).withColumn("narrow", F.coalesce(~F.col("shared"), F.lit(False)))


VIEW = merged_sql("v2", "(SELECT * FROM pk WHERE set_id = 'view')")
BOOT_SQL = f"""WITH {SM}, {VIEW},
el AS (SELECT start, "end", EXISTS (SELECT 1 FROM v2 WHERE floor((mg.start + mg."end") / 2) >= v2.start AND floor((mg.start + mg."end") / 2) < v2."end") AS shared FROM mg),
lo AS (SELECT rec.event_id, el.start, el.shared FROM rec LEFT JOIN el ON rec.pos >= el.start AND rec.pos < el."end"),
nar AS (SELECT start, row_number() OVER (ORDER BY start) - 1 AS elem FROM (SELECT DISTINCT start FROM lo WHERE NOT shared)),
rows AS (SELECT sc.ranking, sc.event_id, sc.score, nar.elem, lo.start IS NOT NULL AS wide, coalesce(NOT lo.shared, false) AS narrow FROM sc JOIN lo USING (event_id) LEFT JOIN nar ON lo.start = nar.start),
dr AS (SELECT rep, CAST('0x' || substr(md5('1|' || rep || '|' || slot), 1, 8) AS BIGINT) % (SELECT count(*) FROM nar) AS elem FROM range(0, {REPS}) r(rep), (SELECT unnest(range(0, (SELECT count(*) FROM nar))) AS slot)),
wt AS (SELECT rep, elem, count(*) AS k FROM dr GROUP BY ALL),
wr AS (SELECT r.rep, rows.*, CASE WHEN rows.elem IS NULL THEN 1 ELSE coalesce(wt.k, 0) END AS k FROM rows CROSS JOIN range(0, {REPS}) r(rep) LEFT JOIN wt ON wt.rep = r.rep AND wt.elem = rows.elem),
tp AS (SELECT *, greatest(least(k, 200 - (sum(k) OVER (PARTITION BY rep, ranking ORDER BY abs(score) DESC, event_id) - k)), 0) AS top FROM wr),
cl AS (SELECT rep, ranking, ln((sum(top) FILTER (narrow) + 0.5) * (sum(k - top) FILTER (NOT narrow) + 0.5) / ((sum(top) FILTER (NOT narrow) + 0.5) * (sum(k - top) FILTER (narrow) + 0.5)))
 - ln((sum(top) FILTER (wide) + 0.5) * (sum(k - top) FILTER (NOT wide) + 0.5) / ((sum(top) FILTER (NOT wide) + 0.5) * (sum(k - top) FILTER (wide) + 0.5))) AS v FROM tp GROUP BY ALL),
de AS (SELECT o.rep, o.ranking AS comparator, r.v - o.v AS delta FROM cl o JOIN cl r ON o.rep = r.rep AND r.ranking = 'score_1' WHERE o.ranking <> 'score_1')
"""


def boot_deltas(spark, d, seeds, replicates):
    rows = landed(boot_rows(spark, d), "boot-rows")
    named = iv.numbered(rows.where("narrow").select("start").distinct(), [], "start", [], "elem")
    named = landed(named, "boot-elements")
    rows = rows.join(named.withColumn("narrow", F.lit(True)), ["start", "narrow"], "left").select("ranking", "event_id", "score", "wide", "narrow", "elem")
    cells = B.bootstrap_cells(rows, max(1, named.count()), seeds, replicates, "ranking", "score", "event_id", ["narrow", "wide"], 200)
    return B.contrast_change(landed(cells, "boot-cells"), ["seed", "rep"], "score_1", "narrow", "wide")


@query("B5_shared_draw_bootstrap", BOOT_SQL + "SELECT comparator, round(quantile_cont(delta, 0.025), 6) AS ci_low, round(quantile_cont(delta, 0.975), 6) AS ci_high, count(*) AS n FROM de GROUP BY 1")
def shared_draw_bootstrap(spark, d):
    out = B.interval_summary(boot_deltas(spark, d, [1], REPS), ["comparator"])
    return out.select("comparator", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "n")


@query("TDEL_change_in_contrast", BOOT_SQL + "SELECT CAST(rep AS BIGINT) AS rep, comparator, round(delta, 6) AS delta FROM de")
def change_in_contrast(spark, d):
    return boot_deltas(spark, d, [1], REPS).select(F.col("rep").cast("long").alias("rep"), "comparator", F.round("delta", 6).alias("delta"))


@query("B6_stability_grid")
def stability_grid(spark, d):
    """A run of fewer replicates is the start of the longest one, so every seed is drawn once."""
    deltas = boot_deltas(spark, d, GRID_SEEDS, max(GRID)).withColumn("replicates", F.explode(F.array(*[F.lit(r) for r in GRID]))).where("rep < replicates")
    return B.interval_summary(deltas, ["seed", "replicates", "comparator"])


@query("B7_hash_draws", f"WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS elem, count(*) OVER () AS all_of_them FROM nation), d AS (SELECT rep, {MD5.format(x=chr(39) + '7|' + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || elem')} % all_of_them AS elem FROM n, range(0, 20) r(rep)) SELECT CAST(rep AS BIGINT) AS rep, n_name, count(*) AS k FROM d JOIN n USING (elem) GROUP BY ALL")
def hash_draws(spark, d):
    """How often each nation is drawn in each of 20 resamples of all nations."""
    from pyspark.sql import Window

    nations = table(spark, d, "nation").select("n_name", (F.row_number().over(Window.orderBy("n_nationkey")) - 1).cast("long").alias("elem"))
    made = B.draws(spark, [7], 20, nations.count())
    return made.join(nations, "elem").select(F.col("rep").cast("long").alias("rep"), "n_name", "k")


def drawn_sql(name: str, source: str, left: str, members: str, weight: str, c: int) -> str:
    """A class's draws: how many values of the binomial of what is left have a distribution function of at most a hash number."""
    u = f"(CAST('0x' || substr(md5('3|' || population || '|' || rep || '|{c}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"
    lw = "lgamma(m + 1) - lgamma(v + 1) - lgamma(m - v + 1) + v * ln(p) + (m - v) * ln(1 - p)"
    return f"""{name}_in AS (SELECT *, {left} AS m, {members} / nullif({weight}, 0) AS p, {u} AS u FROM {source}),
 {name}_cdf AS (SELECT m, p, v, sum(exp({lw})) OVER (PARTITION BY m, p ORDER BY v ROWS UNBOUNDED PRECEDING) AS f FROM (SELECT m, p, unnest(range(0, m + 1)) AS v FROM (SELECT DISTINCT m, p FROM {name}_in WHERE p > 0 AND p < 1))),
 {name} AS (SELECT i.* EXCLUDE (m, p, u), CASE WHEN any_value(i.p) >= 1 THEN any_value(i.m) ELSE count(c.f) END AS k{c} FROM {name}_in i LEFT JOIN {name}_cdf c ON c.m = i.m AND c.p = i.p AND c.f <= i.u GROUP BY ALL)"""


RESAMPLED = f"""WITH {HAP}, pc AS (SELECT a.population, count(*) AS n, CAST(sum(a.allele) AS BIGINT) AS x, CAST(sum(b.allele) AS BIGINT) AS y, CAST(sum(a.allele * b.allele) AS BIGINT) AS xy FROM hap a JOIN hap b USING (population, hap) WHERE a.variant = 0 AND b.variant = 9 GROUP BY 1),
 rr AS (SELECT pc.*, rep FROM pc, range(0, 2000) r(rep)),
 {drawn_sql("d0", "rr", "n", "xy", "n", 0)}, {drawn_sql("d1", "d0", "n - k0", "(x - xy)", "(n - xy)", 1)}, {drawn_sql("d2", "d1", "n - k0 - k1", "(y - xy)", "(n - x)", 2)},
 s AS (SELECT population, rep, n, k0 + k1 AS x, k0 + k2 AS y, k0 AS xy FROM d2),"""


@query("B2_haplotype_bootstrap", RESAMPLED + """
 r AS (SELECT population, CASE WHEN x > 0 AND x < n AND y > 0 AND y < n THEN least(1, power(xy / n - (x / n) * (y / n), 2) / ((x / n) * (1 - x / n) * (y / n) * (1 - y / n))) ELSE 0 END AS r2 FROM s)
 SELECT population, round(quantile_cont(r2, 0.025), 6) AS boot_lo, round(quantile_cont(r2, 0.975), 6) AS boot_hi FROM r GROUP BY 1""")
def haplotype_bootstrap(spark, d):
    h = haplotypes(spark, d)
    counts = L.pair_counts(h.where("variant = 0"), h.where("variant = 9"))
    r2 = L.linkage(B.resampled_pairs(counts, ["population"], 3, 2000), least=1)
    q = r2.groupBy("population").agg(F.percentile("r2", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select("population", F.round(F.col("q")[0], 6).alias("boot_lo"), F.round(F.col("q")[1], 6).alias("boot_hi"))


@query("B2_resampled_counts", RESAMPLED[:-1] + " SELECT population, CAST(rep AS BIGINT) AS rep, n, x, y, xy FROM s")
def resampled_counts(spark, d):
    """Every replicate's counts, as drawn."""
    h = haplotypes(spark, d)
    return B.resampled_pairs(L.pair_counts(h.where("variant = 0"), h.where("variant = 9")), ["population"], 3, 2000)


@query("TCRS_verdict_stable", f"WITH b AS ({ORACLE['B2_haplotype_bootstrap']}) SELECT population, boot_lo > 0.02 OR boot_hi < 0.02 AS stable FROM b")
def verdict_stable(spark, d):
    return haplotype_bootstrap(spark, d).select("population", ((F.col("boot_lo") > 0.02) | (F.col("boot_hi") < 0.02)).alias("stable"))


@query("G1_haplotype_vector", "SELECT user_id, CAST(user_id % 2 AS INTEGER) AS first_allele, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id % 3 AS INTEGER) END AS second_allele FROM events GROUP BY user_id")
def haplotype_vector(spark, d):
    second = F.when(F.col("user_id") % 3 == 0, F.lit(".")).otherwise((F.col("user_id") % 3).cast("string"))
    gt = F.concat((F.col("user_id") % 2).cast("string"), F.lit("|"), second)
    a = L.genotype_alleles(gt)
    return table(spark, d, "events").select("user_id").distinct().select("user_id", a[0].alias("first_allele"), a[1].alias("second_allele"))


@query("G2_nonref_haplotype", "SELECT user_id, CAST(user_id % 3 > 0 AS INTEGER) AS allele FROM events GROUP BY user_id")
def nonref_haplotype(spark, d):
    gt = F.concat((F.col("user_id") % 3).cast("string"), F.lit("/0"))
    return table(spark, d, "events").select("user_id").distinct().select("user_id", L.genotype_alleles(gt, collapse=True)[0].alias("allele"))
