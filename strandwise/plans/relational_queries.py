"""Queries over projection, filters, dedup, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import ranking as R
from ..operators.quantiles import quantiles
from ..sources.files import conserved
from .roles import REC, records, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


@query("P1_flatten_nested", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_nested(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query("P2_first_element", "SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS first_part, string_split(o_orderpriority, '-')[3] AS third_part FROM orders")
def first_element(spark, d):
    parts = F.split("o_orderpriority", "-")
    return table(spark, d, "orders").select("o_orderkey", F.get(parts, F.lit(0)).alias("first_part"), F.get(parts, F.lit(2)).alias("third_part"))


@query("P3_common_frequency", f"WITH {REC} SELECT event_id FROM rec WHERE coalesce(af, 0) >= 0.5")
def common_frequency(spark, d):
    return records(spark, d).where(P.is_common(F.col("af"), 0.5)).select("event_id")


@query("P4_single_character", "SELECT p_partkey FROM part WHERE length(substr(p_brand, 7)) = 1 AND length(p_type) = 5")
def single_character(spark, d):
    return table(spark, d, "part").where((F.length(F.expr("substring(p_brand, 7)")) == 1) & (F.length("p_type") == 5)).select("p_partkey")


@query("P5_between", f"WITH {REC} SELECT event_id, pos FROM rec WHERE pos BETWEEN 200000 AND 400000")
def between(spark, d):
    return records(spark, d).where(F.col("pos").between(200000, 400000)).select("event_id", "pos")


@query("P8_in_set", "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO')")
def in_set(spark, d):
    return table(spark, d, "part").where(F.col("p_type").isin("ECONOMY", "PROMO")).select("p_partkey")


@query("P9_not_in_set", "SELECT p_partkey FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')")
def not_in_set(spark, d):
    return table(spark, d, "part").where(~F.col("p_type").isin("ECONOMY", "PROMO")).select("p_partkey")


@query("P10_not_null", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def not_null(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").na.drop(subset=["quality"]).select("doc_id")


@query("P11_verdict_case", f"WITH {REC} SELECT CASE WHEN af >= 0.8 THEN 'strong' WHEN af >= 0.2 THEN 'partial' ELSE 'independent' END AS verdict, count(*) AS n FROM rec GROUP BY 1")
def verdict_case(spark, d):
    v = F.when(F.col("af") >= 0.8, "strong").when(F.col("af") >= 0.2, "partial").otherwise("independent")
    return records(spark, d).groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@query("P12_recode_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS label FROM orders")
def recode_map(spark, d):
    labels = F.create_map(F.lit("F"), F.lit("filled"), F.lit("O"), F.lit("open"))
    return table(spark, d, "orders").select("o_orderkey", F.try_element_at(labels, F.col("o_orderstatus")).alias("label"))


@query("P13_name_building", "SELECT p_partkey, 'dnase_' || replace(p_name, ' ', '_') AS column_name FROM part")
def name_building(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("dnase_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("column_name"))


@query("P14_columns_by_prefix", "UNPIVOT (SELECT s_suppkey, s_suppkey * 1.0 AS score_1, s_acctbal AS score_2 FROM supplier) ON score_1, score_2 INTO NAME ranking VALUE score")
def columns_by_prefix(spark, d):
    wide = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 1.0).cast("double").alias("score_1"), F.col("s_acctbal").alias("score_2"))
    return R.long_scores(wide, ["s_suppkey"])


DEDUP = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {source}) WHERE n = 1"


@query("P15_dedup_name_keep_first", DEDUP.format(cols="doc_id", keys="text", order="doc_id", source="documents"))
def dedup_name(spark, d):
    return R.first_by(table(spark, d, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@query("P16_dedup_allele", DEDUP.format(cols="l_orderkey, l_partkey, l_suppkey", keys="l_partkey, l_suppkey", order="l_orderkey, l_linenumber", source="lineitem"))
def dedup_allele(spark, d):
    return R.first_by(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]).drop("l_linenumber")


@query("P17_dedup_position_frequency", f"WITH {REC} " + DEDUP.format(cols="event_id", keys="pos, af", order="event_id", source="rec"))
def dedup_position(spark, d):
    return R.first_by(records(spark, d).select("event_id", "pos", "af"), ["pos", "af"], ["event_id"]).select("event_id")


@query("P18_dedup_id", DEDUP.format(cols="l_orderkey, l_linenumber", keys="l_orderkey", order="l_linenumber", source="lineitem"))
def dedup_id(spark, d):
    return R.first_by(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"])


@query("P19_duplicate_marks", "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS in_duplicate, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS later_duplicate FROM documents")
def duplicate_marks(spark, d):
    return R.mark_duplicates(table(spark, d, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).drop("text")


@query("P20_dedup_ledger", "SELECT l_orderkey, l_linenumber, removed_by_name, same_allele_key FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) > 1 AS named, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) > 1 AS removed_by_name, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) > 1 AS same_allele_key FROM lineitem) WHERE named")
def ledger(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return R.dedup_ledger(li, "l_partkey", ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "removed_by_name", "same_allele_key")


@query("P21_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def head(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("P22_allele_key", "SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'nan') || '_' || coalesce(CAST(quality AS VARCHAR), 'nan') AS allele_key FROM documents LEFT JOIN labels USING (doc_id)")
def allele_key(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", R.allele_key("doc_id", "quality").alias("allele_key"))


@query("J8_hash_probe_best", "SELECT o_custkey, max(l_extendedprice) AS best FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def hash_probe(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return o.join(li, "o_orderkey").groupBy("o_custkey").agg(F.max("l_extendedprice").alias("best"))


@query("J11_anti_top", "SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)")
def anti_top(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(head(spark, d).select("o_orderkey"), "o_orderkey", "left_anti")


@query("J12_panel_semi", "SELECT event_id FROM events WHERE user_id IN (SELECT vec_id FROM embeddings WHERE label < 7)")
def panel_semi(spark, d):
    panel = table(spark, d, "embeddings").where("label < 7").select(F.col("vec_id").alias("user_id"))
    return table(spark, d, "events").select("event_id", "user_id").join(panel, "user_id", "left_semi").select("event_id")


@query("J13_left_default", "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'kidney') AS term FROM documents LEFT JOIN labels USING (doc_id)")
def left_default(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("kidney")).alias("term"))


@query("J14_lookup_by_depth", "SELECT n, r_name FROM (VALUES (0), (1), (7)) v(n) LEFT JOIN region ON n = r_regionkey")
def lookup_by_depth(spark, d):
    return spark.createDataFrame([(0,), (1,), (7,)], "n int").join(table(spark, d, "region"), F.col("n") == F.col("r_regionkey"), "left").select("n", "r_name")


@query("J15_gather_repeated", "SELECT i % 25 AS n_nationkey, n_name, count(*) AS copies FROM range(0, 60) t(i) JOIN nation ON n_nationkey = i % 25 GROUP BY ALL")
def gather(spark, d):
    drawn = spark.range(60).select((F.col("id") % 25).alias("n_nationkey"))
    return drawn.join(table(spark, d, "nation"), "n_nationkey").groupBy("n_nationkey", "n_name").agg(F.count("*").alias("copies"))


@query("A1_conditional_counts", "SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS n_large, count(*) FILTER (l_discount = 0) AS n_full_price FROM lineitem GROUP BY 1")
def conditional_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("n_large"), F.count_if(F.col("l_discount") == 0).alias("n_full_price"))


@query("A2_population_frequency", f"WITH {REC} SELECT user_id, sum(CAST(floor(value) AS BIGINT)) FILTER (event_type = 'click') / nullif(sum(500) FILTER (event_type = 'click'), 0) AS af FROM rec GROUP BY 1")
def population_frequency(spark, d):
    blocks = records(spark, d).groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("id"), F.floor("value").alias("ac"), F.lit(500).alias("an"))).alias("pops"))
    mine = F.filter("pops", lambda p: p.id == "click")
    total = lambda f: F.aggregate(mine, F.lit(0).cast("long"), lambda t, p: t + p[f])
    return blocks.select("user_id", F.when(total("an") > 0, total("ac") / total("an")).alias("af"))


@query("A3_last_match", f"WITH {REC} SELECT user_id, arg_max(af, event_id) FILTER (event_type = 'click') AS af FROM rec GROUP BY 1")
def last_match(spark, d):
    rows = records(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "af"))).alias("p"))
    mine = F.filter("p", lambda x: x.event_type == "click")
    return rows.select("user_id", F.try_element_at(mine, F.lit(-1))["af"].alias("af"))


@query("A4_fallback", f"WITH {REC} SELECT user_id, coalesce(avg(af) FILTER (event_type = 'click'), avg(af) FILTER (event_type = 'view')) AS af FROM rec GROUP BY 1")
def fallback(spark, d):
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("af")))
    return records(spark, d).groupBy("user_id").agg(F.coalesce(of("click"), of("view")).alias("af"))


@query("A5_fraction", "SELECT l_returnflag, round(avg(CAST(l_quantity > 25 AS INTEGER)), 9) AS fraction FROM lineitem GROUP BY 1")
def fraction(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg((F.col("l_quantity") > 25).cast("int")), 9).alias("fraction"))


@query("A6_median", "SELECT l_returnflag, median(l_extendedprice) AS median_price FROM lineitem GROUP BY 1")
def median(spark, d):
    return quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"median_price": 0.5}).drop("n")


@query("A7_quantile", "SELECT round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem")
def quantile(spark, d):
    return quantiles(table(spark, d, "lineitem"), [], "l_extendedprice", {"p95": 0.95}).select(F.round("p95", 6).alias("p95"))


@query("A8_percentile_pair", "SELECT round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem")
def percentile_pair(spark, d):
    q = quantiles(table(spark, d, "lineitem"), [], "l_extendedprice", {"low": 0.025, "high": 0.975})
    return q.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("A9_extremes", "SELECT o_orderstatus, max(o_totalprice) AS largest, min(o_totalprice) AS smallest FROM orders GROUP BY 1")
def extremes(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("largest"), F.min("o_totalprice").alias("smallest"))


@query("A11_group_median", "SELECT p_type, median(p_retailprice) AS median_price FROM part GROUP BY 1")
def group_median(spark, d):
    return quantiles(table(spark, d, "part"), ["p_type"], "p_retailprice", {"median_price": 0.5}).drop("n")


@query("A12_group_size", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def group_size(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("A13_endpoint_range", "SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 6) AS width, bool_or(o_totalprice > 450000) AS any_large, greatest(max(o_custkey), max(o_orderkey)) AS top_key FROM orders GROUP BY 1")
def endpoint_range(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.max("o_totalprice") - F.min("o_totalprice"), 6).alias("width"), F.bool_or(F.col("o_totalprice") > 450000).alias("any_large"), F.greatest(F.max("o_custkey"), F.max("o_orderkey")).alias("top_key"))


@query("A14_nan_ignoring_mean", "SELECT l_suppkey, round(avg(CASE WHEN l_tax > 0 THEN l_discount / l_tax END), 9) AS mean FROM lineitem GROUP BY 1")
def nan_mean(spark, d):
    ratio = F.when(F.col("l_tax") > 0, F.col("l_discount") / F.col("l_tax")).otherwise(F.lit(float("nan")))
    rows = table(spark, d, "lineitem").select("l_suppkey", ratio.alias("r"))
    return rows.groupBy("l_suppkey").agg(F.round(F.avg(F.when(~F.isnan("r"), F.col("r"))), 9).alias("mean"))


@query("A15_distinct_count", "SELECT source, count(DISTINCT lang) AS n_langs, count(DISTINCT text) AS n_texts FROM documents GROUP BY 1")
def distinct_count(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("n_langs"), F.countDistinct("text").alias("n_texts"))


@query("A16_sorted_set_text", "SELECT source, string_agg(DISTINCT lang, ';' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def sorted_set_text(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ";").alias("langs"))


@query("A17_argmax_first_wins", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def argmax_first(spark, d):
    best = F.min(F.struct((-F.col("o_totalprice")).alias("v"), "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey")


@query("A22_bin_counts", "SELECT CAST(floor(c_acctbal / 1000) AS BIGINT) AS bin, count(*) AS n FROM customer GROUP BY 1")
def bin_counts(spark, d):
    return table(spark, d, "customer").groupBy(F.floor(F.col("c_acctbal") / 1000).alias("bin")).agg(F.count("*").alias("n"))


@query("A23_pivot", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("A26_strata_with_check", f"WITH {REC} SELECT pos BETWEEN 200000 AND 1400000 AS in_gene, event_type = 'purchase' AS coding, count(*) AS n, median(af) AS median_af FROM rec GROUP BY ALL")
def strata(spark, d):
    rows = records(spark, d).select(F.col("pos").between(200000, 1400000).alias("in_gene"), (F.col("event_type") == "purchase").alias("coding"), "af")
    sizes, middles = rows.groupBy("in_gene", "coding").agg(F.count("*").alias("n")), quantiles(rows, ["in_gene", "coding"], "af", {"median_af": 0.5}).drop("n")
    return sizes.join(middles, ["in_gene", "coding"])


@query("A27_collect_list", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) FILTER (n_nationkey > 3) AS names FROM nation GROUP BY 1")
def collect(spark, d):
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") > 3, F.struct("n_nationkey", "n_name")))).alias("x"))
    return rows.select("n_regionkey", F.when(F.size("x") > 0, F.array_join(F.col("x.n_name"), "|")).alias("names"))


@query("W7_position_in_group", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS idx FROM lineitem")
def position_in_group(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("idx"))


@query("O1_sorted", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name")
def sorted_rows(spark, d):
    return table(spark, d, "nation").select("n_name", "n_regionkey").orderBy(F.desc("n_regionkey"), "n_name")


@query("O4_display_order", "SELECT p_type, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) ORDER BY p_type <> 'PROMO', n DESC")
def display_order(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.col("p_type") != "PROMO", F.desc("n"))


@query("U1_union_all", "SELECT c_nationkey AS nationkey, 'customer' AS kind, NULL AS s_suppkey FROM customer UNION ALL SELECT s_nationkey, 'supplier', s_suppkey FROM supplier")
def union_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("kind"), "s_suppkey")
    return c.unionByName(s, allowMissingColumns=True)


@query("U2_intersection", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("U3_difference", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def difference(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("U4_union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("U5_distinct_configurations", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_configurations(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("U6_conservation", "SELECT expected, found FROM (SELECT (SELECT count(*) FROM lineitem) AS expected, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F') AS found) WHERE expected <> found")
def conservation(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey")
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return conserved(li, li.join(o, "l_orderkey"))


@query("F_string_predicates", "SELECT p_partkey, regexp_matches(p_name, 'bolt|ring', 'i') AS named, starts_with(p_brand, 'Brand#1') AS brand_one, string_split(p_brand, '#')[-1] AS brand_no, lower(p_type) AS kind FROM part")
def string_predicates(spark, d):
    return table(spark, d, "part").select("p_partkey", P.matches_any(F.col("p_name"), "bolt|ring").alias("named"), F.startswith("p_brand", F.lit("Brand#1")).alias("brand_one"), F.element_at(F.split("p_brand", "#"), -1).alias("brand_no"), F.lower("p_type").alias("kind"))


@query("F_math_and_null", "SELECT l_orderkey, l_linenumber, round(log10(l_extendedprice + 1e-9), 9) AS lg, round(ln(greatest(l_quantity, 1)), 9) AS l, least(greatest(l_discount, 0.02), 0.08) AS clipped, CAST(floor(l_quantity / 7) AS BIGINT) AS sevens, coalesce(nullif(l_tax, 0), -1) AS tax FROM lineitem")
def math_and_null(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.log10(F.col("l_extendedprice") + 1e-9), 9).alias("lg"), F.round(F.ln(F.greatest("l_quantity", F.lit(1.0))), 9).alias("l"),
        F.least(F.greatest("l_discount", F.lit(0.02)), F.lit(0.08)).alias("clipped"), F.floor(F.col("l_quantity") / 7).alias("sevens"), F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.lit(-1.0)).alias("tax"),
    )


@query("K4_nested_summary", "SELECT l_returnflag, CAST(to_json(struct_pack(n := count(*), suppliers := count(DISTINCT l_suppkey))) AS VARCHAR) AS summary FROM lineitem GROUP BY 1")
def nested_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.to_json(F.struct(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))).alias("summary"))
