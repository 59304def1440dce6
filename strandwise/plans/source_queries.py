"""Queries over sources and sinks: a table is written in a file format, read back and returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked_whole
from ..sources import blocks, files
from ..sources.landing import fresh
from .roles import HAP, MG, PK, REC, haplotypes, merged, peaks, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


@query("S5_S6_bed", f"""WITH {MG} SELECT 'chr1' AS chrom, start, "end" FROM mg WHERE start < 500000 AND "end" > 1000""")
def bed(spark, d):
    path = fresh(spark, "bed")
    files.write_bed(merged(spark, d).select(F.lit("chr1").alias("chrom"), "start", "end"), path)
    return files.read_bed(spark, path, "chr1", (1000, 500_000)).drop("accession")


@query("S8_K2_score_chunks", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS dnase_x FROM supplier")
def score_chunks(spark, d):
    path = fresh(spark, "chunks")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 == 0, float("nan")).otherwise(F.col("s_acctbal")).alias("dnase_x"))
    files.write_tsv(rows, path, rows_per_file=200)
    return files.read_score_chunks(spark, path, "s_suppkey long, s_name string, dnase_x double")


VCF = f"WITH {HAP}, v AS (SELECT CAST(variant * 1000 + 5 AS BIGINT) AS pos, variant, CAST(row_number() OVER (PARTITION BY variant ORDER BY hap) - 1 AS BIGINT) AS sample, CASE WHEN allele = 1 THEN '1|1' ELSE '0|0' END AS gt FROM hap)"
HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


def write_vcf(spark, d, path):
    """All haplotypes as indexed block-compressed VCF files: a variant a record, REF A, ALT C, or C,G for every fourth; a second record G to T at every eighth."""
    calls = haplotypes(spark, d).groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("hap", F.when(F.col("allele") == 1, "1|1").otherwise("0|0").alias("gt")))).alias("c"))
    alleles = F.when(F.col("variant") % 8 == 0, F.array(F.lit("A\tC,G"), F.lit("G\tT"))).when(F.col("variant") % 4 == 0, F.array(F.lit("A\tC,G"))).otherwise(F.array(F.lit("A\tC")))
    start = F.col("variant").cast("long") * 1000 + 4
    line = F.concat_ws("\t", F.lit("1"), (start + 1).cast("string"), F.lit("."), "a", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join("c.gt", "\t"))
    records = calls.withColumn("a", F.explode(alleles)).select(F.lit("1").alias("chrom"), start.alias("start"), (start + 1).alias("end"), line.alias("line"))
    blocks.write_lines(records, path, "vcf", HEADER, files=4)


@query("S9_S11_vcf", VCF + " SELECT pos, sample, gt FROM v WHERE variant BETWEEN 3 AND 9 AND variant % 4 > 0 UNION ALL SELECT pos, sample, gt FROM v WHERE variant BETWEEN 3 AND 9 AND variant % 8 = 0")
def vcf(spark, d):
    """The biallelic records of a region, all samples, read by the index and back long."""
    path = fresh(spark, "vcf")
    write_vcf(spark, d, path)
    return files.read_vcf(spark, path, "1", (3000, 9999), blocks=True).select("pos", F.col("sample").cast("long").alias("sample"), "gt")


@query("S10_point_lookup", VCF + " SELECT pos, 'A' AS ref, sample, gt FROM v WHERE variant = 16")
def point(spark, d):
    """The first record at a position that has two."""
    path = fresh(spark, "vcf")
    write_vcf(spark, d, path)
    return files.point_lookup(files.read_vcf(spark, path, "1", (16005, 16005), biallelic=False, blocks=True), 16005).select("pos", "ref", F.col("sample").cast("long").alias("sample"), "gt")


@query("S11_point_lookup_alleles", VCF + " SELECT pos, 'A' AS ref, sample, gt FROM v WHERE variant = 24 UNION ALL SELECT pos, 'G', sample, gt FROM v WHERE variant = 40")
def point_with_alleles(spark, d):
    """Records by position, REF and ALT: one whose ALT is the second of two, and one that is the second record of its position."""
    path = fresh(spark, "vcf")
    write_vcf(spark, d, path)
    at = lambda pos, ref, alt: files.point_lookup(files.read_vcf(spark, path, "1", (pos, pos), biallelic=False, blocks=True), pos, ref, alt)
    return at(24005, "A", "G").unionByName(at(40005, "G", "T")).select("pos", "ref", F.col("sample").cast("long").alias("sample"), "gt")


@query("S5_indexed_bed", f"""WITH {REC}, {PK} SELECT set_id AS chrom, start, "end" FROM pk WHERE set_id IN ('click', 'view') AND start < 900000 AND "end" > 880000""")
def indexed_bed(spark, d):
    """All measured intervals as BED, a set a chromosome; only the blocks of the locus are opened."""
    path = fresh(spark, "bed")
    rows = peaks(spark, d).select(F.col("set_id").alias("chrom"), "start", "end")
    blocks.write_lines(rows.withColumn("line", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))), path, "bed", files=4)
    found = blocks.read_lines(spark, path, "bed").where(F.col("chrom").isin("click", "view") & (F.col("start") < 900_000) & (F.col("end") > 880_000))
    return found.select("chrom", "start", "end")


@query("S7_ordered_first_hit", "SELECT o_custkey, arg_min(o_orderstatus || o_orderkey, struct_pack(a := o_orderpriority, b := o_orderkey)) AS path FROM orders GROUP BY 1")
def ordered_first(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("accession"), F.struct("o_orderpriority", "o_orderkey").alias("priority"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("path"))
    return files.first_in_order(rows).select(F.col("accession").alias("o_custkey"), "path")


@query("U6_K1_conserved_write", "SELECT count(*) AS expected, count(*) AS found, count(DISTINCT s_nationkey) AS nations FROM supplier")
def conserved_write(spark, d):
    """A left join that must keep every supplier, counted on both sides by the pass that writes it."""
    path = fresh(spark, "conserved")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    counts = files.write_conserved(table(spark, d, "supplier"), lambda s: s.join(nations, "s_nationkey", "left"), lambda out: files.write_tsv(out.select("s_suppkey", "s_nationkey", "n_name"), path))
    back = files.read_score_chunks(spark, path, "s_suppkey long, s_nationkey long, n_name string")
    return back.agg(F.countDistinct("s_nationkey").alias("nations")).select(F.lit(counts["expected"]).cast("long").alias("expected"), F.lit(counts["found"]).cast("long").alias("found"), "nations")


@query("K9_provenance", "SELECT 'half-open' AS intervals, 'by event_id' AS ties, count(*) AS expected, count(*) AS found FROM events")
def provenance(spark, d):
    """The document of a written ranking: the rules in force and the counts of the pass that wrote it."""
    path = fresh(spark, "ranking")
    rank = lambda rows: ranked_whole(rows, [], "value", "event_id")
    counts = files.write_conserved(table(spark, d, "events").select("event_id", "value"), rank, lambda out: files.write_tsv(out, path))
    files.write_summary(files.provenance(spark, {"intervals": "half-open", "ties": "by event_id"}, counts), f"{path}-provenance")
    return spark.read.schema("intervals string, ties string, counts struct<expected: long, found: long>").json(f"{path}-provenance").select("intervals", "ties", "counts.*")


@query("S12_panel", "SELECT 's' || c_custkey AS sample, c_mktsegment AS population FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def panel(spark, d):
    path = fresh(spark, "panel")
    rows = table(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit(" "), F.col("c_mktsegment"), F.lit("\tmale")).alias("value"))
    rows.write.text(path)
    return files.read_panel(spark, path, ["BUILDING", "MACHINERY"])


@query("S13_ld_pairs", "SELECT CAST(n_name AS VARCHAR) AS variation2, CAST(n_nationkey AS DOUBLE) / 25 AS r2, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS DOUBLE) / 4 END AS d_prime FROM nation")
def ld_pairs(spark, d):
    path = fresh(spark, "ld")
    pair = F.struct(F.col("n_name").alias("variation2"), (F.col("n_nationkey") / 25).cast("string").alias("r2"), F.when(F.col("n_regionkey") > 0, (F.col("n_regionkey") / 4).cast("string")).alias("d_prime"))
    table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(pair)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_ld_pairs(spark, path).drop("variant", "population")


@query("S14_annotations", "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey = 1 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS name, CAST(n_nationkey AS BIGINT) * 100 AS start, CAST(n_nationkey AS BIGINT) * 100 + 50 AS \"end\" FROM nation")
def annotations(spark, d):
    path = fresh(spark, "genes")
    at = F.col("n_nationkey").cast("long") * 100
    gene = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("external_name"), at.alias("start"), (at + 50).alias("end"))
    table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(gene)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_genes(spark, path)


@query("S3_read_through", "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1")
def read_through(spark, d):
    """The second reading finds what the first has landed."""
    path = fresh(spark, "landed")
    files.read_through(spark, path, lambda: table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations")))
    return files.read_through(spark, path, lambda: table(spark, d, "nation").limit(0).groupBy("n_regionkey").agg(F.count("*").alias("nations")))


@query("K1_tsv", "SELECT p_partkey, p_name, p_size FROM part")
def tsv(spark, d):
    path = fresh(spark, "tsv")
    files.write_tsv(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return files.read_score_chunks(spark, path, "p_partkey long, p_name string, p_size int")


@query("K3_csv", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS n_regionkey FROM nation")
def result_csv(spark, d) -> DataFrame:
    path = fresh(spark, "csv")
    files.write_csv(table(spark, d, "nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey"))), path)
    return spark.read.csv(path, header=True, schema="n_nationkey int, n_name string, n_regionkey int")


@query("K9_conserved", "SELECT count(*) AS expected, count(*) - 1 AS found FROM supplier")
def conserved(spark, d):
    rows = table(spark, d, "supplier")
    lost = rows.agg(F.max("s_suppkey").alias("m"))
    return files.conserved(rows, rows.join(F.broadcast(lost), rows.s_suppkey == lost.m, "left_anti"))
