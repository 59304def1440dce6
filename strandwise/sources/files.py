"""Readers and writers for the reference's file kinds, each with an explicit schema and no inference."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import overlaps
from .blocks import read_lines

POPULATION = "array<struct<id: string, ac: long, an: long>>"
BLOCK = f"struct<ac: long, an: long, populations: {POPULATION}>"
REGION_SCHEMA = (
    "data struct<region: struct<variants: array<struct<variant_id: string, rsids: array<string>, pos: long, ref: string, alt: string, consequence: string, "
    f"transcript_consequence: struct<gene_symbol: string, major_consequence: string>, genome: {BLOCK}, exome: {BLOCK}>>>>"
)


def read_region(spark: SparkSession, path: str) -> DataFrame:
    """A landed region response, one row per variant."""
    return spark.read.schema(REGION_SCHEMA).json(path, multiLine=True).select(F.explode("data.region.variants").alias("v")).select("v.*")


def frequency(block: str, population: str | None = None) -> Column:
    """ALT frequency of a block, or of one population in it (exact, case-folded id); null where AN is 0 or nothing matches."""
    if population is None:
        return F.try_divide(F.col(f"{block}.ac"), F.col(f"{block}.an"))
    mine = F.filter(F.col(f"{block}.populations"), lambda p: F.lower(p["id"]) == population)
    total = lambda f: F.aggregate(mine, F.lit(0).cast("long"), lambda t, p: t + F.coalesce(p[f], F.lit(0)))
    return F.when(total("an") > 0, total("ac") / total("an"))


def flatten_region(variants: DataFrame, population: str, gene: tuple[int, int], labels: dict[str, str]) -> DataFrame:
    """The variant table: first rsid or null, genome-then-exome frequencies, inside-gene flag, and a label by rsid."""
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.lit(None).cast("map<string,string>")
    rsid = F.get("rsids", F.lit(0))
    return variants.select(
        "variant_id",
        rsid.alias("rsid"),
        "pos",
        "ref",
        "alt",
        F.coalesce("consequence", "transcript_consequence.major_consequence").alias("consequence"),
        F.col("transcript_consequence.gene_symbol").alias("gene"),
        F.coalesce(frequency("genome"), frequency("exome")).alias("af_global"),
        F.coalesce(frequency("genome", population), frequency("exome", population)).alias("af_population"),
        F.col("pos").between(*gene).alias("in_gene"),
        F.try_element_at(label, rsid).alias("risk_label"),
    )


def read_bed(spark: SparkSession, paths: str | list[str], chrom: str | None = None, locus: tuple[int, int] | None = None, inclusive: bool = False, blocks: bool = False) -> DataFrame:
    """(accession, chrom, start, end) of BED files, other columns unread, filtered to a chromosome and an overlapped locus.

    blocks: for block-compressed files, of which only the blocks that a tabix index names for the locus are opened;
    accession is then null, and paths is one file or folder.
    """
    if blocks:
        rows = read_lines(spark, paths, "bed").withColumn("accession", F.lit(None).cast("string"))
    else:
        rows = spark.read.csv(paths, sep="\t", schema="chrom string, start long, end long", comment="#")
        rows = rows.withColumn("accession", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    if chrom is not None:
        rows = rows.where(F.col("chrom") == chrom)
    if locus is not None:
        rows = rows.where(overlaps(F.col("start"), F.col("end"), *locus, inclusive=inclusive))
    return rows.select("accession", "chrom", "start", "end")


def first_in_order(manifest: DataFrame) -> DataFrame:
    """Of (accession, priority, path), each accession's path of smallest priority."""
    return manifest.groupBy("accession").agg(F.min_by("path", "priority").alias("path"))


def read_score_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All chunk files of a score table, NaN scores as null."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="")
    floats = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")]
    return rows.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in floats else F.col(c) for c in rows.columns])


def read_panel(spark: SparkSession, path: str, populations: list[str]) -> DataFrame:
    """(sample, population) of a white-space panel with a header line, for the named populations."""
    words = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("NOT startswith(value, 'sample')").select(words[0].alias("sample"), words[1].alias("population")).where(F.col("population").isin(populations))


def read_vcf(spark: SparkSession, path: str, chrom: str | None = None, between: tuple[int, int] | None = None, biallelic: bool = True, blocks: bool = False) -> DataFrame:
    """(chrom, pos, ref, alts, sample, gt) of a VCF's records, long by sample; samples by column number from 0.

    blocks: for block-compressed files; of an indexed one, only the blocks that hold the region are opened.
    """
    fields = F.split("line", "\t")
    if blocks:
        rows = read_lines(spark, path, "vcf").select("chrom", "pos", "line")
    else:
        rows = spark.read.text(path).where("NOT startswith(value, '#')").withColumnRenamed("value", "line").select(fields[0].alias("chrom"), fields[1].cast("long").alias("pos"), "line")
    if chrom is not None:
        rows = rows.where(F.col("chrom") == chrom)
    if between is not None:
        rows = rows.where(F.col("pos").between(*between))
    rows = rows.select("chrom", "pos", fields[3].alias("ref"), F.split(fields[4], ",").alias("alts"), fields.alias("f"))
    if biallelic:
        rows = rows.where(F.size("alts") == 1)
    return rows.select("chrom", "pos", "ref", "alts", F.posexplode(F.expr("slice(f, 10, size(f) - 9)")).alias("sample", "call")).withColumn("gt", F.split("call", ":")[0]).drop("call")


def point_lookup(vcf: DataFrame, pos: int, ref: str | None = None, alt: str | None = None) -> DataFrame:
    """The calls of the first record at a position, or of the one with the alleles (which may be one of several ALTs)."""
    rows = vcf.where(F.col("pos") == pos)
    if ref is not None:
        return rows.where((F.col("ref") == ref) & F.array_contains("alts", alt))
    first = rows.agg(F.min(F.struct("ref", "alts")).alias("r"))
    return rows.join(F.broadcast(first), F.struct("ref", "alts") == F.col("r")).drop("r")


def read_ld_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(variant, population, variation2, r2, d_prime) of landed pair files variant__population.json, arrays of objects; an empty array gives no rows. Figures are text in the files."""
    rows = spark.read.schema("variation2 string, r2 string, d_prime string").json(path, multiLine=True)
    name = F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.json(\.gz)?$", ""), "__")
    return rows.where("variation2 IS NOT NULL").select(F.get(name, F.lit(0)).alias("variant"), F.get(name, F.lit(1)).alias("population"), "variation2", F.expr("try_cast(r2 AS double)").alias("r2"), F.expr("try_cast(d_prime AS double)").alias("d_prime"))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, start, end) of landed gene arrays; a gene without a name goes by its id."""
    rows = spark.read.schema("id string, external_name string, start long, end long").json(path, multiLine=True)
    return rows.where("start IS NOT NULL").select("id", F.coalesce("external_name", "id").alias("name"), "start", "end")


def read_regulatory(spark: SparkSession, path: str) -> DataFrame:
    """(feature) of landed regulatory arrays: the description, or else the type."""
    rows = spark.read.schema("description string, feature_type string").json(path, multiLine=True)
    return rows.select(F.coalesce("description", "feature_type").alias("feature")).where("feature IS NOT NULL")


def read_through(spark: SparkSession, path: str, build) -> DataFrame:
    """The table landed at path; where there is none, build() is written there first, once. What is landed is never built again."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def write_bed(df: DataFrame, path: str) -> None:
    """Tab-separated chrom, start, end without a header; refuses to overwrite."""
    df.select("chrom", "start", "end").write.option("sep", "\t").mode("errorifexists").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header and empty fields for nulls; refuses to overwrite."""
    df.write.option("header", True).mode("errorifexists").csv(path)


def write_tsv(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Gzipped TSV with a header; refuses to overwrite. rows_per_file rotates chunks."""
    out = df.write.option("sep", "\t").option("header", True).option("compression", "gzip")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    out.mode("errorifexists").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A nested JSON document per row."""
    df.write.mode("errorifexists").json(path)


def provenance(spark: SparkSession, rules: dict[str, str], counts: dict[str, int] | None = None) -> DataFrame:
    """A one-row document of the rules in force and of the counts measured while the result was written."""
    found = [F.struct(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()]).alias("counts")] if counts else []
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in rules.items()], *found)


def conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row if the row counts differ, none if they agree."""
    a, b = before.agg(F.count("*").alias("expected")), after.agg(F.count("*").alias("found"))
    return a.crossJoin(b).where("expected <> found")


class RowsLost(ValueError):
    """A step that should keep every row has written another number than it read."""


def write_conserved(df: DataFrame, step, write, allowed_loss: int = 0) -> dict[str, int]:
    """write(step(df)), with the rows before and after the step counted in that same pass; {"expected", "found"}.

    step: a function of a DataFrame that should keep rows. RowsLost is raised if it has lost more than allowed_loss or
    made any. Counts are of whole tables, also where the step shuffles; a step that may skip its input (a limit) has no
    defined count before.
    """
    before, after = Observation(), Observation()
    write(step(df.observe(before, F.count(F.lit(1)).alias("n"))).observe(after, F.count(F.lit(1)).alias("n")))
    counts = {"expected": before.get["n"], "found": after.get["n"]}
    if not 0 <= counts["expected"] - counts["found"] <= allowed_loss:
        raise RowsLost(f"{counts['expected']} rows before, {counts['found']} after")
    return counts
