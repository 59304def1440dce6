"""The driver's tables in the roles of the library's inputs, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import merge, with_elem_id
from ..operators.resample import hash_number

RANKINGS = 7
#: The locus that coverage and overlap queries look at, in seconds since 2024-01-01.
LOCUS = (200_000, 1_400_000)
BIN = 4096


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Allele records: events with a position (whole seconds since 2024-01-01) and a frequency."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("long").alias("pos"), (F.col("value") / 500).alias("af"))


def scores_wide(spark: SparkSession, d: str) -> DataFrame:
    cols = [(hash_number(F.lit(str(k)), F.col("event_id").cast("string")).cast("double") / 2147483648.0 - 1).alias(f"score_{k}") for k in range(1, RANKINGS + 1)]
    return records(spark, d).select("event_id", "event_type", "pos", "af", *cols)


def scores(spark: SparkSession, d: str) -> DataFrame:
    wide = scores_wide(spark, d)
    return wide.unpivot(["event_id", "event_type", "pos", "af"], [f"score_{k}" for k in range(1, RANKINGS + 1)], "ranking", "score")


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """Measured intervals: one per event, its type as the set, user_id mod 8 as the file."""
    return records(spark, d).select(F.col("event_type").alias("set_id"), (F.col("user_id") % 8).alias("accession"), F.col("pos").alias("start"), (F.col("pos") + 60 + 2 * F.col("user_id")).alias("end"))


def merged(spark: SparkSession, d: str, set_id: str = "purchase") -> DataFrame:
    return merge(peaks(spark, d).where(F.col("set_id") == set_id), ["set_id"], bin_width=1 << 16)


def elements(spark: SparkSession, d: str, set_id: str = "purchase") -> DataFrame:
    return with_elem_id(merged(spark, d, set_id), ["set_id"])


def haplotypes(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as haplotypes: a dimension is a variant, the sign bit its allele, the label the population."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("int").alias("population"), F.col("vec_id").alias("hap"), F.posexplode("embedding").alias("variant", "x")).select("population", "hap", "variant", (F.col("x") < 0).cast("int").alias("allele"))


REC = "rec AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts) - 1704067200) AS BIGINT) AS pos, value / 500 AS af FROM events)"
SC = REC + f""", sc AS (SELECT event_id, event_type, pos, af, 'score_' || k AS ranking,
  CAST(CAST('0x' || substr(md5(k || '|' || event_id), 1, 8) AS BIGINT) AS DOUBLE) / 2147483648.0 - 1 AS score FROM rec, range(1, {RANKINGS + 1}) t(k))"""
PK = """pk AS (SELECT event_type AS set_id, user_id % 8 AS accession, pos AS start, pos + 60 + 2 * user_id AS "end" FROM rec)"""


def merged_sql(name: str, source: str, keys: str = "set_id") -> str:
    return f"""{name} AS (SELECT {keys}, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(f) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM {source}))
  GROUP BY {keys}, g)"""


MG = REC + ", " + PK + ", " + merged_sql("mg", "(SELECT * FROM pk WHERE set_id = 'purchase')")
EL = MG + """, el AS (SELECT *, row_number() OVER (ORDER BY start, "end") - 1 AS elem_id FROM mg)"""
HIT = """(SELECT event_id, EXISTS (SELECT 1 FROM mg WHERE rec.pos >= mg.start AND rec.pos < mg."end") AS in_peak FROM rec)"""
HAP = "hap AS (SELECT CAST(label AS INTEGER) AS population, vec_id AS hap, CAST(i AS INTEGER) AS variant, CAST(embedding[i + 1] < 0 AS INTEGER) AS allele FROM embeddings, range(0, 64) t(i))"
MISSING = "(vec_id * 31 + {i} * 17) % 211 = 0"
HAPM = f"hap AS (SELECT CAST(label AS INTEGER) AS population, vec_id AS hap, CAST(i AS INTEGER) AS variant, CASE WHEN {MISSING.format(i='i')} THEN NULL ELSE CAST(embedding[i + 1] < 0 AS INTEGER) END AS allele FROM embeddings, range(0, 64) t(i))"


def haplotypes_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """haplotypes with about one allele of 211 missing."""
    gap = F.expr(MISSING.format(i="variant").replace("vec_id", "hap"))
    return haplotypes(spark, d).withColumn("allele", F.when(~gap, F.col("allele")))
