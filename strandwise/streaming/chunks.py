"""Incremental intake of score chunks: the reference's append-only chunk folder as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_score_chunks(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New chunk files as they land, NaN scores as null."""
    rows = spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)
    floats = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")]
    return rows.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in floats else F.col(c) for c in rows.columns])


def first_arrivals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each allele key once, across batches; the key set is the query's state."""
    return rows.dropDuplicates(keys)
