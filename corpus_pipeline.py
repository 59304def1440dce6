"""The corpus pipeline: documents to a sharded training mixture, in five written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import materialize
from strandwise.llm.decontam import decontaminate
from strandwise.llm.mixing import mix, shuffled_shards
from strandwise.llm.neardup import drop_near_duplicates
from strandwise.llm.quality import keep_good
from strandwise.llm.sharding import kd_shards, with_slots

SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first quality rules, with the texts that the line rules leave.

    Null and empty texts go; repeated rows are judged alike; no rows give no rows; extra columns stay.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8), that of the smallest doc_id.

    SimHash with the operator's segment counts, grid cells one step apart and Hamming check finds all pairs within its radius, cells of
    further fingerprint bits those farther apart; the exact similarity of both is checked.
    Texts without words are copies of one another; rows without doc_id stay; of rows that share one, one stays. No rows give no rows; extra columns stay.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts and items match nothing; of rows that share a doc_id, all go if one does, null ids included. No rows give no rows; extra columns stay.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, written in its own order: shard by shard of the mix, rows in hash order. A document drawn twice is two rows.

    A null source is one of its own; rows that share a doc_id are drawn together; rows without words may be drawn and take nothing. No rows give no rows; extra columns stay.
    """
    rows = mix(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")).select("_row", "mix_shard", "mix_order")
    return shuffled_shards(rows).select("_row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture with its shard and the row's place in it, shard by shard.

    Null columns have places of their own in the tree; repeated rows share a shard and have slots of their own. Columns of docs called shard or slot give way, all others stay. No rows give no rows.
    """
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang", "source")
    placed = kd_shards(rows, SHARDS).select("_row", "doc_id", F.xxhash64("text").alias("text_hash"), "shard")
    slots = with_slots(placed, ["doc_id", "text_hash"])
    return slots.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL expresses neither the fingerprints nor the tree; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
