"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word bytes are everything but these; bytes.split() splits on exactly this set.
WHITESPACE = b" \t\n\v\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, as the cluster names it.

    Only in a local session without spark.checkpoint.dir (tests) a temporary folder is made and
    remembered in the session; on a cluster that setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("strandwise.scratch.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-strandwise-")
        spark.conf.set("strandwise.scratch.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors and keeps a step from being computed twice.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words (runs of non-white-space) in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def pieces(batches, rows: int = 1024):
    """Arrow batches cut into slices of a bounded number of rows, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def local_forest(batches):
    """Edges (a, b) of one partition, as stars about the smallest node of each of its components.

    Works through bounded pieces: what a piece connects is sent on before the next piece is read.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def find(parent, x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for piece in batches:
        parent: dict[int, int] = {}
        for a, b in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
        stars = [(x, find(parent, x)) for x in parent]
        stars = [(x, r) for x, r in stars if x != r]
        if stars:
            yield batch(schema, a=[x for x, _ in stars], b=[r for _, r in stars])


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as edges (a, b) of longs: rows (node, root).

    Each partition first shrinks its own edges to stars; then come alternating large-star and small-star rounds (Kiveris et al., 2014). A round is two joins on pre-aggregated minima, written to the shared folder; root is the smallest node. Nothing
    but one checksum row per round reaches the driver. No edges: no rows. Self loops and
    repeated edges are ignored.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialize(links.mapInArrow(local_forest, "a long, b long").distinct(), "edges")
    before = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        e = materialize(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).distinct(),
            "edges",
        )
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        before = now


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if a written table of narrow rows holds at most max_rows; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
