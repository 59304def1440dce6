"""Ranked lexical search with integer scores: postings joined with the items' terms.

Postings are rows (row_id, doc_id, n, bucket, term, tf) with the term's bucket as first join key. They stay beside
their document's others: a layout by bucket alone would bring a word of a third of all documents into one task and
spread the sum of a document over all buckets. So matches are added up where they arise, and only one sum an item
and document is shuffled.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, materialize, pieces

#: Term bytes by the contract's character class: digits, letters, all bytes of other characters; A-Z become a-z, the rest ends a term.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BUCKETS = 256
#: Bytes of the items' terms (with 40 a row) up to which they are broadcast; beyond, the join shuffles by bucket, term and salt.
BROADCAST_BYTES = 64 << 20
SALTS = 32


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """row_id, key, n (terms of the row with repeats), bucket, term, tf; one row a term, and one with a null term for each row of the table that has terms.

    A null text has no terms. row_id numbers the rows of the table as read; write the result before using it twice.
    """
    schema = pa.schema([("row_id", pa.int64()), (key, pa.int64()), ("n", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for b in pieces(batches, 128):
            out = ([], [], [], [], [])
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                counts = Counter(terms_of(t.as_py()))
                if counts:
                    n, m = counts.total(), len(counts) + 1
                    for column, values in zip(out, ([row] * m, [k] * m, [n] * m, [None, *counts], [0, *counts.values()])):
                        column.extend(values)
                row += 1
            yield batch(schema, **dict(zip(schema.names, (*out[:3], pa.array(out[3], pa.binary()).cast(pa.string()), out[4]))))

    found = rows.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(run, f"row_id long, {key} long, n long, term string, tf long")
    return found.withColumn("bucket", bucket(F.col("term")))


def _small(terms: DataFrame) -> bool:
    size = terms.agg(F.sum(F.octet_length("term") + 40)).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of highest score above 0; equal scores by doc_id (null first).

    docs: doc_id, text; items: item_id, text. Every row of docs is a document of its own, also where doc_ids or texts
    repeat; rows of items that share an item_id (null too) are one item with the terms of all. Null and empty texts
    have no terms and are in no result; an empty table on either side gives no rows; extra columns are ignored.

    Two passes over the documents' terms: the first writes the postings of the items' terms, the second scores them.
    The number of documents and of terms are one row on the driver. The items' terms are broadcast if they are
    small; else both sides are joined by bucket, term and a salt of the document, so a common term fills no task.
    """
    of_item = materialize(postings(items, "item_id").where("term IS NOT NULL").groupBy("item_id", "bucket", "term").agg(F.sum("tf").alias("times")), "item-terms")
    small = _small(of_item)

    def with_terms(rows: DataFrame, terms: DataFrame, how: str) -> DataFrame:
        if small:
            return rows.join(F.broadcast(terms), ["bucket", "term"], how)
        salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(salted, ["_salt", "bucket", "term"], how).drop("_salt")

    # The row without a term counts the document; others are kept if an item has the term.
    wanted = of_item.select("bucket", "term").distinct().withColumn("_wanted", F.lit(True))
    found = with_terms(postings(docs, "doc_id"), wanted, "left").where("term IS NULL OR _wanted")
    kept = materialize(found.select("row_id", "doc_id", "n", "bucket", "term", "tf"), "postings")
    total = kept.where("term IS NULL").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    scored = kept.where("term IS NOT NULL")
    held = scored.groupBy("bucket", "term").agg(F.count("*").alias("_df"))
    weight = F.floor(1000 * F.ln(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("_df") + 1).cast("double")))
    weighed = of_item.join(held.select("bucket", "term", weight.alias("w")), ["bucket", "term"])
    m = f"(75 + (25 * n * {n_docs}L) div {n_terms}L)"
    points = F.expr(f"times * w * ((1000000000L * tf) div (1000L * tf + 12L * {m}))")
    sums = with_terms(scored, weighed, "inner").groupBy("item_id", "row_id", "doc_id").agg(F.sum(points).alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first(), "row_id")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
