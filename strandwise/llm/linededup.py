"""Line dedup by a deletion-neighbourhood join, with words as the unit of edits.

Every line emits what is left of it after deleting one word, as hashed keys. Two lines within one edit
share such a key: a substitution leaves the same rest with the same word position missing, an insertion
leaves the shorter line itself. Keys are joined by aggregation (the earliest line of each key), so a
key shared by many lines costs one row a line and never their pairs. A rest without position only meets
the line that it is: two lines that both leave it may be two edits apart. So whatever meets is a neighbour;
the earliest found for a line is verified by edit distance on the words, and the line goes if it holds.

Before that, a filter that loses nothing keeps lines that cannot match from emitting their keys: one
edit leaves the first or the last half of the longer line untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, broadcast_if_small, materialize, pieces

#: Default of min_words; lines with fewer words are matched exactly only: one edit of a very short line is another line.
MIN_WORDS = 5


def line_id(joined: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(joined)
    return signed(h >> 64), signed(h & (1 << 64) - 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def halves(words: list[bytes]) -> list[int]:
    """Keys of the halves that one edit can leave untouched, for a longer line of n or n + 1 words."""
    out = []
    for q in {(len(words) - 1) // 2, len(words) // 2}:
        out.append(signed(xxhash.xxh3_64_intdigest(b"%d<" % q + b" ".join(words[:q]))))
        out.append(signed(xxhash.xxh3_64_intdigest(b"%d>" % q + b" ".join(words[len(words) - q :]))))
    return out


OWN, PLACE, REST = 0, 1, 2


def variants(words: list[bytes]) -> tuple[list[int], list[int]]:
    """Keys of a line and what each stands for: the line itself, or the rest after a deletion with or without the position."""
    keys, kinds = [signed(xxhash.xxh3_64_intdigest(b"=" + b" ".join(words)))], [OWN]
    for i in range(len(words)):
        rest = b" ".join(words[:i] + words[i + 1 :])
        keys.append(signed(xxhash.xxh3_64_intdigest(b"%d?" % i + rest)))
        kinds.append(PLACE)
        if i == 0 or words[i] != words[i - 1]:
            keys.append(signed(xxhash.xxh3_64_intdigest(b"=" + rest)))
            kinds.append(REST)
    return keys, kinds


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the word edit distance is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = next((i for i, w in enumerate(short) if w != long[i]), len(short))
    return short[i:] == long[i + 1 :] if len(short) < len(long) else short[i + 1 :] == long[i + 1 :]


#: Where a line stands. row is null but for rows whose doc_id has several texts: there it tells them apart.
PLACE_FIELDS = ("doc_id", "row", "line_no")


def place(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in PLACE_FIELDS])


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text) of docs; row is the hash of the text where a doc_id (null too) has several texts, else null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = docs.select("doc_id", text_hash().alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    several = materialize(several.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_several")), "repeated-ids")
    if not several.limit(1).count():
        return docs.select("doc_id", F.lit(None).cast("long").alias("row"), "text")
    marked = docs.join(broadcast_if_small(several, 500_000), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return marked.select("doc_id", F.when(F.col("_several"), text_hash()).alias("row"), "text")


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, line_no, h1, h2, halves): a row for each line that has a word; white space is not compared. docs: as told_apart gives them."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line_no", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("halves", pa.list_(pa.int64()))])

    def run(batches):
        for b in pieces(batches):
            out = {n: [] for n in schema.names}
            for doc_id, row, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for no, line in enumerate((text or "").encode().split(b"\n")):
                    if words := line.split():
                        h1, h2 = line_id(b" ".join(words))
                        for n, v in zip(schema.names, (doc_id, row, no, h1, h2, halves(words) if len(words) >= min_words else [])):
                            out[n].append(v)
                if len(out["doc_id"]) > 20_000:
                    yield batch(schema, **out)
                    out = {n: [] for n in schema.names}
            yield batch(schema, **out)

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, line_no long, h1 long, h2 long, halves array<long>")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, line_no, near): the lines that go. near: an earlier line is one edit away; else an exact repeat. docs: as told_apart gives them.

    Lines are ordered by doc_id (null first), then, where an id has several texts, by the text's hash, then by
    line number. A line's first occurrence stays unless an earlier line is within one word edit; its later
    occurrences always go. Rows of the same id and text are one document and lose the same lines. Lines without a word
    are never removed. Lines of fewer than min_words words (2 at least: all lines of one word are one edit apart)
    are compared exactly only.
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    occ = materialize(occurrences(docs, min_words), "lines")
    lines = materialize(occ.groupBy("h1", "h2").agg(F.min(place()).alias("first"), F.first("halves").alias("halves")), "distinct-lines")
    keys = lines.select("h1", "h2", "first", F.explode("halves").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    chosen = keys.join(shared, "key", "left_semi").groupBy("h1", "h2").agg(F.first("first").alias("first"))
    wanted = chosen.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.row").alias("_row")).agg(F.collect_set(F.struct("first.line_no", "h1")).alias("_lines"))
    held = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("row").eqNullSafe(F.col("_row")))
    texts = materialize(line_texts(held.select("doc_id", "row", "text", "_lines")), "line-texts")
    rows = emitted(texts)
    own = F.col("kind") == OWN
    per = rows.groupBy("key").agg(F.min(F.when(own, F.col("first"))).alias("own_first"), F.min(F.when(~own, F.col("first"))).alias("rest_first"), F.count("*").alias("n"))
    met = rows.join(per.where("n > 1"), "key").withColumn("near", F.when(F.col("kind") == REST, F.col("own_first")).otherwise(F.col("rest_first")))
    near = met.where("near < first").groupBy("first").agg(F.min("near").alias("near"))
    first = texts.select(place().alias("first"), "line")
    pairs = near.join(first, "first").join(first.select(F.col("first").alias("near"), F.col("line").alias("near_line")), "near")
    gone = materialize(verified(pairs), "near-lines")
    last = lines.select("h1", "h2", "first").join(gone.select(place().alias("first"), F.lit(True).alias("gone")), "first", "left")
    out = occ.select(*PLACE_FIELDS, "h1", "h2").join(last, ["h1", "h2"])
    return out.where((place() > F.col("first")) | F.col("gone")).select(*PLACE_FIELDS, F.coalesce("gone", F.lit(False)).alias("near"))


def line_texts(held: DataFrame) -> DataFrame:
    schema = pa.schema([*((n, pa.int64()) for n in PLACE_FIELDS), ("line", pa.binary())])

    def run(batches):
        for b in pieces(batches):
            out = {n: [] for n in schema.names}
            for doc_id, row, text, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
                parts = [b" ".join(x.split()) for x in (text or "").encode().split(b"\n")]
                for no in (x["line_no"] for x in wanted):
                    for n, v in zip(schema.names, (doc_id, row, no, parts[no])):
                        out[n].append(v)
            yield batch(schema, **out)

    return held.mapInArrow(run, "doc_id long, row long, line_no long, line binary")


def emitted(texts: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), *((n, pa.int64()) for n in PLACE_FIELDS)])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                piece = b.slice(at, 512)
                keys, kinds, sizes = [], [], []
                for line in piece.column(3).to_pylist():
                    k, o = variants(line.split(b" "))
                    keys += k
                    kinds += o
                    sizes.append(len(k))
                take = pa.array(np.repeat(np.arange(piece.num_rows), sizes))
                yield batch(schema, key=keys, kind=kinds, **{n: piece.column(i).take(take) for i, n in enumerate(PLACE_FIELDS)})

    return texts.mapInArrow(run, "key long, kind int, doc_id long, row long, line_no long").select("key", "kind", place().alias("first"))


def verified(pairs: DataFrame) -> DataFrame:
    schema = pa.schema([(n, pa.int64()) for n in PLACE_FIELDS])

    def run(batches):
        for b in batches:
            keep = [within_one(x.split(b" "), y.split(b" ")) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:3], schema=schema).filter(pa.array(keep, pa.bool_()))

    return pairs.select(*[f"first.{n}" for n in PLACE_FIELDS], "line", "near_line").mapInArrow(run, "doc_id long, row long, line_no long")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (with a word), n_exact, n_near, removed (line numbers from 0, ascending), text_hash.

    One row per document row; null or empty texts have no lines. Rows that share a doc_id but not the text are
    documents of their own, told apart by text_hash. An empty table gives no rows; extra columns are ignored.
    """
    rows = told_apart(docs)
    gone = removed_lines(rows, min_words).distinct().groupBy("doc_id", "row").agg(F.sum((~F.col("near")).cast("long")).alias("n_exact"), F.sum(F.col("near").cast("long")).alias("n_near"), F.array_sort(F.collect_list("line_no")).alias("removed"))
    gone = gone.withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    with_word = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    base = rows.select("doc_id", "row", F.size(with_word).cast("long").alias("n_lines"), text_hash().alias("text_hash"))
    out = base.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("row").eqNullSafe(F.col("_row")), "left")
    none = F.expr("cast(array() AS array<bigint>)")
    return out.select("doc_id", "n_lines", F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("removed", none).alias("removed"), "text_hash")


def drop_lines(docs: DataFrame, deduped: DataFrame) -> DataFrame:
    """docs with the removed lines cut out of their texts (deduped: line_dedup's result); other columns as they are."""
    marks = deduped.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.first("removed").alias("_gone"))
    cut = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains(_gone, cast(i AS bigint))), '\\n')")
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_hash")), "left")
    return joined.select(*[F.when(F.size("_gone") > 0, cut).otherwise(F.col("text")).alias("text") if c == "text" else docs[c] for c in docs.columns])
