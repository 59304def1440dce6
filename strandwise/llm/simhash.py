"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A 64-bit fingerprint is cut into 16 segments of 4 bits and mapped to its 16 bit counts. Flipping one
bit moves one count by one, so the Manhattan distance of two count vectors never exceeds the Hamming
distance of the fingerprints. The grid cell of a fingerprint is its count vector; a fingerprint is
dealt to its own cell and to the cells one step away, so that any two vectors within Manhattan
distance 2 meet in a cell. Pairs that meet are verified by Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, broadcast_if_small, connected_components, materialize, pieces

SEED = 42
SEGMENTS = 16
RADIUS = 2
#: Fingerprints in one grid cell up to which all their pairs are compared; fuller cells take the star path.
CELL_CAP = 64
#: Odd multipliers that derive further 64-bit lanes from a shingle's hash (lane 0 is the hash itself).
LANES = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
CHUNK = 8192


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of the A-Z lower-cased text, repeats included.

    Fewer words than size: one shingle of them all; no word (or null): none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1]
    hash64 = xxhash.xxh64_intdigest
    return np.fromiter((hash64(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Majority bits of the hashes, one 64-bit word per lane; zero where there is no hash."""
    if not len(hashes):
        return np.zeros(lanes, np.uint64)
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK]
        if lanes > 1:
            mixed = np.stack([h] + [(h ^ (h >> np.uint64(31))) * np.uint64(LANES[i]) for i in range(1, lanes)], axis=1)
            mixed[:, 1:] ^= mixed[:, 1:] >> np.uint64(29)
        else:
            mixed = h[:, None]
        bits = np.unpackbits(np.ascontiguousarray(mixed).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one narrow pass over the whole texts; fp is the fingerprint's signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in pieces(batches):
            fp = [fingerprint(shingle_hashes(t, size))[0] for t in b.column(1).to_pylist()]
            yield batch(schema, doc_id=b.column(0), fp=np.array(fp, np.uint64).view(np.int64))

    return docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, fp long")


def cell(fp: Column) -> Column:
    """The 16 bit counts of a fingerprint, packed three bits each."""
    counts = [F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, 4 * i).bitwiseAND(F.lit(15))).cast("long"), 3 * i) for i in range(SEGMENTS)]
    out = counts[0]
    for c in counts[1:]:
        out = out.bitwiseOR(c)
    return out


def grid(prints: DataFrame) -> DataFrame:
    """prints (a column fp and others) with key and step: a row for a fingerprint's own grid cell (step 0) and for each cell one step away."""
    steps = f"sequence(-{SEGMENTS}, {SEGMENTS})"
    count = "(cell >> (3 * (abs(step) - 1))) & 7"
    key = "cast(CASE WHEN step = 0 THEN cell ELSE cell + sign(step) * shiftleft(1L, 3 * (abs(step) - 1)) END AS long)"
    dealt = prints.withColumn("cell", cell(F.col("fp"))).withColumn("step", F.explode(F.expr(steps)))
    return dealt.where(f"step = 0 OR (step > 0 AND {count} < 4) OR (step < 0 AND {count} > 0)").withColumn("key", F.expr(key)).drop("cell")


def runs_to_pairs(batches, cap: int = CELL_CAP, radius: int = RADIUS):
    """From rows sorted by grid cell: verified pairs (a, b), and members (a, null) of cells over cap.

    step is 0 for a fingerprint's own cell and the (signed) moved segment otherwise. Two fingerprints
    that both moved the same step are at distance 0 of one another and meet in their own cell too.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key, fp, step = (np.empty(0, np.int64) for _ in range(3))
    dense = None

    def settle(key, fp, step):
        first, second = [], []
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
        lengths = np.diff(np.append(starts, len(key)))
        full = np.repeat(lengths > cap, lengths)
        members = fp[full]
        key, fp, step = key[~full], fp[~full], step[~full]
        for d in range(1, cap):
            same = np.flatnonzero(key[d:] == key[:-d])
            if not len(same):
                break
            far = np.bitwise_count((fp[same] ^ fp[same + d]).view(np.uint64)) > radius
            same = same[~far & ((step[same] == 0) | (step[same] != step[same + d]))]
            first.append(fp[same])
            second.append(fp[same + d])
        a = np.concatenate([*first, members]) if first or len(members) else np.empty(0, np.int64)
        b = pa.array(np.concatenate([*second, np.zeros(len(members), np.int64)]), mask=np.arange(len(a)) >= len(a) - len(members))
        return batch(schema, a=a, b=b) if len(a) else None

    for b in batches:
        k, f, s = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        if dense is not None:
            n = int(np.searchsorted(k, dense, "right"))
            if n:
                yield batch(schema, a=f[:n], b=pa.nulls(n, pa.int64()))
                k, f, s = k[n:], f[n:], s[n:]
            if not len(k):
                continue
            dense = None
        key, fp, step = np.concatenate([key, k]), np.concatenate([fp, f]), np.concatenate([step, s])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - last > cap:
            dense, last = key[-1], len(key)
        if (out := settle(key[:last], fp[:last], step[:last])) is not None:
            yield out
        key, fp, step = key[last:], fp[last:], step[last:]
    if (out := settle(key, fp, step)) is not None:
        yield out


def fingerprint_links(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, degrees): edges (a, b) that connect exactly the fingerprints within RADIUS differing bits of one another, and (fp, n_links), how many of those each has.

    distinct: a column fp of distinct fingerprints. Members of over-full cells are linked by stars:
    two fingerprints differ in at most 2 bits just if some 64-bit word is within one bit of both, so
    all that share such a word are linked to the smallest of them. That is exact and makes 65 rows
    a member instead of all pairs. Two such members share exactly two words, so a member's others,
    summed over its words, count each twice.
    """
    met = materialize(grid(distinct).select("key", "fp", "step").repartition("key").sortWithinPartitions("key").mapInArrow(runs_to_pairs, "a long, b long"), "met")
    dense = materialize(met.where("b IS NULL").select(F.col("a").alias("fp")).distinct(), "crowded")
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    words = dense.select("fp", F.explode(flips).alias("word"))
    shared = words.join(words.groupBy("word").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1"), "word")
    pairs = met.where("b IS NOT NULL").distinct()
    edges = pairs.union(shared.where("fp <> low").select("fp", "low").distinct())
    # Pairs of two crowded members are counted by their words.
    crowded = broadcast_if_small(dense.withColumn("crowded", F.lit(True)), 500_000)
    other = pairs.join(crowded.toDF("a", "crowded_a"), "a", "left").join(crowded.toDF("b", "crowded_b"), "b", "left").where("crowded_a IS NULL OR crowded_b IS NULL")
    ones = other.select(F.col("a").alias("fp"), F.lit(2).cast("long").alias("n")).union(other.select("b", F.lit(2).cast("long"))).union(shared.select("fp", F.col("n") - 1))
    return edges, ones.groupBy("fp").agg((F.sum("n") / 2).cast("long").alias("n_links"))


def simhash_components(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), n_links.

    Documents are linked if their fingerprints differ in at most 2 bits. Equal fingerprints are one
    node, so a large group of copies costs one row; n_links counts the other distinct fingerprints
    that the document's is linked to. Null and empty
    texts have fingerprint zero and are linked like any other. Repeated rows each give a row; a null
    id is kept and never is a component's name unless its whole component is null. Extra columns are
    ignored. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, size, id_col, text_col), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    edges, degrees = fingerprint_links(nodes.select("fp"))
    roots = connected_components(edges)
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = joined.join(names, "root").join(degrees, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
