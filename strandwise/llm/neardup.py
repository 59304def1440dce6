"""Document near-duplicates at a Jaccard similarity, on the SimHash operator's parts.

A single 64-bit SimHash with a small radius finds only copies with hardly a change: at a Jaccard
similarity of 0.8 about 15% of the bits differ. So a document gets a 256-bit fingerprint (four lanes of
its shingle hashes). The first lane is the document's SimHash, and goes through the operator's own steps:
16 segments' bit counts, the grid cell of that vector and those one step away, and of the documents that
meet there those within the operator's radius. For pairs farther apart many sub-fingerprints of some of the
256 bits are cells, too, in which documents are compared by the Hamming distance of one lane. What passes
either way is verified by the exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, broadcast_if_small, connected_components, materialize, pieces
from .simhash import LANES, RADIUS, fingerprint, grid, shingle_hashes


@dataclass(frozen=True)
class NearDupSpec:
    """shingle: words a shingle; similarity: least Jaccard similarity; bands sub-fingerprints of bits bits, of which a first round takes first_bands, are for up to 2 ** (bits - 2) different texts: sized() gives more bits, and the bands that keep a pair's chance, for more; most_far: lane bits in which a candidate may differ; cap: documents in a cell up to which the first round compares them together, in fuller cells block by block; block: rows of a cell that are compared in one task, fuller cells are dealt by pairs of blocks."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 80
    first_bands: int = 16
    bits: int = 20
    most_far: int = 22
    cap: int = 64
    block: int = 1024
    seed: int = 5

    def sized(self, n: int) -> NearDupSpec:
        """The same for n different texts: enough bits that few unlike texts share a cell. A bit agrees for about 85% of pairs at 0.8."""
        bits = min(40, max(self.bits, n.bit_length() + 2))
        return replace(self, bits=bits, bands=math.ceil(self.bands * 0.85 ** (self.bits - bits)), first_bands=math.ceil(self.first_bands * 0.85 ** (self.bits - bits)))


LANE_NAMES = [f"f{i}" for i in range(len(LANES))]
#: Added to the key of a grid cell, above all keys of bands; keys of rare shingles are negative.
GRID = 1 << 62


def reach(key: int, spec: NearDupSpec) -> int:
    """Lane bits in which documents that meet under a key may differ: the operator's radius in a cell of the SimHash grid, most_far in a band's; under a rare shingle any, as lanes there may be of different bands."""
    return RADIUS if key >= GRID else spec.most_far if key >= 0 else 64


def sketches(docs: DataFrame, spec: NearDupSpec) -> DataFrame:
    """(doc_id, t1, t2, f0..f3): a digest of the lower-cased words and the fingerprint; one narrow pass."""
    names = ["doc_id", "t1", "t2", *LANE_NAMES]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        for b in pieces(batches):
            rows = np.zeros((b.num_rows, 6), np.uint64)
            for i, text in enumerate(b.column(1).to_pylist()):
                d = xxhash.xxh3_128_intdigest(b" ".join((text or "").encode().lower().split()))
                rows[i, 0], rows[i, 1] = d >> 64, d & (1 << 64) - 1
                rows[i, 2:] = fingerprint(shingle_hashes(text, spec.shingle), len(LANES))
            yield batch(schema, doc_id=b.column(0), **{n: np.ascontiguousarray(rows[:, i]).view(np.int64) for i, n in enumerate(names[1:])})

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def cells(classes: DataFrame, spec: NearDupSpec, bands: int) -> DataFrame:
    """(key, id, lane, root): each class in one cell of each of the first bands, with the lane that the band compares."""
    choice = np.random.default_rng(spec.seed)
    picks = [choice.choice(64 * len(LANES), spec.bits, replace=False) for _ in range(bands)]
    powers = (1 << np.arange(spec.bits)).astype(np.int64)
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("lane", pa.int64()), ("root", pa.int64())])

    def run(batches):
        for b in pieces(batches):
            lanes = np.stack([b.column(i + 2).to_numpy() for i in range(len(LANES))], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1, bitorder="little")
            keys = np.stack([(bits[:, p].astype(np.int64) @ powers) | (band << 41) for band, p in enumerate(picks)], axis=1)
            which = lanes[:, np.arange(bands) % len(LANES)]
            yield batch(schema, key=keys.ravel(), id=np.repeat(b.column(0).to_numpy(), bands), lane=which.ravel(), root=np.repeat(b.column(1).to_numpy(), bands))

    return classes.select("id", "root", *LANE_NAMES).mapInArrow(run, "key long, id long, lane long, root long")


def grid_cells(classes: DataFrame) -> DataFrame:
    """(key, id, lane, root): each class in the SimHash operator's grid, by its first lane: in its own cell and in those one step away. Any two within the radius meet."""
    return grid(classes.select("id", F.col("f0").alias("fp"), "root")).select((F.col("key") + F.lit(GRID)).alias("key"), "id", F.col("fp").alias("lane"), "root")


def close_pairs(batches, spec: NearDupSpec):
    """The first round's candidate pairs (a, b) of different roots, from rows sorted by cell.

    Of the others in its cell that are not connected with it yet, each document is paired with the nearest
    one: rows out never outnumber rows in. Long runs are looked at in blocks.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    empty = np.empty(0, np.int64)

    def crowd(x):
        """Nearest of another root for each member of a block of a full cell."""
        out = []
        _, ids, lane, root = x
        for at in range(0, len(ids), 256):
            far = np.bitwise_count((lane[at : at + 256, None] ^ lane[None, :]).view(np.uint64)).astype(np.int16)
            far[root[at : at + 256, None] == root[None, :]] = 99
            best = far.argmin(axis=1)
            ok = far[np.arange(len(far)), best] <= spec.most_far
            out.append((ids[at : at + 256][ok], ids[best[ok]]))
        return out

    def settle(x):
        key = x[0]
        if not len(key):
            return batch(schema, a=empty, b=empty)
        pairs, close = [], []
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        one_root = np.minimum.reduceat(x[3], starts) == np.maximum.reduceat(x[3], starts)
        for s, n in zip(starts[(sizes > spec.cap) & ~one_root].tolist(), sizes[(sizes > spec.cap) & ~one_root].tolist()):
            for at in range(s, s + n, spec.block):
                block = x[:, at : min(s + n, at + spec.block)]
                pairs += crowd(block)
                if at > s:
                    pairs += crowd(np.concatenate([x[:, s : s + spec.cap], block], axis=1))
        key, ids, lane, root = x[:, np.repeat((sizes <= spec.cap) & ~one_root, sizes)]
        for d in range(1, spec.cap):
            same = np.flatnonzero(key[d:] == key[:-d])
            if not len(same):
                break
            far = np.bitwise_count((lane[same] ^ lane[same + d]).view(np.uint64)).astype(np.int64)
            ok = (far <= spec.most_far) & (root[same] != root[same + d])
            close.append(np.stack([same[ok], same[ok] + d, far[ok]]))
        if close:
            i, j, far = np.concatenate(close, axis=1)
            i, j, far = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([far, far])
            order = np.lexsort((ids[j], far, i))
            i, j = i[order], j[order]
            best = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.empty(0, bool)
            pairs.append((ids[i[best]], ids[j[best]]))
        a, b = (np.concatenate([p[n] for p in pairs]) if pairs else empty for n in (0, 1))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
        return batch(schema, a=both[:, 0], b=both[:, 1])

    held = np.empty((4, 0), np.int64)
    for b in batches:
        held = np.concatenate([held, np.stack([b.column(n).to_numpy() for n in range(4)])], axis=1)
        if not held.shape[1]:
            continue
        n, last = held.shape[1], int(np.searchsorted(held[0], held[0, -1], "left"))
        if n - last > 8 * spec.block:
            last = n
        if last > spec.block or n > 8 * spec.block:
            yield settle(held[:, :last])
            held = held[:, last:]
    yield settle(held)


NAMES = ("key", "i", "j", "block", "id", "lane", "root")
MEMBERS = pa.schema([(n, pa.int64()) for n in NAMES])
MEMBERS_DDL = ", ".join(f"{n} long" for n in NAMES)


def partnered(lane, root, most_far: int, side=None) -> np.ndarray:
    """Which rows have a partner: one of another root, within most_far bits, and, if sides are given, of the other side."""
    out = np.zeros(len(lane), bool)
    for at in range(0, len(lane), 256):
        near = np.bitwise_count((lane[at : at + 256, None] ^ lane[None, :]).view(np.uint64)) <= most_far
        near &= root[at : at + 256, None] != root[None, :]
        if side is not None:
            near &= side[at : at + 256, None] != side[None, :]
        out[at : at + 256] = near.any(axis=1)
    return out


def runs_of(batches, n_keys: int):
    """Groups of rows with equal leading columns, from batches of long columns that are sorted by those."""
    held = None
    for b in batches:
        x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in range(b.num_columns)])
        held = x if held is None else np.concatenate([held, x], axis=1)
        turns = np.flatnonzero((held[:n_keys, 1:] != held[:n_keys, :-1]).any(axis=0)) + 1
        for s, e in zip(np.append(0, turns[:-1]) if len(turns) else [], turns):
            yield held[:, s:e]
        held = held[:, turns[-1] :] if len(turns) else held
    if held is not None and held.shape[1]:
        yield held


def cell_members(batches, spec: NearDupSpec):
    """MEMBERS rows of each cell, from rows (key, id, lane, root) sorted by cell: those that have a partner there.

    A cell of more than spec.block rows is too much for one task: all its rows come out with i = -1 and the number of
    their block, to be dealt by pairs of blocks. Rows out never outnumber rows in.
    """

    def out(cell, at, first):
        n = cell.shape[1]
        zero = np.zeros(n, np.int64)
        return np.stack([cell[0], zero - 1 if at is not None else zero, zero, zero if at is None else np.full(n, at), cell[1], cell[2], cell[3]])

    def rows(batches):
        # A run that has grown over a block is passed on piece by piece.
        key, passed, held = None, 0, np.empty((4, 0), np.int64)
        for b in batches:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in range(4)])
            if not x.shape[1]:
                continue
            held = np.concatenate([held, x], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], held[0, 1:] != held[0, :-1]]))
            ends = np.append(starts[1:], held.shape[1])
            for s, e in zip(starts.tolist(), ends.tolist()):
                final = e < held.shape[1]
                if held[0, s] != key:
                    key, passed = held[0, s], 0
                while passed and s < e and (e - s >= spec.block or final):
                    step = min(spec.block, e - s)
                    yield held[:, s : s + step], passed
                    s, passed = s + step, passed + 1
                while not passed and e - s > spec.block:
                    yield held[:, s : s + spec.block], passed
                    s, passed = s + spec.block, 1
                    while e - s >= spec.block or (final and s < e):
                        step = min(spec.block, e - s)
                        yield held[:, s : s + step], passed
                        s, passed = s + step, passed + 1
                if final and s < e:
                    yield held[:, s:e], None
            held = held[:, s:]
        if held.shape[1]:
            yield held, passed if passed else None

    ready, n = [], 0
    for cell, at in rows(batches):
        if at is None and (cell.shape[1] < 2 or (cell[3] == cell[3, 0]).all()):
            continue
        if at is None:
            cell = cell[:, partnered(cell[2], cell[3], reach(int(cell[0, 0]), spec))]
        ready.append(out(cell, at, False))
        n += cell.shape[1]
        if n > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(ready, axis=1)], schema=MEMBERS)
            ready, n = [], 0
    if ready:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(ready, axis=1)], schema=MEMBERS)


def block_members(batches, spec: NearDupSpec):
    """MEMBERS rows of pairs of blocks, sorted by key, i, j: those that have a partner in the other block (of one block: in it)."""
    for group in runs_of(batches, 3):
        low = group[3] == group[1, 0]
        keep = partnered(group[5], group[6], reach(int(group[0, 0]), spec), None if low.all() else low)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in group[:, keep]], schema=MEMBERS)


def prefixes(sets: DataFrame, spec: NearDupSpec) -> DataFrame:
    """(shingle, id): of each set its rarest shingles, as many as a set can lack and still be similar enough, and one more.

    Two sets that are similar enough share one of these (all ordered by how many sets hold a shingle, then by its
    hash), so shingles that a template gives to all, being frequent, bring nobody together. sets: a written table.
    """
    flat = sets.mapInArrow(unpacked_sets, "id long, n int, shingle long")
    held = flat.groupBy("shingle").agg(F.count("*").alias("_held")).where("_held > 1")
    own = flat.join(held, "shingle", "left").select("id", "n", "shingle", F.coalesce("_held", F.lit(1)).alias("_held"))
    order = Window.partitionBy("id").orderBy("_held", "shingle")
    keep = F.col("n") - F.ceil(F.col("n") * spec.similarity - 1e-9) + 1
    return own.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).where("_held > 1").select("shingle", "id")


def unpacked_sets(batches):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("shingle", pa.int64())])
    for b in batches:
        for piece in pieces([b], 64):
            sets = [np.frombuffer(x.as_py(), np.uint32) for x in piece.column(1)]
            sizes = [len(x) for x in sets]
            flat = np.concatenate(sets).astype(np.int64) if sets else np.empty(0, np.int64)
            yield batch(schema, id=np.repeat(piece.column(0).to_numpy(), sizes), n=np.repeat(sizes, sizes).astype(np.int32), shingle=flat)


def members(sorted_cells: DataFrame, spec: NearDupSpec, sets_of=None) -> DataFrame:
    """The documents of each cell, or pair of a full cell's blocks, that have a partner there: a written table of MEMBERS rows.

    sets_of: a function from a table of ids to their shingle sets. With it, the documents of full cells meet once more
    by their rare shingles instead, which loses no pair; what is still full then is dealt by pairs of blocks.
    """
    met = materialize(sorted_cells.mapInArrow(lambda it: cell_members(it, spec), MEMBERS_DDL), "met")
    small, full = met.where("i = 0"), met.where("i < 0")
    # A full cell of one root has nothing to link.
    mixed = full.groupBy("key").agg(F.max("block").alias("last"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").drop("_lo", "_hi")
    mixed = materialize(mixed, "full-cells")
    if not mixed.limit(1).count():
        return small
    full = full.join(broadcast_if_small(mixed, 500_000), "key")
    if sets_of is not None:
        crowd = materialize(full.groupBy("id").agg(F.first("root").alias("root"), F.first("lane").alias("lane")), "crowd")
        keys = prefixes(sets_of(crowd.select("id")), spec).join(crowd, "id").select(F.col("shingle").alias("key"), "id", "lane", "root")
        again = members(keys.repartition("key").sortWithinPartitions("key"), replace(spec, most_far=64))
        return small.unionByName(again.withColumn("key", -1 - F.col("key")))
    dealt = full.drop("i", "j").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "lane", "root")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialize(small.union(dealt.mapInArrow(lambda it: block_members(it, spec), MEMBERS_DDL)), "members")


def cell_links(lane, root, ids, low, sets: list[np.ndarray], spec: NearDupSpec):
    """Links (a, b) that join all members whose similarity is high enough, at most one less than there are members.

    Each member is compared with all others at once; what is joined already is not compared again. low: the
    side of each member; members of two blocks are only compared across them.
    """
    label = np.unique(root, return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    across = not low.all()
    out = []
    for x in range(len(ids)):
        ok = (label != label[x]) & (np.bitwise_count((lane ^ lane[x]).view(np.uint64)) <= spec.most_far)
        ok &= (low != low[x]) if across else np.arange(len(ids)) > x
        # A similarity is at most the ratio of the sizes.
        ok &= np.minimum(sizes, sizes[x]) >= spec.similarity * np.maximum(sizes, sizes[x])
        who = np.flatnonzero(ok) if not (across and low[x]) else np.empty(0, int)
        if not len(who):
            continue
        flat = np.concatenate([sets[y] for y in who])
        at = np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)
        both = np.add.reduceat(sets[x][at] == flat, np.concatenate([[0], np.cumsum(sizes[who])[:-1]]), dtype=np.int64)
        for y in who[both >= spec.similarity * (sizes[x] + sizes[who] - both)].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
    return out


def verified_cells(batches, spec: NearDupSpec):
    """Links (a, b) from rows (key, i, j, block, id, lane, root, shingles) sorted by key, i, j."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(group):
        k = np.array([g[:7] for g in group], np.int64).T
        within = replace(spec, most_far=reach(int(k[0, 0]), spec))
        found = cell_links(k[5], k[6], k[4], k[3] == k[1, 0], [np.frombuffer(g[7], np.uint32) for g in group], within)
        return batch(schema, a=[x for x, _ in found], b=[x for _, x in found])

    group: list[tuple] = []
    for b in batches:
        for piece in pieces([b], 256):
            for row in zip(*(c.to_pylist() for c in piece.columns)):
                if group and group[0][:3] != row[:3]:
                    yield settle(group)
                    group = []
                group.append(row)
    if group:
        yield settle(group)


def shingle_sets(rows: DataFrame, spec: NearDupSpec) -> DataFrame:
    """(id, shingles): the distinct 32-bit shingle hashes of the texts, sorted."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for b in batches:
            sets = [np.unique((shingle_hashes(t, spec.shingle) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in b.column(1).to_pylist()]
            yield batch(schema, id=b.column(0), shingles=sets)

    return rows.select("id", "text").mapInArrow(run, "id long, shingles binary")


def alike(pairs: DataFrame, spec: NearDupSpec) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint32) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= spec.similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def wanted_sets(docs: DataFrame, ids: DataFrame, spec: NearDupSpec) -> DataFrame:
    """A written table (id, shingles) of the documents named by ids."""
    wanted = materialize(ids.distinct(), "wanted")
    found = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").join(broadcast_if_small(wanted, 500_000), F.col("doc_id") == F.col("id"))
    return materialize(shingle_sets(found, spec), "shingle-sets")


def nearest_links(docs: DataFrame, classes: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Edges (a, b): each class with the nearest other one of its cell, over the first bands, where the similarity is high enough. classes: id, root, lanes."""
    sorted_cells = cells(classes, spec, min(spec.first_bands, spec.bands)).repartition("key").sortWithinPartitions("key")
    pairs = materialize(sorted_cells.mapInArrow(lambda it: close_pairs(it, spec), "a long, b long").distinct(), "candidates")
    sets = wanted_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), spec)
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return materialize(alike(joined, spec).distinct(), "links")


def all_links(docs: DataFrame, classes: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Edges (a, b) that connect whatever is similar enough and meets in a cell of the SimHash grid, within the radius, or of any band; a row a document and cell moves, or a document and rare shingle where cells are full. classes: id, root, lanes."""
    met = grid_cells(classes).union(cells(classes, spec, spec.bands))
    held = members(met.repartition("key").sortWithinPartitions("key"), spec, lambda ids: wanted_sets(docs, ids, spec))
    sets = wanted_sets(docs, held.select("id"), spec)
    # A text of an id that stands for two different texts has a set a text.
    rows = held.join(sets, "id").select(*NAMES, "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialize(rows.mapInArrow(lambda it: verified_cells(it, spec), "a long, b long").distinct(), "links")


def near_duplicate_groups(docs: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """(doc_id, keeper): each document and the smallest doc_id of its group of near-duplicates.

    Documents with the same lower-cased words are one class, named by its smallest doc_id and compared
    once; classes at a Jaccard similarity of spec.similarity or more over distinct word shingles are
    linked, links are transitive. A first round over a few bands, with the nearest of each cell only, links
    most of each group; the second compares all that meet in a cell of the SimHash grid or of any band and are not
    connected yet, inside the cell's task, so that a document is moved once a cell and only links come out. A text of fewer words than a shingle is one shingle; one
    without words (or null) equals others of its kind. Different texts with one doc_id are one node. Rows
    without doc_id are left out. Extra columns are ignored; no rows give no rows.
    """
    prints = materialize(sketches(docs, spec), "sketches")
    classes = materialize(prints.groupBy("t1", "t2").agg(F.min("doc_id").alias("id"), *[F.first(n).alias(n) for n in LANE_NAMES]), "classes")
    spec = spec.sized(classes.count())
    first = nearest_links(docs, classes.withColumn("root", F.col("id")), spec)
    known = materialize(connected_components(first).withColumnRenamed("node", "id"), "known")
    rooted = materialize(classes.join(known, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    links = known.toDF("a", "b").union(all_links(docs, rooted, spec))
    roots = connected_components(links).withColumnRenamed("node", "id")
    placed = classes.select("id", "t1", "t2").join(roots, "id", "left").select("t1", "t2", F.coalesce("root", "id").alias("keeper"))
    return prints.select("doc_id", "t1", "t2").join(placed, ["t1", "t2"]).select("doc_id", "keeper")


def drop_near_duplicates(docs: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """docs with one document of each group of near-duplicates left, the smallest doc_id; columns as they are.

    Rows without doc_id stay. If an id is there twice, the row of the smallest text hash stays (of equal texts, that of the smallest hash of all columns).
    """
    groups = materialize(near_duplicate_groups(docs, spec), "near-groups")
    gone = materialize(groups.where("doc_id <> keeper").select(F.col("doc_id").alias("_doc")).distinct(), "near-gone")
    out = docs.join(broadcast_if_small(gone, 500_000), F.col("doc_id") == F.col("_doc"), "left_anti")
    again = materialize(groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "near-repeated")
    if again.limit(1).count():
        again = broadcast_if_small(again, 500_000)
        once = out.join(again, F.col("doc_id") == F.col("_again"), "left_anti")
        rows = out.join(again, F.col("doc_id") == F.col("_again"), "left_semi").select(F.col("doc_id").alias("_doc"), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns)).alias("_order"), F.struct(*docs.columns).alias("_row"))
        out = once.union(rows.groupBy("_doc").agg(F.min_by("_row", "_order").alias("_row")).select(*[F.col(f"_row.`{c}`") for c in docs.columns]))
    return out
