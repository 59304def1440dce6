"""Exact repeated-substring removal with suffix arrays by induced sorting.

Texts are cut into segments at places that depend on content alone: a segment is a run of windows (byte
strings of the match length) that share their smallest k-gram hash. Equal windows share that hash, so
segments with different hashes never share a window, and everything with one hash meets in one shard.
Segments that are equal are collapsed first; only hashes with several different segments need a suffix
array. Their segments are laid side by side, the suffixes are sorted by induced sorting, the common
prefixes are found in text order (the permuted array), and a window that agrees with a neighbour in the
order over its whole length is a repeat.

A hash with very many different segments (the edges of a passage that many texts hold) is cut further:
where a window's smallest gram stands in it depends on the window alone, so windows are parted by ranges
of that place, and those of one range by the bytes that all of the range must hold. Ranges shrink until
a group is small enough for a suffix array; at the end a piece is a single window.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize

MULTIPLIER = 0x5851F42D4C957F2D
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Keys of dense groups up to which they are broadcast; beyond, they are joined by shuffle.
DENSE_KEYS = 500_000
#: Rows of one key up to which a join leaves it to its hash: some 10 MB of the longest segments.
HOT_ROWS = 4096
#: Keys with more rows that a join broadcasts at most; a key is hot from a share of the rows that keeps to this.
HOT_KEYS = 500_000


@dataclass(frozen=True)
class RepeatSpec:
    """length: bytes of a repeated string; gram: bytes of the hashed k-grams; most_windows: windows a segment holds at most; shard_bytes: segment bytes from which a suffix array is built; dense: different segments with one hash beyond which they are cut further, so that no hash can fill a task."""

    length: int = 400
    gram: int = 64
    most_windows: int = 2048
    shard_bytes: int = 1 << 20
    dense: int = 512


# --- suffix arrays -----------------------------------------------------------------------------


def induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes that follows from an order of the leftmost-S (LMS) suffixes.

    t ends with a unique smallest 0. One pass left to right places L-type suffixes, one right to left
    S-type ones. For a small alphabet a whole bucket is taken at once: what it places in later buckets is
    appended in order, and what it places in itself is the next wave. A large alphabet (the recursion's)
    takes the suffixes one by one.
    """
    n = len(t)
    sizes = np.bincount(t, minlength=sigma)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    sa = np.full(n, -1, np.int64)
    keys = t[lms]
    order = np.argsort(keys, kind="stable")
    placed = lms[order]
    per = np.bincount(keys, minlength=sigma)
    inside = np.arange(len(placed)) - np.repeat(np.cumsum(per) - per, per)
    sa[np.repeat(ends - per, per) + inside] = placed
    if sigma > 1024:
        return induce_each(t, s_type, sa, heads, ends, per)
    l_next = heads.copy()
    for c in np.flatnonzero(sizes).tolist():
        done, first_s = int(heads[c]), int(ends[c] - per[c])
        while done < l_next[c]:
            wave, done = sa[done : l_next[c]], int(l_next[c])
            place(sa, t, s_type, wave, l_next, False)
        if first_s < ends[c]:
            place(sa, t, s_type, sa[first_s : ends[c]], l_next, False)
    # LMS places are filled anew, with all S-type suffixes.
    for c in np.flatnonzero(per).tolist():
        sa[ends[c] - per[c] : ends[c]] = -1
    sa[0] = n - 1
    s_next = ends.copy()
    s_next[0] = 0
    for c in np.flatnonzero(sizes).tolist()[::-1]:
        done = int(ends[c])
        while done > s_next[c]:
            wave, done = sa[s_next[c] : done][::-1], int(s_next[c])
            place(sa, t, s_type, wave, s_next, True)
        if l_next[c] > heads[c]:
            place(sa, t, s_type, sa[heads[c] : l_next[c]][::-1], s_next, True)
    return sa


def place(sa: np.ndarray, t: np.ndarray, s_type: np.ndarray, wave: np.ndarray, at: np.ndarray, to_s: bool) -> None:
    """Put the predecessors of a wave of suffixes into their buckets: L-type ones forwards, S-type ones backwards."""
    before = wave[wave > 0] - 1
    before = before[s_type[before] == to_s]
    if not len(before):
        return
    keys = t[before]
    if len(before) > 1:
        order = np.argsort(keys, kind="stable")
        before, keys = before[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    inside = np.arange(len(keys)) - np.repeat(first, counts)
    buckets = keys[first]
    if to_s:
        sa[np.repeat(at[buckets], counts) - 1 - inside] = before
        at[buckets] -= counts
    else:
        sa[np.repeat(at[buckets], counts) + inside] = before
        at[buckets] += counts


def induce_each(t: np.ndarray, s_type: np.ndarray, sa: np.ndarray, heads: np.ndarray, ends: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The two passes one suffix at a time. A suffix's key is its predecessor's bucket if that is of the pass's type, else -1; both passes write ahead of where they read."""
    n = len(t)
    earlier = np.concatenate([[-1], t[:-1]])
    of_s = np.concatenate([[False], s_type[:-1]])
    key, out, at = np.where(of_s, -1, earlier).tolist(), sa.tolist(), heads.tolist()
    for j in out:
        if j >= 0 and (c := key[j]) >= 0:
            out[at[c]] = j - 1
            at[c] += 1
    sa = np.array(out, np.int64)
    wiped = np.repeat(ends - per, per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    sa[wiped] = -1
    sa[0] = n - 1
    key, out, at = np.where(of_s, earlier, -1).tolist(), sa[::-1].tolist(), (n - ends).tolist()
    for j in out:
        if j >= 0 and (c := key[j]) >= 0:
            out[at[c]] = j - 1
            at[c] += 1
    return np.array(out, np.int64)[::-1]


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of t (integers below sigma, a single 0 at the end), by induced sorting (Nong, Zhang, Chan, 2009)."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    # A suffix is S-type if the next different character is larger.
    differs = np.flatnonzero(t[1:] != t[:-1])
    s_type = np.ones(n, bool)
    run = np.searchsorted(differs, np.arange(n - 1))
    s_type[:-1] = t[differs[run]] < t[differs[run] + 1]
    is_lms = np.concatenate([[False], s_type[1:] & ~s_type[:-1]])
    lms = np.flatnonzero(is_lms)
    rough = induce(t, s_type, lms, sigma)
    rough = rough[is_lms[rough]]
    # Name the LMS substrings: neighbours in the rough order are equal if length, characters and ends agree.
    spans = np.diff(np.append(lms, n - 1)) + 1
    length = dict_array(n, lms, spans)
    a, b = rough[:-1], rough[1:]
    same = length[a] == length[b]
    todo, k = np.flatnonzero(same), 0
    while len(todo):
        x, y = a[todo], b[todo]
        here = k < length[x]
        todo, x, y = todo[here], x[here], y[here]
        equal = t[x + k] == t[y + k]
        same[todo[~equal]] = False
        todo, k = todo[equal], k + 1
    names = np.concatenate([[0], np.cumsum(~same)])
    named = np.empty(n, np.int64)
    named[rough] = names
    reduced = named[lms]
    if names[-1] + 1 == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = suffix_array(reduced, int(names[-1]) + 1)
    return induce(t, s_type, lms[order], sigma)


def dict_array(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[at] = values
    return out


def permuted_lcp(data: bytes, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, by text position.

    Where the characters before both suffixes agree, the value is that at the position before less one
    (Kärkkäinen, Manzini, Puglisi, 2009); only the other positions are compared, eight bytes at a time.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    t = np.frombuffer(data, np.uint8)
    here = np.arange(n)
    fresh = (here == 0) | (before <= 0)
    fresh[1:] |= t[:-1] != t[np.maximum(before[1:], 1) - 1]
    padded = np.frombuffer(data + bytes(range(8)), np.uint8).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for i in range(8):
        words |= padded[i : i + n] << np.uint64(8 * i)
    at = np.flatnonzero(fresh & (before >= 0))
    value = np.zeros(n, np.int64)
    i, j = at, before[at]
    while len(i):
        inside = np.maximum(i, j) + 8 <= n
        full = inside & (words[np.minimum(i, n - 1)] == words[np.minimum(j, n - 1)])
        last = ~full
        a, b, who = i[last], j[last], at[last]
        for _ in range(8):
            ok = np.maximum(a, b) < n
            ok[ok] = t[a[ok]] == t[b[ok]]
            a, b, who = a[ok], b[ok], who[ok]
            value[who] += 1
            a, b = a + 1, b + 1
        value[at[full]] += 8
        i, j, at = i[full] + 8, j[full] + 8, at[full]
    # value + position stays level from each fresh position until the next.
    level = np.where(fresh, value + here, -1)
    return level[np.maximum.accumulate(np.where(fresh, here, 0))] - here


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some different segments, which of its windows also start elsewhere in them.

    Segments are joined with a byte that UTF-8 never holds. A window ends before it, and whatever agrees
    with a window over its whole length holds no such byte either, so no match reaches over an end.
    """
    data = b"".join(s + b"\xff" for s in segments) + b"\x00"
    t = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    t[-1] = 0
    sa = suffix_array(t, 257)
    plcp = permuted_lcp(data, sa)
    n = len(sa)
    hit = plcp >= length
    at = np.flatnonzero(hit)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    hit[before[at]] = True
    out, start = [], 0
    for s in segments:
        out.append(np.flatnonzero(hit[start : start + len(s) - length + 1]))
        start += len(s) + 1
    return out


# --- segments ----------------------------------------------------------------------------------


class Grams:
    """Hashes of all k-grams of a byte string, and the smallest one in each window."""

    def __init__(self, spec: RepeatSpec):
        self.spec, self.size = spec, 0
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.powers) < n:
            m, i = (np.uint64(pow(x, len(self.powers), 1 << 64)) for x in (MULTIPLIER, INVERSE))
            self.powers = np.concatenate([self.powers, self.powers * m])
            self.inverses = np.concatenate([self.inverses, self.inverses * i])

    def smallest(self, data: np.ndarray) -> np.ndarray:
        k, w = self.spec.gram, self.spec.length - self.spec.gram + 1
        n = len(data)
        self.grow(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n])])
        h = (sums[k:] - sums[:-k]) * self.inverses[: n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        # Running minimum over w values: block prefixes and block suffixes (van Herk, 1992).
        m = len(h)
        padded = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:m] = h
        blocks = padded.reshape(-1, w)
        forward = np.minimum.accumulate(blocks, axis=1).ravel()
        backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(backward[: m - w + 1], forward[w - 1 : m]), h

    def segments(self, data: bytes):
        """(first window, last window, hash, whether the smallest gram is there twice) of each segment, in order; long texts are hashed in overlapping pieces."""
        length, step = self.spec.length, 1 << 20
        n = len(data) - length + 1
        for at in range(0, n, step):
            low, grams = self.smallest(np.frombuffer(data, np.uint8, count=min(step, n - at) + length - 1, offset=at))
            edges = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                h, twice = int(low[a]), int(np.count_nonzero(grams[a : b + self.spec.length - self.spec.gram] == low[a]) > 1)
                for x in range(a, b, self.spec.most_windows):
                    yield at + x, at + min(b, x + self.spec.most_windows) - 1, h, twice


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_rows(docs: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(doc_id, at, windows, h, s1, s2, twice): every segment with its hash and a 128-bit digest of its bytes. twice: the smallest gram is at two places, so the segment may repeat itself."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "at", "windows", "h", "s1", "s2", "twice")])

    def run(batches):
        grams = Grams(spec)
        for b in batches:
            cols: list[list[int]] = [[] for _ in schema]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = (text or "").encode()
                if len(data) < spec.length:
                    continue
                view = memoryview(data)
                for first, last, h, twice in grams.segments(data):
                    d = xxhash.xxh3_128_intdigest(view[first : last + spec.length])
                    for c, v in zip(cols, (doc_id, first, last - first + 1, signed(h), signed(d >> 64), signed(d & (1 << 64) - 1), twice)):
                        c.append(v)
                if len(cols[0]) > 50_000:
                    yield batch(schema, **dict(zip(schema.names, cols)))
                    cols = [[] for _ in schema]
            yield batch(schema, **dict(zip(schema.names, cols)))

    return docs.mapInArrow(run, "doc_id long, at long, windows long, h long, s1 long, s2 long, twice long")


SPANS = "array<struct<a: int, b: int>>"


def runs(starts: np.ndarray) -> list[dict]:
    """Ascending window numbers as runs of first and last."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": a, "b": b} for a, b in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist())]


def shard_repeats(segments: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(h, s1, s2, hits): the windows of different segments with one hash that repeat among them.

    segments: (h, s1, s2, data). Rows of one hash meet in one partition, sorted, and suffix arrays are
    built over some shard_bytes at a time, never splitting a hash.
    """
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    schema = pa.schema([("h", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("hits", span)])

    def solve(rows):
        found = [(h, s1, s2, runs(x)) for (h, s1, s2, _), x in zip(rows, repeated_starts([r[3] for r in rows], spec.length)) if len(x)]
        return batch(schema, **{n: [r[i] for r in found] for i, n in enumerate(schema.names)})

    def run(batches):
        ready, group, size = [], [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][0] != row[0]:
                    ready += group
                    group = []
                    if size >= spec.shard_bytes:
                        yield solve(ready)
                        ready, size = [], 0
                group.append(row)
                size += len(row[3])
        if ready or group:
            yield solve(ready + group)

    return segments.repartition("h").sortWithinPartitions("h").mapInArrow(run, f"h long, s1 long, s2 long, hits {SPANS}")


def anchored_pieces(segments: DataFrame, spec: RepeatSpec, width: int) -> DataFrame:
    """Segments cut where their windows' range of offsets changes; an offset is how far into a window its first smallest gram is.

    segments: (h, s1, s2, w, top, data); data begins at the segment's window w, whose offset is top (-1:
    to be found, windows may then follow several grams). Returned: the same of each piece, with its number
    of windows, a digest (d1, d2), and as key a hash of the bytes that every window of the range holds.
    Equal windows have equal offsets and hold equal bytes there, so they share a key.
    """
    names = ["h", "s1", "s2", "w", "top", "windows", "key", "d1", "d2"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("data", pa.binary())])
    reach = spec.length - spec.gram

    def run(batches):
        grams = Grams(spec)
        out, size = {n: [] for n in schema.names}, 0
        for b in batches:
            for h, s1, s2, w, top, data in zip(*(c.to_pylist() for c in b.columns)):
                at = np.arange(len(data) - spec.length + 1)
                if top < 0:
                    _, hashes = grams.smallest(np.frombuffer(data, np.uint8))
                    places = np.flatnonzero(hashes == np.uint64(h % (1 << 64)))
                    offset = places[np.searchsorted(places, at)] - at
                else:
                    offset = top - at
                cell = offset // width
                edges = np.flatnonzero((cell[1:] != cell[:-1]) | (offset[1:] != offset[:-1] - 1)) + 1
                for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
                    gram, low = x + int(offset[x]), int(cell[x]) * width
                    key = xxhash.xxh3_64_intdigest(data[gram - low : gram - min(low + width - 1, reach) + spec.length], low)
                    piece = data[x : y - 1 + spec.length]
                    d = xxhash.xxh3_128_intdigest(piece)
                    row = (h, s1, s2, w + x, int(offset[x]), y - x, signed(key), signed(d >> 64), signed(d & (1 << 64) - 1), piece)
                    for n, v in zip(schema.names, row):
                        out[n].append(v)
                    size += len(piece)
                    if size > 1 << 22:
                        yield batch(schema, **out)
                        out, size = {n: [] for n in schema.names}, 0
        yield batch(schema, **out)

    return segments.select("h", "s1", "s2", "w", "top", "data").mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", data binary")


def join_by_weight(rows: DataFrame, keys: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of rows with keys, both written tables; keys has one row a key, and weight is how many of rows hold it.

    Keys that many rows hold are broadcast, at most HOT_KEYS of them at any size; their rows stay where
    they are, and only the other rows meet by hash.
    """
    least = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = keys.where(F.col(weight) > least)
    if not hot.limit(1).count():
        return rows.join(keys, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(keys.where(F.col(weight) <= least), on))


def dense_repeats(segments: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(h, s1, s2, hits) of hashes with very many different segments, cut until suffix arrays can take them.

    segments: (h, s1, s2, data). Each round has eight times narrower ranges. Pieces that are equal are
    repeats as a whole and go on as one; groups of up to spec.dense different pieces go to suffix arrays
    (a piece by itself repeats nothing, as its windows have different offsets); larger ones are cut again.
    """
    open_ = segments.select("h", "s1", "s2", F.lit(0).cast("long").alias("w"), F.lit(-1).cast("long").alias("top"), "data")
    kind, width, found = ["key", "d1", "d2"], spec.length - spec.gram + 1, []
    while True:
        width = -(-width // 8)
        cut = materialize(anchored_pieces(open_, spec, width), "dense-pieces")
        kinds = cut.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("h", "s1", "s2", "w")).alias("one"), F.first("top").alias("top"), F.first("data").alias("data"))
        kinds = materialize(kinds, "dense-kinds")
        whole = join_by_weight(cut, kinds.where("n > 1").select(*kind, "n"), kind, "n")
        found.append(whole.select("h", "s1", "s2", F.expr("array(named_struct('a', cast(w AS int), 'b', cast(w + windows - 1 AS int)))").alias("hits")))
        groups = materialize(kinds.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "dense-groups")
        # Groups of single windows differ in more than their key only if its 64 bits collide.
        few = join_by_weight(kinds, groups, ["key"], "k").where(F.lit(width == 1) | (F.col("k") <= spec.dense)).select(F.col("key").alias("h"), F.col("d1").alias("s1"), F.col("d2").alias("s2"), "data")
        inside = shard_repeats(few, spec).select(F.col("h").alias("key"), F.col("s1").alias("d1"), F.col("s2").alias("d2"), "hits").join(kinds.where("n = 1").select(*kind, "one"), kind)
        found.append(inside.select("one.h", "one.s1", "one.s2", F.expr("transform(hits, x -> named_struct('a', cast(x.a + one.w AS int), 'b', cast(x.b + one.w AS int)))").alias("hits")))
        more = groups.where(F.col("k") > spec.dense)
        if width == 1 or not more.limit(1).count():
            break
        small = more.limit(DENSE_KEYS + 1).count() <= DENSE_KEYS
        again = kinds.join(F.broadcast(more), "key") if small else join_by_weight(kinds, more, ["key"], "k")
        open_ = again.select("one.h", "one.s1", "one.s2", "one.w", "top", "data")
    return reduce(DataFrame.union, found).groupBy("h", "s1", "s2").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """(row_id, spans): the window starts of each text that also start anywhere else, as runs (first, last).

    docs: row_id (unique), text.
    """
    seg = materialize(segment_rows(docs, spec), "segments")
    place = F.struct("doc_id", "at", "windows")
    kinds = materialize(seg.groupBy("h", "s1", "s2").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max("twice").alias("twice")), "segment-kinds")
    # A hash needs a suffix array if it has different segments, or one that may repeat itself, and not all are repeats as a whole.
    several = materialize(kinds.groupBy("h").agg(F.count("*").alias("k"), F.max("twice").alias("any"), F.min("n").alias("least")).where("(k > 1 OR any > 0) AND least = 1").drop("any", "least"), "segment-hashes")
    needed = materialize(join_by_weight(kinds, several, ["h"], "k").select("h", "s1", "s2", "k", "one.*"), "segments-needed")
    wanted = needed.groupBy(F.col("doc_id").alias("row_id")).agg(F.collect_list(F.struct("at", "windows", "h", "s1", "s2", "k")).alias("want"))
    data = materialize(segment_bytes(docs.join(wanted, "row_id").select("text", "want"), spec), "segment-bytes")
    found = shard_repeats(data.where(F.col("k") <= spec.dense).drop("k"), spec)
    dense = data.where(F.col("k") > spec.dense).drop("k")
    if dense.limit(1).count():
        found = found.union(dense_repeats(dense, spec))
    whole = F.expr(f"cast(array(named_struct('a', 0, 'b', -1)) AS {SPANS})")
    often = kinds.where("n > 1").select("h", "s1", "s2", whole.alias("hits"), "n")
    once = found.join(often.select("h", "s1", "s2"), ["h", "s1", "s2"], "left_anti").withColumn("n", F.lit(1).cast("long"))
    hits = materialize(often.union(once), "segment-hits")
    met = join_by_weight(seg, hits, ["h", "s1", "s2"], "n").select(F.col("doc_id").alias("row_id"), F.expr("transform(hits, x -> named_struct('a', at + x.a, 'b', CASE WHEN x.b < 0 THEN at + windows - 1 ELSE at + x.b END))").alias("hits"))
    return met.groupBy("row_id").agg(F.flatten(F.collect_list("hits")).alias("spans"))


def segment_bytes(rows: DataFrame, spec: RepeatSpec) -> DataFrame:
    schema = pa.schema([("h", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("k", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for b in batches:
            out = {n: [] for n in schema.names}
            for text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = text.encode()
                for w in want:
                    for n, v in zip(schema.names, (w["h"], w["s1"], w["s2"], w["k"], data[w["at"] : w["at"] + w["windows"] + spec.length - 1])):
                        out[n].append(v)
            yield batch(schema, **out)

    return rows.mapInArrow(run, "h long, s1 long, s2 long, k long, data binary").select("h", "s1", "s2", "data", "k")


def cover(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Window runs as disjoint, sorted byte ranges; ranges that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"] + length) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec(), keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, changed (whether a byte is removed) of every document; with keep_bytes also the kept bytes.

    Texts are UTF-8 bytes; null is empty. Every byte under a string of spec.length bytes that also starts
    anywhere else, in any row or the same one, is removed; matches never cross documents. Rows that repeat
    a doc_id are different documents, so each other's copies. A null id is kept. Extra columns are
    ignored; an empty table gives no rows.
    """
    # Rows need a name of their own where ids repeat: id, and a digest-free running number within the id.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if twice.limit(1).count():
        rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    else:
        rows = rows.withColumn("row_id", F.col("doc_id"))
    found = repeats(rows.select("row_id", "text"), spec)
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("changed", pa.bool_())] + [("kept", pa.binary())] * keep_bytes
    schema = pa.schema(names)

    def run(batches):
        for b in batches:
            out = {n: [] for n in schema.names}
            for doc_id, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode()
                cut = cover(spans, spec.length)
                kept, at = [], 0
                for x, y in cut:
                    kept.append(data[at:x])
                    at = y
                kept = b"".join([*kept, data[at:]])
                row = (doc_id, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), bool(cut), kept)
                for n, v in zip(schema.names, row):
                    out[n].append(v)
            yield batch(schema, **out)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, changed boolean" + ", kept binary" * keep_bytes
    return rows.join(found, "row_id", "left").select("doc_id", "text", "spans").mapInArrow(run, ddl)
