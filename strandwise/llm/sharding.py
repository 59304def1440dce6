"""Sharding by a k-d tree: split at byte-weighted medians along the widest metadata dimension.

A node that holds more than the target bytes is split along the dimension that is widest there, at the
weighted quantile that gives both sides their leaves' share of the bytes. Quantiles are found by digit
refinement: one pre-aggregated histogram a pass (the first one over all dimensions, which also tells their
widths: the range of a measure, the number of values of a label, whose hashes have no distance), so that only one row per node and dimension reaches the driver. The finished tree is a small rule
set and is applied to rows as one expression.

Equal texts are to share a shard, whatever their labels: a group of copies takes the smallest language and
source of its members. Only groups whose members differ need that, and those are joined by text hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Digits of a sort key: 15 bits of the dimension, 32 of the text's hash, so that equal texts have one key and no cut parts them.
DIGITS = (8, 16, 16, 7)
VALUES = 1 << 15
DIMENSIONS = ("lang", "source", "log_size", "non_ascii")
LABELS = ("lang", "source")
OVERHEAD = 16
#: Rows (16 bytes each) up to which the table of shared labels is broadcast; beyond, it is joined by shuffle.
LABEL_ROWS = 500_000


@dataclass(frozen=True)
class Split:
    """Rows whose key on dimension is below cut go left; a leaf is an int."""

    dimension: int
    cut: int
    left: Split | int
    right: Split | int


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def metadata(docs: DataFrame) -> DataFrame:
    """docs plus _size, _text (the text's hash) and a value below VALUES per dimension (_lang and so on); null labels are 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    label = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(VALUES - 1)) + 1)
    values = {
        "lang": label("lang"),
        "source": label("source"),
        "log_size": F.least(F.floor(F.log2(row_size(F.col("text"))) * 768), F.lit(VALUES - 1)),
        "non_ascii": F.floor((F.octet_length(text) - F.length(text)) / row_size(F.col("text")) * (VALUES - 1)),
    }
    return docs.select("*", row_size(F.col("text")).alias("_size"), F.xxhash64(text).alias("_text"), *[values[d].cast("int").alias(f"_{d}") for d in DIMENSIONS])


def shared_labels(rows: DataFrame) -> DataFrame:
    """(_text, _lang1, _source1) of the groups of equal texts whose members' labels differ: their smallest ones. Counts are merged before the shuffle, so a hot group is one row a partition."""
    per = rows.groupBy("_text").agg(*[f(f"_{x}").alias(f"_{x}{i}") for x in LABELS for i, f in ((1, F.min), (2, F.max))])
    return per.where(" OR ".join(f"_{x}1 <> _{x}2" for x in LABELS)).select("_text", *[f"_{x}1" for x in LABELS])


def keyed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """metadata's rows plus one 47-bit sort key per dimension; labels: a written table of shared_labels, broadcast up to LABEL_ROWS rows."""
    low = F.shiftrightunsigned("_text", 32)
    joined = rows.join(broadcast_if_small(labels, LABEL_ROWS), "_text", "left")
    value = lambda d: F.coalesce(f"_{d}1", f"_{d}") if d in LABELS else F.col(f"_{d}")
    return joined.select(*rows.columns, *[F.shiftleft(value(d).cast("long"), 32).bitwiseOR(low).alias(f"_k{i}") for i, d in enumerate(DIMENSIONS)])


def literal(values: list) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def route(tree: Split | int, n_keys: int) -> Column:
    """The leaf of a row with keys _k0, _k1 and so on: a walk down the tree's node table, a few steps a row."""
    table: list[list[int]] = []

    def add(node: Split | int) -> int:
        at = len(table)
        table.append([-1, 0, 0, 0] if not isinstance(node, int) else [-1, node, 0, 0])
        if not isinstance(node, int):
            table[at] = [node.dimension, node.cut, add(node.left), add(node.right)]
        return at

    def depth(node: Split | int) -> int:
        return 0 if isinstance(node, int) else 1 + max(depth(node.left), depth(node.right))

    add(tree)
    dim, cut, left, right = (literal([row[i] for row in table]) for i in range(4))
    keys = f"array({', '.join(f'_k{i}' for i in range(n_keys))})"
    step = f"CASE WHEN {dim}[n] < 0 THEN n WHEN {keys}[{dim}[n]] < {cut}[n] THEN cast({left}[n] AS int) ELSE cast({right}[n] AS int) END"
    walk = f"aggregate(sequence(0, {depth(tree)}), 0, (n, i) -> {step})"
    return F.expr(f"cast({cut}[{walk}] AS int)")


FOLD = (
    "aggregate(parts, named_struct('used', 0L, 'cut', cast(null AS bigint), 'words', 0L), (s, x) -> CASE WHEN s.cut IS NOT NULL THEN s "
    "WHEN s.used + x.words <= need THEN named_struct('used', s.used + x.words, 'cut', cast(null AS bigint), 'words', 0L) "
    "ELSE named_struct('used', s.used, 'cut', x.slot, 'words', x.words) END)"
)


def leaves(rows: DataFrame, target_bytes: int) -> int:
    """How many leaves the tree needs so that none aims at more than target_bytes. rows: _size."""
    return max(1, -(-(rows.agg(F.sum("_size")).first()[0] or 0) // target_bytes))


def grow(rows: DataFrame, n: int, shards: int, close: float = 0.01) -> Split | int:
    """The tree over rows (_size and n keys _k0, _k1 and so on). A cut may miss by close of a leaf's bytes, and by more where a group of equal texts is in the way: it moves to the group's nearer edge."""
    leaf = (rows.agg(F.sum("_size")).first()[0] or 0) / shards
    keys = [f"_k{i}" for i in range(n)]
    done: dict[tuple[int, int], tuple[int, int]] = {}
    level, world = [(0, shards)], None
    while level := [x for x in level if x[1] - x[0] > 1]:
        here = rows.withColumn("node", route(partial(done, 0, shards), n)).where(F.col("node").isin([lo for lo, _ in level]))
        share = {lo: ((lo + hi) // 2 - lo) / (hi - lo) for lo, hi in level}
        shift = sum(DIGITS) - DIGITS[0]
        # The first digit, for every dimension: widths, bytes, and where the quantile lies.
        bins = here.select("node", "_size", F.posexplode(F.array(*keys)).alias("dim", "_key")).groupBy("node", "dim", F.shiftrightunsigned("_key", shift).alias("slot")).agg(F.sum("_size").alias("words"))
        per = bins.groupBy("node", "dim").agg(F.array_sort(F.collect_list(F.struct("slot", "words"))).alias("parts"), F.sum("words").alias("w"), F.when(F.col("dim") < len(LABELS), F.count("*") - 1).otherwise(F.max("slot") - F.min("slot")).alias("width"))
        per = per.withColumn("need", F.col("w") * F.expr(f"array({', '.join(f'{share.get(k, 0.0)!r}D' for k in range(shards))})[node]"))
        found = {(r.node, r.dim): r for r in per.select("node", "dim", "w", "width", "need", F.expr(FOLD).alias("end")).collect()}
        if world is None and found:
            world = [max(1, found[0, i].width) for i in range(n)]
        dims, want, prefix, before, cut = {}, {}, {}, {}, {}

        def narrow(k, end, shift, bits):
            """Follow node k's quantile into the digit where it lies; the cut is set where that is close enough."""
            if end.cut is None:
                cut[k] = (prefix[k] + 1) << (shift + bits)
                return
            prefix[k] = (prefix[k] << bits) | end.cut
            before[k] += end.used
            if end.words <= close * leaf or shift == 0:
                cut[k] = (prefix[k] + ((want[k] - before[k]) * 2 > end.words)) << shift

        for lo, hi in level:
            if (lo, 0) not in found:
                done[lo, hi] = (0, 0)
                continue
            dims[lo] = max(range(n), key=lambda i: (found[lo, i].width / world[i], -i))
            r = found[lo, dims[lo]]
            want[lo], prefix[lo], before[lo] = r.need, 0, 0
            narrow(lo, r.end, shift, DIGITS[0])
        for bits in DIGITS[1:]:
            shift -= bits
            open_ = [k for k in dims if k not in cut]
            if not open_:
                break
            at = literal([prefix[k] if k in open_ else -1 for k in range(shards)])
            need = ", ".join(f"{float(want[k] - before[k]) if k in open_ else 0.0!r}D" for k in range(shards))
            key = F.expr(f"array({', '.join(keys)})[{literal([dims.get(k, 0) for k in range(shards)])}[node]]")
            digit = F.shiftrightunsigned("_key", shift).bitwiseAND(F.lit((1 << bits) - 1))
            open_rows = here.where(F.col("node").isin(open_)).withColumn("_key", key).where(F.shiftrightunsigned("_key", shift + bits) == F.expr(f"{at}[node]"))
            bins = open_rows.groupBy("node", digit.alias("slot")).agg(F.sum("_size").alias("words"))
            per = bins.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("slot", "words"))).alias("parts")).withColumn("need", F.expr(f"array({need})[node]"))
            for r in per.select("node", F.expr(FOLD).alias("end")).collect():
                narrow(r.node, r.end, shift, bits)
        for lo, hi in level:
            if lo in dims:
                done[lo, hi] = (dims[lo], cut[lo])
        level = [half for lo, hi in level for half in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
    return partial(done, 0, shards)


def partial(done: dict, lo: int, hi: int) -> Split | int:
    """The tree so far; a node that isn't split yet goes by its lowest leaf."""
    if (lo, hi) not in done:
        return lo
    mid = (lo + hi) // 2
    return Split(*done[lo, hi], partial(done, lo, mid), partial(done, mid, hi))


@dataclass
class ShardPlan:
    """A finished tree, and the shared labels of the copies that differ in theirs (a written table)."""

    tree: Split | int
    labels: DataFrame


def plan_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None) -> ShardPlan:
    """The tree for docs: a pass for the metadata and small passes for the cuts. shards None: as many leaves as target_bytes asks for."""
    names = ["_size", "_text", *[f"_{d}" for d in DIMENSIONS]]
    rows = materialize(metadata(docs.select("doc_id", "text", "lang", "source")).select(*names), "shard-metadata")
    labels = materialize(shared_labels(rows), "shard-labels")
    keys = materialize(keyed(rows, labels).select("_size", *[f"_k{i}" for i in range(len(DIMENSIONS))]), "shard-keys")
    return ShardPlan(grow(keys, len(DIMENSIONS), shards or leaves(keys, target_bytes)), labels)


def kd_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None) -> DataFrame:
    """docs plus shard (int).

    Needs doc_id, text, lang and source. A leaf aims at an equal part of all bytes (UTF-8 bytes of the
    text plus 16 a row; null text: 16), given as a number of shards or, with shards None, as target_bytes.
    Equal texts always go to one shard, whatever their labels and their number; a group that outweighs a leaf
    makes that shard heavier than the rest (balance reports by how much). Null labels have a place of their own. Fewer rows than shards leave shards empty; an empty
    table gives no rows. Extra columns are kept; one called shard gives way.
    """
    return apply_tree(docs, plan_shards(docs, shards, target_bytes))


def apply_tree(docs: DataFrame, made: ShardPlan) -> DataFrame:
    """docs plus shard by a finished tree: one expression, behind a broadcast join while few groups of copies differ in their labels."""
    rows = keyed(metadata(docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang", "source")), made.labels)
    return rows.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c != "shard"], route(made.tree, len(DIMENSIONS)).cast("int").alias("shard"))


def balance(sharded: DataFrame) -> DataFrame:
    """One row: rows, bytes, shards that have rows, and the smallest and largest shard's bytes over the mean of these."""
    per = sharded.groupBy("shard").agg(F.count("*").alias("n"), F.sum(row_size(F.col("text"))).alias("b"))
    return per.agg(F.sum("n").alias("rows"), F.sum("b").alias("bytes"), F.count("*").alias("shards"), (F.min("b") / F.avg("b")).alias("least"), (F.max("b") / F.avg("b")).alias("most"))


def with_slots(sharded: DataFrame, order: list[str], buckets: int = 64) -> DataFrame:
    """sharded plus slot: gapless from 0 in each shard.

    A shard's rows are numbered in buckets by hash, in parallel; a bucket starts where the ones before
    it end. Bucket counts (shards x buckets rows) are the only global state.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    rows = sharded.drop("slot").withColumn("_bucket", bucket)
    per = rows.groupBy("shard", "_bucket").count().groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("_bucket", "count"))).alias("parts"))
    starts = per.select("shard", F.posexplode("parts").alias("at", "part"), "parts").select("shard", F.col("part._bucket").alias("_bucket"), F.expr("aggregate(slice(parts, 1, at), 0L, (t, x) -> t + x.count)").alias("_start"))
    starts = broadcast_if_small(materialize(starts, "shard-starts"), 100_000)
    number = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_n", number).join(starts, ["shard", "_bucket"]).withColumn("slot", F.col("_n") + F.col("_start")).drop("_bucket", "_n", "_start")


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: where every document goes, without its text."""
    placed = kd_shards(docs.select("doc_id", "text", "lang", "source"), shards)
    narrow = materialize(placed.select("doc_id", row_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), "shard"), "shard-rows")
    return with_slots(narrow, ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
