"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block quotas.

Only DataFrame and SQL functions. A source's documents are permuted by hash and cut into blocks; the
target says how many whole passes and whole blocks of a source the mix draws, and one remainder draw
holds the last words: the parts of the next block that fit, and then single documents. The exact quotas
of block draws are then split among the output shards by a binary tree: at each node the left half's
count of every source is a multivariate hypergeometric draw, made item by item without replacement.
Last, each source's permuted draws are dealt to the shards by their quotas, and rows are ordered by hash
inside a shard.

Sources are a dimension: their table and the tree's nodes (one row with a number a source) are held in
one task; the single documents are broadcast up to SINGLE_ROWS of them and joined by shuffle beyond.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, word_count


@dataclass(frozen=True)
class MixSpec:
    """weights repeat over the sources in code-point order (null last); share is the mix's size as a part of all sizes; a source is repeated up to max_epochs times. blocks bounds the number of blocks over all sources (each has one at least), block_rows is the least number of documents a block or part is meant to hold. What whole blocks and parts leave over is filled with single documents in permuted order until none fits; fill of them are looked at in the first round."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    max_epochs: float = 2.0
    shards: int = 16
    blocks: int = 4096
    block_rows: int = 16
    fill: int = 256
    seed: int = 17


#: Rows up to which a table of sources or blocks, and of single documents, is broadcast; beyond, it is joined by shuffle.
PLAN_ROWS = 50_000
SINGLE_ROWS = 500_000
#: Documents of a source that a round of filling holds in one row at most.
FILL_ROWS = 4096


def permuted(spec: MixSpec) -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit(spec.seed))


def slot_of(hash_col: Column, n: Column, shift: int = 33) -> Column:
    """The hash's 31 bits below shift+31, scaled to 0..n-1; keeps the order of the hash's bits."""
    part = F.shiftrightunsigned(hash_col, shift).bitwiseAND(F.lit((1 << 31) - 1))
    return F.shiftright(part * n, 31)


def targets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, n_docs, source_size, idx, target): weights fill up to the cap, the excess is reshared by weight.

    Water filling: sources in order of cap/weight; level k assumes that all before k are at their cap.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("idx", F.row_number().over(order))
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    src = src.withColumn("weight", F.element_at(weights, F.pmod(F.col("idx") - 1, F.lit(len(spec.weights))) + 1)).withColumn("cap", F.col("source_size") * spec.max_epochs)
    every = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * spec.share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    src = src.withColumn("level", level)
    chosen = F.max(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("level"))).over(whole)
    return src.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * chosen, F.col("cap")))).select("source", "n_docs", "source_size", "idx", "target")


def boundary(parts: str, need: str) -> str:
    """Fold over an ordered array of (slot, words): whole slots while they fit; then the slot where the need ends, and what it lacks there."""
    return (
        f"aggregate({parts}, named_struct('used', 0L, 'cut', cast(null AS bigint)), (s, x) -> CASE WHEN s.cut IS NOT NULL THEN s "
        f"WHEN s.used + x.words <= {need} THEN named_struct('used', s.used + x.words, 'cut', cast(null AS bigint)) "
        f"ELSE named_struct('used', s.used, 'cut', x.slot) END)"
    )


def split_tree(quotas: DataFrame, spec: MixSpec) -> DataFrame:
    """(idx, shard, q): the block draws of each source that each output shard gets.

    quotas: (idx, q). One row a node holds the quotas of all sources; each level splits every node in
    two halves of its shards. A source's q items go left one by one with probability (places left /
    items left), which is the multivariate hypergeometric law, and all quotas stay exact.
    """
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("idx", "q"))).alias("items"))
    nodes = nodes.select(F.lit(0).alias("lo"), F.lit(spec.shards).alias("hi"), "items")
    draw = (
        "CASE WHEN x.q = 0 THEN 0L ELSE aggregate(sequence(1L, x.q), 0L, (k, j) -> k + CASE WHEN "
        f"shiftrightunsigned(xxhash64({spec.seed}, lo, hi, x.idx, j), 11) * {2.0**-53!r}D * (s.items - j + 1) < s.places - k THEN 1L ELSE 0L END) END"
    )
    fold = (
        "aggregate(items, named_struct('items', aggregate(items, 0L, (t, x) -> t + x.q), 'places', places, 'k', cast(array() AS array<bigint>)), "
        f"(s, x) -> transform(array({draw}), g -> named_struct('items', s.items - x.q, 'places', s.places - g, 'k', concat(s.k, array(g))))[0]).k"
    )
    for _ in range(max(1, spec.shards - 1).bit_length()):
        wide = nodes.withColumn("mid", F.expr("cast((lo + hi) div 2 AS int)")).withColumn("places", F.expr("aggregate(items, 0L, (t, x) -> t + x.q) * (mid - lo) div (hi - lo)"))
        wide = wide.withColumn("k", F.expr(f"CASE WHEN hi - lo > 1 THEN {fold} END"))
        kids = F.expr(
            "CASE WHEN hi - lo <= 1 THEN array(named_struct('lo', lo, 'hi', hi, 'items', items)) ELSE array("
            "named_struct('lo', lo, 'hi', mid, 'items', transform(items, (x, i) -> named_struct('idx', x.idx, 'q', k[i]))), "
            "named_struct('lo', mid, 'hi', hi, 'items', transform(items, (x, i) -> named_struct('idx', x.idx, 'q', x.q - k[i])))) END"
        )
        nodes = wide.select(F.explode(kids).alias("n")).select("n.lo", "n.hi", "n.items")
    return nodes.select(F.col("lo").alias("shard"), F.explode("items").alias("x")).select("x.idx", "shard", "x.q")


@dataclass
class MixPlan:
    """sources: a row a source, with its remainder draw (cut, last, n_parts, rest_shard); blocks: (idx, slot, draws) of whole blocks; singles: (idx, doc_id)."""

    sources: DataFrame
    blocks: DataFrame
    singles: DataFrame


def after_parts(at: DataFrame, cut: DataFrame, spec: MixSpec) -> DataFrame:
    """(idx, last, left): inside each source's cut block, the part where the need ends and the words it lacks there."""
    inside = at.join(cut, "idx").where("slot = cut").withColumn("part", slot_of(F.col("h"), F.col("n_parts"), 2))
    sums = inside.groupBy("idx", "need", F.col("part").alias("slot")).agg(F.sum("size").alias("words"))
    ends = sums.groupBy("idx", "need").agg(F.array_sort(F.collect_list(F.struct("slot", "words"))).alias("parts")).withColumn("end", F.expr(boundary("parts", "need")))
    return ends.select("idx", F.col("end.cut").alias("last"), (F.col("need") - F.col("end.used")).alias("left"))


def single_documents(at: DataFrame, cut: DataFrame, spec: MixSpec) -> DataFrame:
    """(idx, doc_id): what fills a source's last words, one by one in permuted order, until no document that follows fits.

    cut: (idx, cut, n_parts, last, left), a row a source. A round looks at the next documents that are no
    larger than what is left, spec.fill of them and four times as many in each later round up to FILL_ROWS;
    how many does not change what is drawn. Last, one more document is taken where overshooting by it
    misses the target by less than leaving it out. Rows that share a doc_id count as one document.
    """
    rest = at.join(cut, "idx").withColumn("part", F.when(F.col("slot") == F.col("cut"), slot_of(F.col("h"), F.col("n_parts"), 2)).otherwise(0))
    rest = rest.where("slot > cut OR (slot = cut AND part >= last)").groupBy("idx", "left", "slot", "part", "h", "doc_id").agg(F.sum("size").alias("words"))
    rest = materialize(rest.where("words > 0 AND words < 2 * left").select("idx", F.struct("slot", "part", "h", "doc_id").alias("place"), "words"), "mix-rest")
    empty = "cast(array() AS array<bigint>)"
    fit = (
        f"aggregate(docs, named_struct('left', left, 'ids', {empty}), (s, x) -> CASE WHEN x.words <= s.left "
        "THEN named_struct('left', s.left - x.words, 'ids', concat(s.ids, array(x.place.doc_id))) ELSE s END)"
    )
    state = materialize(cut.select("idx", "left", F.lit(None).cast(rest.schema["place"].dataType).alias("after")), "mix-state")
    done, drawn, rows = [], [], spec.fill
    while True:
        near = rest.join(broadcast_if_small(state, PLAN_ROWS), "idx").where("words <= left AND (after IS NULL OR place > after)")
        near = near.withColumn("_n", F.row_number().over(Window.partitionBy("idx").orderBy("place"))).where(F.col("_n") <= rows)
        docs = near.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("docs"))
        seen = state.join(docs, "idx", "left").withColumn("docs", F.coalesce("docs", F.expr("filter(array(named_struct('place', after, 'words', 0L)), x -> false)")))
        step = seen.withColumn("fit", F.expr(fit)).select("idx", "fit.left", "fit.ids", F.expr("try_element_at(docs, -1).place").alias("after"), (F.size("docs") == rows).alias("more"))
        step = materialize(step, "mix-step")
        drawn.append(step.select("idx", F.explode("ids").alias("doc_id")))
        goes_on = F.col("more") & (F.col("left") >= 1)
        done.append(step.where(~goes_on).select("idx", "left"))
        state = step.where(goes_on).select("idx", "left", "after")
        if not state.limit(1).count():
            break
        rows = min(4 * rows, max(FILL_ROWS, spec.fill))
    drawn, ends = materialize(reduce(DataFrame.union, drawn), "mix-drawn"), reduce(DataFrame.union, done).where("left > 0")
    over = rest.join(broadcast_if_small(ends, PLAN_ROWS), "idx").where("words < 2 * left").select("idx", "place.doc_id", F.abs(F.col("words") - F.col("left")).alias("miss"))
    taken = broadcast_if_small(drawn.select(F.col("idx").alias("_of"), F.col("doc_id").alias("_doc")), SINGLE_ROWS)
    over = over.join(taken, (F.col("idx") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti")
    return drawn.union(over.groupBy("idx").agg(F.min(F.struct("miss", "doc_id")).alias("best")).select("idx", "best.doc_id"))


def plan(sizes: DataFrame, spec: MixSpec) -> MixPlan:
    """What each source gives: written tables of sources, of block draws by shard, and of the documents drawn singly.

    sizes: (doc_id, source, size). One rule holds for sources of every size. All tables but that of the
    single documents are bounded by the number of sources and spec.blocks.
    """
    total = F.sum("n_docs").over(Window.partitionBy())
    n_blocks = F.greatest(F.lit(1), F.least(F.floor(F.col("n_docs") / spec.block_rows), F.floor(F.col("n_docs") * spec.blocks / total))).cast("long")
    src = targets(sizes, spec).withColumn("n_blocks", n_blocks)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    src = src.withColumn("passes", passes).withColumn("need", F.col("target") - F.col("passes") * F.col("source_size"))
    src = materialize(src, "mix-sources")
    few = broadcast_if_small(src, PLAN_ROWS)
    at = sizes.join(few, sizes.source.eqNullSafe(src.source)).select(sizes.doc_id, "idx", "size", "n_blocks").withColumn("h", permuted(spec)).withColumn("slot", slot_of(F.col("h"), F.col("n_blocks"))).drop("n_blocks")
    parts = at.groupBy("idx", "slot").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    per = parts.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("slot", "words", "n"))).alias("parts"))
    cut = src.select("idx", "passes", "need").join(per, "idx").withColumn("end", F.expr(boundary("parts", "need")))
    cut = cut.withColumn("cut", F.when(F.col("need") > 0, F.col("end.cut"))).withColumn("need", F.col("need") - F.col("end.used"))
    cut = cut.withColumn("n_parts", F.expr(f"greatest(1L, least({spec.blocks}L, coalesce(get(filter(parts, p -> p.slot = cut), 0).n, 0L) div {spec.block_rows}))"))
    cut = materialize(cut.select("idx", "parts", "passes", "cut", "need", "n_parts"), "mix-cut")
    ends = materialize(after_parts(at, broadcast_if_small(cut.where("cut IS NOT NULL").select("idx", "cut", "need", "n_parts"), PLAN_ROWS), spec), "mix-ends")
    ended = cut.select("idx", "cut", "n_parts").join(ends, "idx")
    singles = materialize(single_documents(at, broadcast_if_small(ended, PLAN_ROWS), spec), "mix-singles")
    draws = (
        f"flatten(transform(parts, p -> transform(filter(sequence(0, passes), c -> c < passes OR p.slot <= cut), "
        f"c -> named_struct('h', xxhash64({spec.seed}, idx, p.slot, c), 'slot', p.slot, 'copy', c, 'rest', coalesce(c = passes AND p.slot = cut, false)))))"
    )
    deals = cut.withColumn("draws", F.array_sort(F.expr(draws)))
    quotas = split_tree(deals.select("idx", F.size("draws").cast("long").alias("q")), spec)
    dealt = quotas.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("shard", "q"))).alias("quota"))
    deals = deals.join(dealt, "idx").withColumn("shards", F.expr("flatten(transform(quota, x -> array_repeat(x.shard, cast(x.q AS int))))"))
    deals = materialize(deals.select("idx", F.explode(F.arrays_zip("draws", "shards")).alias("x")).select("idx", "x.draws.slot", "x.draws.copy", "x.draws.rest", F.col("x.shards").alias("shard")), "mix-deals")
    blocks = deals.where("NOT rest").groupBy("idx", "slot").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("draws"))
    rest = deals.where("rest").select("idx", F.col("shard").alias("rest_shard"))
    sources = src.join(ended, "idx", "left").join(rest, "idx", "left").select("source", "idx", "n_blocks", "source_size", "target", "passes", "cut", "n_parts", "last", "rest_shard")
    return MixPlan(materialize(sources, "mix-plan"), materialize(blocks, "mix-blocks"), singles)


def with_draws(docs: DataFrame, spec: MixSpec, made: MixPlan) -> DataFrame:
    """docs plus source_size, target and mix_draws (array of copy and shard): no shuffle while the plan is small."""
    src = broadcast_if_small(made.sources.withColumnRenamed("source", "_source"), PLAN_ROWS)
    out = docs.join(src, F.col("source").eqNullSafe(F.col("_source")))
    out = out.withColumn("_slot", slot_of(permuted(spec), F.col("n_blocks"))).withColumn("_part", slot_of(permuted(spec), F.col("n_parts"), 2))
    blocks = broadcast_if_small(made.blocks.select(F.col("idx").alias("_idx"), F.col("slot").alias("_at"), "draws"), PLAN_ROWS)
    out = out.join(blocks, (F.col("idx") == F.col("_idx")) & (F.col("_slot") == F.col("_at")), "left")
    singles = broadcast_if_small(made.singles.select(F.col("idx").alias("_of"), F.col("doc_id").alias("_doc"), F.lit(True).alias("single")), SINGLE_ROWS)
    out = out.join(singles, (F.col("idx") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    none = F.expr("cast(array() AS array<struct<copy: int, shard: int>>)")
    rest = F.when(F.coalesce(F.col("single") | ((F.col("_slot") == F.col("cut")) & (F.col("_part") < F.col("last"))), F.lit(False)), F.array(F.struct(F.col("passes").alias("copy"), F.col("rest_shard").alias("shard")))).otherwise(none)
    return out.withColumn("mix_draws", F.concat(F.coalesce("draws", none), rest)).select(*[docs[c] for c in docs.columns], "source_size", "target", "mix_draws")


def mix_counts(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard_draws: one row per document row, drawn or not.

    shard_draws holds the output shard of each of the row's draws, as the splitting tree dealt them.

    Size is the number of words (null text: 0). A null source is a source of its own, ordered last. A
    null doc_id and repeated ids are drawn together. Rows of size 0 are dealt like any other and take
    nothing. An empty table gives no rows. Results depend on the data and the seed only.
    """
    sizes = materialize(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    made = plan(sizes, spec)
    return with_draws(sizes, spec, made).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("mix_draws")).alias("taken"), F.col("mix_draws.shard").alias("shard_draws"))


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The mixed rows: docs' columns, one row per draw, plus mix_shard, mix_copy and mix_order.

    Columns of docs with one of these three names give way; all others are kept as they are. The text is
    read once for its words and once for the draws, and never shuffled. Nulls, ties and empty tables are
    as in mix_counts.
    """
    ids = [F.col("doc_id").cast("long").alias("doc_id"), "source"]
    made = plan(materialize(docs.select(*ids, word_count(F.col("text")).alias("size")), "mix-sizes"), spec)
    out = with_draws(docs.select(F.struct("*").alias("_row"), *ids), spec, made).select("_row", "doc_id", F.explode("mix_draws").alias("_draw"))
    order = F.xxhash64("doc_id", "_draw.copy", F.lit(spec.seed + 1))
    keep = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("mix_shard", "mix_copy", "mix_order")]
    return out.select(*keep, F.col("_draw.shard").alias("mix_shard"), F.col("_draw.copy").alias("mix_copy"), order.alias("mix_order"))


def shuffled_shards(mixed: DataFrame, pieces: int = 64) -> DataFrame:
    """The local shuffle: each shard's rows in hash order, a shard dealt over several sorted pieces."""
    piece = F.pmod(F.shiftright("mix_order", 40), F.lit(pieces))
    return mixed.repartition("mix_shard", piece).sortWithinPartitions("mix_shard", "mix_order")
