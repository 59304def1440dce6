import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwise.llm import mixing, sharding
from strandwise.llm.common import word_count


def test_shards_of_awkward_rows(awkward):
    want = Counter((r.doc_id, r.text) for r in awkward.collect())
    got = sharding.with_slots(sharding.kd_shards(awkward, 4), ["doc_id"]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and set(per) <= set(range(4))
    assert set(awkward.columns) == set(got[0].asDict())


def test_digest_and_balance(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('wört ', cast(id % 97 AS int))").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    out = sharding.shard_digest(docs, 8).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    # 97 different texts, about 41 copies each: shards differ by no more than a group or so.
    lump = out.groupby("text_crc32")["size"].sum().max()
    assert len(out) == 4000 and len(sizes) == 8 and abs(sizes - sizes.mean()).max() < lump
    free = sharding.shard_digest(docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string"))), 8).toPandas().groupby("shard")["size"].sum()
    assert len(free) == 8 and free.max() / free.mean() < 1.03 and free.min() / free.mean() > 0.97
    assert out.grown_shard.isna().all() and set(out.law) == {"bytes"}
    text = "wört " * 5
    row = out[out.doc_id == 5].iloc[0]
    assert row["size"] == len(text.encode()) + 16 and row.text_crc32 == zlib.crc32(text.encode())


def test_copies_share_a_shard(spark):
    """Copies with different labels, and a group that outweighs a shard."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat(chr(97 + cast(id % 26 AS int)), 30 + cast(id % 500 AS int))").alias("text"), F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("lang"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"))
    out = sharding.kd_shards(docs, 8).toPandas()
    assert (out.groupby("text").shard.nunique() > 1).sum() == 0 and out.shard.nunique() == 8
    hot = docs.union(spark.range(3000).select(F.col("id") + 5000, F.expr("repeat('hot', 90)"), F.lit("l1"), F.lit(None).cast("string")))
    out = sharding.kd_shards(hot, 8).toPandas()
    sizes = out.text.str.len().add(16).groupby(out.shard).sum()
    split = out.groupby("text").shard.nunique()
    assert split.max() == 1 and len(out) == 6000 and sizes.max() - (90 * 3 + 16) * 3000 < 0.25 * sizes.sum()
    report = sharding.balance(sharding.kd_shards(hot, 8)).first()
    assert report.rows == 6000 and report.bytes == sizes.sum() and abs(report.most - sizes.max() / sizes.mean()) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_no_group_of_equal_texts_is_split(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    placed = sharding.kd_shards(docs)
    assert placed.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    report = sharding.balance(placed).first()
    assert report.shards == 40 and report.most < (4 if sf == "sf0.001" else 1.5)


def test_tree_against_its_definition(spark, small):
    """Every split of the tree: the widest dimension, the weighted quantile; every row: the leaf that a walk down the tree gives."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    made = sharding.plan_shards(docs, 7)
    n = len(sharding.DIMENSIONS)
    rows = [r.asDict() for r in sharding.keyed(sharding.metadata(docs), made.labels).collect()]
    group = {}
    for r in rows:
        group.setdefault(r["text"] or "", []).append(r)
    for same in group.values():
        assert all(r["_k0"] == min(x["_lang"] for x in same) << 32 | r["_k0"] & (1 << 32) - 1 and len({x["_k0"] for x in same}) == 1 and r["_k1"] >> 32 == min(x["_source"] for x in same) for r in same)
    leaf, shift = sum(r["_size"] for r in rows) / 7, sum(sharding.DIGITS) - sharding.DIGITS[0]
    slots = lambda x, i: {r[f"_k{i}"] >> shift for r in x}
    width = lambda x, i: len(slots(x, i)) - 1 if sharding.DIMENSIONS[i] in sharding.LABELS else max(slots(x, i)) - min(slots(x, i))
    world, place = [max(1, width(rows, i)) for i in range(n)], {}

    def walk(node, mine, lo, hi):
        if hi - lo == 1:
            place.update((id(r), node) for r in mine)
            return
        spread = [width(mine, i) / world[i] for i in range(n)]
        assert node.dimension == spread.index(max(spread))
        left = [r for r in mine if r[f"_k{node.dimension}"] < node.cut]
        right = [r for r in mine if r[f"_k{node.dimension}"] >= node.cut]
        mid = (lo + hi) // 2
        aim = sum(r["_size"] for r in mine) * (mid - lo) / (hi - lo)
        # Nearer the aim than half of what lies at the cut; a document or group of copies cannot be cut finer.
        lump = max(sum(r["_size"] for r in x) for x in group.values())
        assert abs(sum(r["_size"] for r in left) - aim) <= max(0.01 * leaf, lump)
        walk(node.left, left, lo, mid)
        walk(node.right, right, mid, hi)

    walk(made.tree, rows, 0, 7)
    assert {(r.doc_id, r.text): r.shard for r in sharding.apply_tree(docs, made).collect()} == {(r["doc_id"], r["text"]): place[id(r)] for r in rows}


def test_target_bytes_decide_the_number_of_leaves(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    total = docs.agg(F.sum(sharding.row_size(F.col("text")))).first()[0]
    out = sharding.kd_shards(docs, None, target_bytes=total // 5 + 1)
    sizes = {r.shard: r.b for r in out.groupBy("shard").agg(F.sum(sharding.row_size(F.col("text"))).alias("b")).collect()}
    biggest = docs.agg(F.max(sharding.row_size(F.col("text")))).first()[0]
    assert set(sizes) == set(range(5)) and max(sizes.values()) <= total / 5 + biggest


def test_one_row_many_shards_and_none(awkward, nothing):
    assert sharding.shard_digest(awkward.limit(1), 40).count() == 1
    assert sharding.shard_digest(nothing, 40).count() == 0


def water_fill(sizes, weights, total):
    targets, left, open_ = {}, total, dict(weights)
    while True:
        level = left / sum(open_.values()) if open_ else 0
        over = [s for s in open_ if open_[s] * level > 2 * sizes[s]]
        if not over:
            return targets | {s: w * level for s, w in open_.items()}
        for s in over:
            targets[s] = 2 * sizes[s]
            left -= targets[s]
            del open_[s]


def test_targets_and_taken(small, spark):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = mixing.mix_counts(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    sizes = out.groupby("source")["size"].sum().to_dict()
    names = sorted(sizes, key=lambda s: s.encode())
    want = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for s, g in out.groupby("source"):
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 * want[s]
        assert abs(g.taken.sum() - want[s]) <= max(g["size"].max(), 0.03 * want[s])
        assert (g.taken <= 2 * g["size"]).all() and (g.source_size == sizes[s]).all()
    again = mixing.mix_counts(docs.repartition(5)).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(out.doc_id, out.taken))


def test_mix_rows_agree_with_counts(awkward, nothing):
    spec = mixing.MixSpec(shards=3, blocks=8, block_rows=4)
    counts = mixing.mix_counts(awkward, spec)
    assert counts.count() == awkward.count()
    mixed = mixing.mix(awkward, spec)
    taken = counts.agg(F.sum("taken")).first()[0]
    assert mixed.select(F.sum(word_count(F.col("text")))).first()[0] == taken
    assert {r.mix_shard for r in mixed.select("mix_shard").distinct().collect()} <= {0, 1, 2}
    assert mixing.shuffled_shards(mixed).count() == mixed.count()
    assert mixing.mix_counts(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_split_tree_is_exact(spark):
    quotas = spark.createDataFrame([(1, 700), (2, 0), (3, 41), (4, 3)], "idx int, q long")
    out = mixing.split_tree(quotas, mixing.MixSpec(shards=7)).toPandas()
    assert out.groupby("idx").q.sum().to_dict() == {1: 700, 2: 0, 3: 41, 4: 3}
    per = out.groupby("shard").q.sum()
    assert len(per) == 7 and per.max() - per.min() <= 3
    spread = out[out.idx == 3].q
    assert spread.max() < 20 and (out.q >= 0).all()


def fold(parts, need):
    """Whole parts, in order, while they fit: (words used, the first part that does not fit)."""
    used = 0
    for at, words in parts:
        if used + words > need:
            return used, at
        used += words
    return used, None


def expected_draws(docs, plan, spec):
    """(times drawn) of each document by the definition, one source at a time. docs: id -> (source index, size, hash)."""
    slot = lambda h, n, shift: ((h >> shift) & (1 << 31) - 1) * n >> 31
    want = {}
    for idx, target, n_blocks in plan:
        mine = {i: (n, h & (1 << 64) - 1) for i, (x, n, h) in docs.items() if x == idx}
        size = sum(n for n, _ in mine.values())
        passes = int(target // size) if size else 0
        need = target - passes * size
        want |= dict.fromkeys(mine, passes)
        if need <= 0:
            continue
        blocks = Counter()
        for n, h in mine.values():
            blocks[slot(h, n_blocks, 33)] += n
        used, cut = fold(sorted(blocks.items()), need)
        in_cut = {i: h for i, (n, h) in mine.items() if slot(h, n_blocks, 33) == cut}
        n_parts = max(1, min(spec.blocks, len(in_cut) // spec.block_rows))
        parts = Counter()
        for i, h in in_cut.items():
            parts[slot(h, n_parts, 2)] += mine[i][0]
        more, last = fold(sorted(parts.items()), need - used)
        left = need - used - more
        drawn = {i for i, (n, h) in mine.items() if slot(h, n_blocks, 33) < cut} | {i for i, h in in_cut.items() if slot(h, n_parts, 2) < last}
        place = lambda i: (slot(mine[i][1], n_blocks, 33), slot(mine[i][1], n_parts, 2) if i in in_cut else 0, mine[i][1] - (mine[i][1] >> 63 << 64), i)
        rest = sorted((i for i in mine if i not in drawn and 0 < mine[i][0] < 2 * left), key=place)
        skipped = []
        for i in rest:
            if mine[i][0] <= left:
                left -= mine[i][0]
                drawn.add(i)
            else:
                skipped.append(i)
        over = [(abs(mine[i][0] - left), i) for i in skipped if mine[i][0] < 2 * left]
        drawn |= {min(over)[1]} if over else set()
        for i in drawn:
            want[i] += 1
    return want


@pytest.mark.parametrize("fill", [256, 3])
def test_draws_and_quotas_against_brute_force(spark, fill):
    """Sources of 1 to 1,500 documents by one rule: every document's draws, and every shard's block draws against the tree's quotas."""
    import random

    rng = random.Random(21)
    rows = [(k * 10_000 + i, f"s{k}", " ".join(["w"] * min(400, int(rng.paretovariate(0.8))))) for k, n in enumerate((1, 2, 7, 60, 400, 1500)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    spec = mixing.MixSpec(shards=5, blocks=64, block_rows=4, fill=fill)
    out = mixing.mix_counts(docs, spec).toPandas().set_index("doc_id")
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mixing.permuted(spec).alias("h"))
    made = mixing.plan(sizes.drop("h"), spec)
    sources = {r.source: r for r in made.sources.collect()}
    table = {r.doc_id: (sources[r.source].idx, r.size, r.h) for r in sizes.collect()}
    want = expected_draws(table, [(r.idx, r.target, r.n_blocks) for r in sources.values()], spec)
    assert {i: len(x) for i, x in out.shard_draws.items()} == want
    assert (out.taken == out["size"] * out.shard_draws.map(len)).all()
    # A block goes whole to one shard a draw, the tree's quotas are met exactly, and a mixed row is where its draw is.
    deals = Counter((r.idx, d.shard) for r in made.blocks.collect() for d in r.draws) + Counter((r.idx, r.rest_shard) for r in sources.values() if r.rest_shard is not None)
    total = [(r.idx, sum(n for (i, _), n in deals.items() if i == r.idx)) for r in sources.values()]
    quotas = {(r.idx, r.shard): r.q for r in mixing.split_tree(spark.createDataFrame(total, "idx int, q long"), spec).collect() if r.q}
    assert dict(deals) == quotas
    mixed = Counter((r.doc_id, r.mix_shard) for r in mixing.mix(docs, spec).select("doc_id", "mix_shard").collect())
    assert mixed == Counter((i, s) for i, x in out.shard_draws.items() for s in x)


def test_a_source_is_filled_beyond_the_first_round(spark):
    """A document too long to fit leaves thousands of words open; all of them are filled, whatever a round looks at, and rows of one id are drawn together."""
    rows = [(0, "a", " ".join(["w"] * 6000))] + [(1 + i, "a", "three short words") for i in range(1500)] + [(1501 + i // 2, "a", "two words") for i in range(200)]
    docs = spark.createDataFrame([*rows, *[(9000 + i, "b", "w") for i in range(50)]], "doc_id long, source string, text string").repartition(3)
    got = {}
    for fill in (40, 256):
        out = mixing.mix_counts(docs, mixing.MixSpec(weights=(1,), share=0.3, max_epochs=0.5, blocks=4, fill=fill)).toPandas()
        part = out[out.source_size > 50]
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 2
        got[fill] = sorted(zip(out.doc_id.tolist(), out.taken.tolist()))
        assert all(g.taken.nunique() == 1 for _, g in out.groupby("doc_id"))
    assert got[40] == got[256]


def test_split_follows_the_hypergeometric_law(spark):
    """Mean and variance of a source's items on the left half, over seeds."""
    n, k, left = 60, 24, 30
    got = [r.q for seed in range(30) for r in mixing.split_tree(spark.createDataFrame([(1, k), (2, n - k)], "idx int, q long").coalesce(1), mixing.MixSpec(shards=2, seed=seed)).where("idx = 1 AND shard = 0").collect()]
    mean, var = left * k / n, left * k / n * (n - k) / n * (n - left) / (n - 1)
    m = sum(got) / len(got)
    assert abs(m - mean) < 4.5 * (var / len(got)) ** 0.5 and 0.3 * var < sum((x - m) ** 2 for x in got) / len(got) < 2.2 * var


def test_wrong_spec_column_free(awkward):
    with pytest.raises(Exception):
        mixing.mix_counts(awkward.drop("source"))
