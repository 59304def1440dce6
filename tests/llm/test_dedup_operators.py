import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandwise.llm import neardup, simhash, suffix
from strandwise.llm.common import connected_components


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_fingerprint_by_definition():
    rng = random.Random(1)
    for _ in range(50):
        words = [rng.choice(["Ab", "c", "É", "d e", "x"]) for _ in range(rng.randint(0, 30))]
        text = rng.choice([" ", "\t", "\x0b"]).join(words)
        low = [w.encode().lower() for w in words]
        shingles = [b" ".join(low[i : i + 3]) for i in range(max(1, len(low) - 2))] if low else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int(simhash.fingerprint(simhash.shingle_hashes(text, 3))[0]) == want
    assert simhash.fingerprint(simhash.shingle_hashes(None, 3))[0] == 0


@pytest.mark.parametrize("cap", [64, 2])
def test_links_against_brute_force(spark, cap, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_CAP", cap)
    monkeypatch.setattr(simhash.runs_to_pairs, "__defaults__", (cap, simhash.RADIUS))
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    for f in fps[:40]:
        for _ in range(4):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            g = f
            for b in bits:
                g ^= 1 << int(b)
            fps.append(g - (1 << 64) if g >= 1 << 63 else g if g >= -(1 << 63) else g + (1 << 64))
    fps = sorted(set(fps) | {0, 1, 3, 7})
    u = np.array(fps, np.int64).view(np.uint64)
    linked = [(a, b) for i, a in enumerate(fps) for j, b in enumerate(fps[:i]) if np.bitwise_count(u[i] ^ u[j]) <= 2]
    want = components(fps, linked)
    got, degrees = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    have = components(fps, [(r.a, r.b) for r in got.collect()])
    same = lambda c: {frozenset(k for k in c if c[k] == v) for v in set(c.values())}
    assert same(have) == same(want)
    assert {r.fp: r.n_links for r in degrees.collect()} == dict(Counter(x for p in linked for x in p))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(-50, 50), rng.randint(-50, 50)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    nodes = {n for e in edges for n in e}
    want = components(nodes, edges)
    smallest = {n: min(m for m in nodes if want[m] == want[n]) for n in nodes}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == smallest[n] for n in nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_awkward(awkward, nothing):
    out = simhash.simhash_components(awkward).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    assert len(out) == awkward.count() and by[100].fingerprint == by[101].fingerprint == "0" * 16
    assert by[103].component_id == by[104].component_id == 0 and by[100].component_id == by[102].component_id == 100
    assert simhash.simhash_components(nothing).count() == 0


def test_near_duplicates(spark, make, awkward, nothing):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(15)]
    texts, group = [], []
    for g, words in enumerate(base):
        for edits in (0, 1, 2, 0):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "new" + str(rng.random())
            texts.append(" ".join(w))
            group.append(g)
    got = {r.doc_id: r.keeper for r in neardup.near_duplicate_groups(make(texts)).collect()}
    assert got == {i: group.index(g) for i, g in enumerate(group)}
    crowd = [" ".join(base[0][:k] + ["odd" + str(k)] + base[0][k + 1 :]) for k in range(150)]
    assert len({r.keeper for r in neardup.near_duplicate_groups(make(crowd), neardup.NearDupSpec(cap=16, block=64)).collect()}) == 1
    kept = neardup.drop_near_duplicates(awkward)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 103 not in ids and 104 not in ids and ids.count(None) == 2 and kept.columns == awkward.columns
    assert neardup.drop_near_duplicates(nothing).count() == 0


def test_near_duplicates_behind_nearer_templates(make):
    """Partners at J >= 0.8 among templated texts below it: all groups as by brute force, in small cells and in cells dealt by blocks."""
    rng = random.Random(12)
    template = [f"t{i}" for i in range(300)]
    texts = []
    for k in range(60):
        at = rng.randrange(230)
        own = template[:at] + [f"own{k}x{i}" for i in range(38 + k % 12)] + template[at + 38 :]
        texts.append(" ".join(own))
        if k % 4 == 0:
            texts.append(" ".join(w for i, w in enumerate(own) if i not in {at // 2, 60 + at // 2, 170, 210, 250, 290}))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if alike(a, b) >= 0.8]
    want = components(range(len(texts)), linked)
    smallest = {n: min(m for m in want if want[m] == want[n]) for n in want}
    assert len(set(smallest.values())) > 20 and len(linked) >= 15
    for spec in (neardup.NearDupSpec(bands=16, bits=1, most_far=32), neardup.NearDupSpec(bands=16, bits=1, most_far=32, cap=4, block=8)):
        assert {r.doc_id: r.keeper for r in neardup.near_duplicate_groups(make(texts), spec).collect()} == smallest


def test_near_duplicates_by_the_simhash_grid(make):
    """Similar pairs within the operator's radius are linked where no band brings them together; unlike ones within it are not."""
    rng = random.Random(61)
    texts = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
        texts += [" ".join(words), " ".join(words[:450] + [f"new{k}"] + words[451:])]
    texts += [" ".join(["same"] * 400 + [f"own{k}x{i}" for i in range(8)]) for k in range(2)]
    prints = [int(simhash.fingerprint(simhash.shingle_hashes(t, 5))[0]) for t in texts]
    within = [i for i in range(0, len(texts), 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 2]
    assert len(within) > 10 and within[-1] == len(texts) - 2
    got = {r.doc_id: r.keeper for r in neardup.near_duplicate_groups(make(texts), neardup.NearDupSpec(bits=40, bands=1, first_bands=1)).collect()}
    assert all(got[i + 1] == i for i in within[:-1]) and got[len(texts) - 1] == len(texts) - 1


@pytest.mark.parametrize("full", [False, True])
def test_every_pair_within_the_radius_meets_in_the_grid(spark, full):
    """grid_cells against all pairs of the first lane, ids of equal fingerprints included; in full cells, by rare shingles."""
    rng = np.random.default_rng(62)
    prints = [int(x) for x in rng.integers(-(2**62), 2**62, 12)]
    for _ in range(88):
        prints.append(prints[int(rng.integers(0, len(prints)))] ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 3)), replace=False)))
    classes = spark.createDataFrame([(i, i, p, 0, 0, 0) for i, p in enumerate(prints)], "id long, root long, f0 long, f1 long, f2 long, f3 long")
    spec = neardup.NearDupSpec(block=4 if full else 1024)
    sets = spark.createDataFrame([(i, np.arange(20, dtype=np.uint32).tobytes()) for i in range(len(prints))], "id long, shingles binary")
    held = neardup.members(neardup.grid_cells(classes).repartition("key").sortWithinPartitions("key"), spec, lambda ids: neardup.materialize(sets.join(ids, "id"), "sets"))
    groups = {}
    for r in held.collect():
        groups.setdefault((r.key, r.i, r.j), set()).add(r.id)
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    want = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2}
    assert met >= want and len(want) > 100


def test_lanes_do_not_part_what_meets_by_a_rare_shingle():
    """Under a rare shingle a document's lane may be another band's than its partner's: the similarity alone decides there."""
    shingles = np.arange(40, dtype=np.uint32).tobytes()
    names = [*neardup.NAMES, "shingles"]
    for key, want in ((-7, [(1, 2)]), (7, [])):
        rows = [[key, 0, 0, 0, 1, 0, 1, shingles], [key, 0, 0, 0, 2, -1, 2, shingles]]
        out = neardup.verified_cells([pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])], neardup.NearDupSpec())
        assert [(r["a"], r["b"]) for b in out for r in b.to_pylist()] == want


@pytest.mark.parametrize("block", [4096, 50, 7])
def test_every_pair_of_a_cell_meets(spark, block):
    """Members with a partner, in whole cells and in cells dealt by pairs of blocks: every near pair of different roots stands in one group."""
    rng = np.random.default_rng(8)
    rows = []
    for key, n in ((1, 1), (2, 40), (3, 300), (4, 7), (5, 8), (6, 101)):
        for lane in rng.integers(-(2**63), 2**63, n):
            rows.append((key, len(rows), int(lane), int(rng.integers(0, 20))))
    spec = neardup.NearDupSpec(most_far=28, cap=16, block=block)
    far = lambda x, y: (x ^ y).bit_count() if x ^ y >= 0 else 64 - (~(x ^ y)).bit_count()
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[3] != y[3] and far(x[2], y[2]) <= 28}
    for size in ("10000", "9"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        cells = spark.createDataFrame(rows, "key long, id long, lane long, root long").repartition(3, "key").sortWithinPartitions("key")
        groups = {}
        for r in neardup.members(cells, spec).collect():
            groups.setdefault((r.key, r.i, r.j), []).append((r.id, r.block))
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        met = Counter((min(a, b), max(a, b)) for (_, i, j), g in groups.items() for n, (a, x) in enumerate(g) for b, y in g[:n] if i == j or x != y)
        assert set(met) >= want and max(met.values()) == 1 and len(want) > 1000 and all(len(g) <= 2 * max(block, 7) for g in groups.values())


def test_rare_shingles_bring_every_similar_pair_together(spark):
    """prefixes against all pairs: whatever is similar enough shares a kept shingle; templates below it hardly meet."""
    rng = np.random.default_rng(17)
    template = np.arange(200)
    sets = []
    for k in range(60):
        own = np.concatenate([rng.permutation(template)[: int(rng.integers(150, 180))], 1000 + 100 * k + np.arange(25)])
        sets.append(own)
        if k % 5 == 0:
            sets.append(np.concatenate([own[: len(own) - 4], [90_000 + k]]))
    sets = [np.unique(x).astype(np.uint32) for x in sets]
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "id long, shingles binary")
    kept = {}
    for r in neardup.prefixes(table, neardup.NearDupSpec()).collect():
        kept.setdefault(r.id, set()).add(r.shingle)
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    near = [(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])]
    assert len(near) >= 12 and all(kept[a] & kept[b] for a, b in near)
    assert all(len(kept.get(i, ())) <= len(x) - np.ceil(0.8 * len(x)) + 1 for i, x in enumerate(sets))


def test_rows_of_a_full_cell_are_linear(spark, make):
    """One cell of templated texts below the similarity: rows stay in proportion to the documents, and the few real pairs are found."""
    rng = random.Random(41)
    template = [f"t{i}" for i in range(60)]
    counts = {}
    for n in (300, 1200):
        texts = []
        for k in range(n):
            at = rng.randrange(60)
            texts.append(" ".join(template[at:] + template[:at]) + " " + " ".join(f"own{k}x{i}" for i in range(45)))
        texts += [t + " end" for t in texts[:20]]
        docs, spec = make(texts), neardup.NearDupSpec(bits=1, bands=2, first_bands=1, most_far=64, block=64, cap=8)
        classes = spark.createDataFrame([(i, i, *(rng.getrandbits(63) & ~1 for _ in range(4))) for i in range(len(texts))], "id long, root long, f0 long, f1 long, f2 long, f3 long")
        cells = neardup.cells(classes, spec, 2).withColumn("key", F.lit(7).cast("long")).distinct()
        held = neardup.members(cells.repartition("key").sortWithinPartitions("key"), spec, lambda ids: neardup.wanted_sets(docs, ids, spec))
        together = {}
        for r in held.collect():
            together.setdefault((r.key, r.i, r.j), set()).add(r.id)
        counts[n] = held.count()
        assert all(any({i, n + i} <= g for g in together.values()) for i in range(20))
    assert counts[1200] < 6 * counts[300] and counts[1200] < 40 * 1200


def test_bits_grow_with_the_texts():
    spec = neardup.NearDupSpec()
    assert spec.sized(1000) == spec and spec.sized(200_000) == spec
    grown = spec.sized(20_000_000_000)
    assert grown.bits == 37 and 0.9 < grown.bands * 0.85**grown.bits / (spec.bands * 0.85**spec.bits) < 1.1


def test_one_row_of_an_id_stays_and_always_the_same(spark):
    rows = [(1, f"text number {i} of one id", "x") for i in range(30)] + [(2, "alone here", "y"), (None, "no id", "z"), (3, "same", "p"), (3, "same", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, second = (sorted(map(str, neardup.drop_near_duplicates(docs.repartition(n)).collect())) for n in (1, 7))
    assert first == second and len(first) == 4


def test_links_of_a_cell_join_what_is_alike():
    """cell_links against all pairs, in one block and across two; never more links than members less one."""
    rng = np.random.default_rng(3)
    base = [rng.choice(2000, 60, replace=False) for _ in range(6)]
    for across in (False, True):
        sets = [np.unique(np.concatenate([rng.permutation(base[rng.integers(6)])[: rng.integers(48, 61)], rng.integers(0, 2000, rng.integers(0, 6))])).astype(np.uint32) for _ in range(80)]
        ids, root, lane = np.arange(80) * 3, rng.integers(0, 60, 80), np.zeros(80, np.int64)
        low = np.arange(80) < 40 if across else np.ones(80, bool)
        alike = lambda x, y: len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))
        pairs = [(x, y) for x in range(80) for y in range(x) if alike(x, y) and (not across or low[x] != low[y])]
        got = neardup.cell_links(lane, root, ids, low, sets, neardup.NearDupSpec())
        roots = [(3000 + int(r), int(i)) for r, i in zip(root, ids)]
        nodes = [n for e in roots for n in e]
        same = lambda c: {frozenset(k for k in c if c[k] == v) for v in set(c.values())}
        assert same(components(nodes, roots + [(int(a), int(b)) for a, b in got])) == same(components(nodes, roots + [(3 * x, 3 * y) for x, y in pairs]))
        assert 5 < len(got) < 80 and all(alike(a // 3, b // 3) for a, b in got)


# --- repeated strings --------------------------------------------------------------------------


def test_suffix_array_against_sorting():
    rng = random.Random(4)
    for _ in range(200):
        k = rng.choice([1, 2, 3, 8])
        d = [rng.randint(1, k) for _ in range(rng.randint(0, 60))] + [0]
        assert suffix.suffix_array(np.array(d), k + 1).tolist() == sorted(range(len(d)), key=lambda i: d[i:])
    wide = list(np.random.default_rng(1).permutation(3000) + 1) * 2 + [0]
    assert suffix.suffix_array(np.array(wide), 3002).tolist() == sorted(range(len(wide)), key=lambda i: wide[i:])


def test_common_prefixes():
    rng = random.Random(5)
    for _ in range(60):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 80))) + b"\x00"
        sa = suffix.suffix_array(np.frombuffer(data, np.uint8).astype(np.int64), 256)
        got = suffix.permuted_lcp(data, sa)
        for a, b in zip(sa[:-1], sa[1:]):
            n = next((i for i in range(len(data)) if max(a, b) + i >= len(data) or data[a + i] != data[b + i]), 0)
            assert got[b] == n


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(hit))]
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + d[at:a], b
        kept += d[at:]
        out.append((len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("dense", [4096, 6, 1])
def test_repeats_against_brute_force(make, dense):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcé ") for _ in range(150))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) for _ in range(25)]
    texts += [t[:40] + passage[rng.randint(0, 60) :] + t[40:] for t in texts[:8]] + [texts[0], None, "", "xyz" * 100, "a" * 500, passage]
    spec = suffix.RepeatSpec(length=40, gram=8, most_windows=64, shard_bytes=2000, dense=dense)
    got = suffix.remove_repeats(make(texts), spec, keep_bytes=True).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(texts, 40)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.changed == (r.n_removed > 0) for r in got)


@pytest.mark.parametrize("dense", [12, 2])
def test_repeats_of_dense_hashes(spark, make, dense):
    """Passages just below, at and above the length in many different surroundings, and runs of one letter in many lengths: one hash has many different segments."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for n in (38, 39, 40, 41, 70):
        passage = word(n)
        texts += [word(rng.randint(30, 60)) + passage + word(rng.randint(30, 60)) for _ in range(25)]
        texts += [texts[-1][:50] + texts[-2][50:]]
    texts += [word(20) + "z" * n + word(20) for n in range(20, 75, 2)] + [None, "", "zy" * 60]
    rng.shuffle(texts)
    spec = suffix.RepeatSpec(length=40, gram=8, most_windows=64, shard_bytes=2000, dense=dense)
    got = suffix.remove_repeats(make(texts), spec).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(texts, 40)
    seg = suffix.segment_rows(make(texts).select("doc_id", "text"), spec)
    assert seg.groupBy("h").agg(F.countDistinct("s1", "s2").alias("k")).where(F.col("k") > 20).count() >= 3


def most_read(spark, group):
    """Of each stage of a job group that reads 5,000 or more shuffled rows: the largest task's share of them."""
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    out = {}
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            tasks, rows = store.taskList(stage, 0, 10_000), []
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                rows.append(metrics.get().shuffleReadMetrics().recordsRead() if metrics.isDefined() else 0)
            if sum(rows) >= 5000:
                out[stage] = max(rows) / sum(rows)
    return out


def test_pieces_that_many_texts_hold_do_not_meet_in_one_task(spark, make):
    """Runs of one letter and a passage in many surroundings: most rows have one key, no task reads most of a stage's rows, and the bytes are those of brute force."""
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(100)
    texts = [word(12) + passage + word(12) for _ in range(1500)] + [word(20) + "z" * rng.randint(60, 95) + word(20) for _ in range(1500)]
    spec = suffix.RepeatSpec(length=40, gram=8, most_windows=64, shard_bytes=20_000, dense=12)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("false", "16", "-1")):
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("hot pieces", "")
        got = suffix.remove_repeats(make(texts), spec).orderBy("doc_id").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("", "")
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(texts, 40)
    shares = most_read(spark, "hot pieces")
    assert shares and max(shares.values()) < 0.3, shares


def test_pieces_of_equal_windows_share_a_key(spark):
    """Every window lies in one piece, ranges have the stated width, and windows alike in two segments get one key."""
    rng = random.Random(9)
    spec = suffix.RepeatSpec(length=40, gram=8, most_windows=64)
    passage = "".join(rng.choice("abcdefgh") for _ in range(44))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(50)) + passage + "".join(rng.choice("abcdefgh") for _ in range(50)) for _ in range(6)]
    grams, rows = suffix.Grams(spec), []
    for i, t in enumerate(texts):
        for a, b, h, _ in grams.segments(t.encode()):
            rows.append((suffix.signed(h), i, a, 0, -1, bytearray(t[a : b + spec.length].encode())))
    table = spark.createDataFrame(rows, "h long, s1 long, s2 long, w long, top long, data binary")
    for width in (5, 1):
        keys, seen = {}, Counter()
        for r in suffix.anchored_pieces(table, spec, width).collect():
            assert r.windows <= width and len(r.data) == r.windows + 39
            for k in range(r.windows):
                seen[r.s1, r.s2 + r.w + k] += 1
                keys.setdefault(bytes(r.data[k : k + 40]), []).append(r.key)
        assert set(seen.values()) == {1} and len(seen) == sum(len(t) - 39 for t in texts)
        assert all(len(set(x)) == 1 for x in keys.values()) and max(map(len, keys.values())) == 6


def test_repeats_awkward(awkward, nothing):
    out = suffix.remove_repeats(awkward).collect()
    want = Counter(brute_repeats([r.text for r in awkward.collect()], 400))
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want
    assert suffix.remove_repeats(nothing).count() == 0
