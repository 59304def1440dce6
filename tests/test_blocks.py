"""The block source against whole files: regions by index, ranges without one, plain and gzip files, and its sink."""

import gzip
import random

import pytest
from pyarrow import fs
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from strandwise.sources import blocks as B
from strandwise.sources import files


def records(n=3000, seed=1):
    rng = random.Random(seed)
    out = []
    for chrom in ("1", "2", "X"):
        for start in sorted(rng.choice([rng.randint(0, 3_000_000), rng.randint(70_000, 90_000)]) for _ in range(n // 3)):
            ref = rng.choice(["A", "C", "ACGT" * rng.choice([1, 5, 9000])]) if rng.random() < 0.02 else "G"
            out.append((chrom, start, start + len(ref), "\t".join([chrom, str(start + 1), ".", ref, "T", ".", ".", ".", "GT", rng.choice(["0|1", "1|1"]) * rng.randint(1, 9)])))
    return out


def write(path, rows, kind="vcf", block=700, index=True, monkeypatch=None):
    monkeypatch.setattr(B, "BLOCK_BYTES", block)
    f = B.BlockFile(open(path, "wb"))
    f.add("##fileformat=VCFv4.2")
    for chrom, start, end, line in rows:
        f.add(line, chrom, start, end)
    f.close()
    if index:
        f.write_index(open(f"{path}.tbi", "wb"), kind)


def region(chrom=None, lo=None, hi=None):
    out = [ds.EqualTo(("chrom",), chrom)] if chrom else []
    return out + ([ds.GreaterThanOrEqual(("pos",), lo)] if lo else []) + ([ds.LessThanOrEqual(("pos",), hi)] if hi else [])


def read(path, filters=(), step=64 << 20, kind="vcf"):
    """(rows, number of blocks opened) of all partitions."""
    reader = B.LineReader({"path": str(path), "kind": kind, "partitionBytes": str(step)})
    assert list(reader.pushFilters(list(filters))) == list(filters)
    seen, out, own = set(), [], B.block_at
    parts = reader.partitions()
    B.block_at = lambda f, at: (seen.add(at), own(f, at))[1]
    try:
        for p in parts:
            out += list(reader.read(p))
    finally:
        B.block_at = own
    return out, len(seen), parts


def test_the_file_is_ordinary_gzip(tmp_path, monkeypatch):
    rows = records()
    write(tmp_path / "a.vcf.gz", rows, monkeypatch=monkeypatch)
    assert gzip.open(tmp_path / "a.vcf.gz", "rt").read().splitlines() == ["##fileformat=VCFv4.2", *[r[3] for r in rows]]
    assert gzip.open(tmp_path / "a.vcf.gz.tbi").read(4) == b"TBI\x01"


def test_a_region_opens_only_its_blocks(tmp_path, monkeypatch):
    rows = records()
    write(tmp_path / "a.vcf.gz", rows, monkeypatch=monkeypatch)
    everything, all_blocks, _ = read(tmp_path / "a.vcf.gz")
    assert [(r[0], r[2], r[3], r[4]) for r in everything] == rows
    rng = random.Random(4)
    for _ in range(60):
        chrom, lo = rng.choice(["1", "2", "X"]), rng.choice([rng.randint(1, 3_000_000), rng.randint(70_000, 90_000)])
        hi = lo + rng.choice([0, 100, 20_000, 400_000])
        got, opened, _ = read(tmp_path / "a.vcf.gz", region(chrom, lo, hi))
        want = [r for r in rows if r[0] == chrom and lo <= r[1] + 1 <= hi]
        assert [r[4] for r in got if r[0] == chrom and lo <= r[1] <= hi] == [r[3] for r in want]
        assert opened < all_blocks / 4 or hi - lo > 20_000 or 60_000 < lo < 100_000
    assert read(tmp_path / "a.vcf.gz", region("7"))[:2] == ([], 0)


@pytest.mark.parametrize("step", [1, 97, 1500, 20_000])
@pytest.mark.parametrize("form", ["index", "blocks", "plain", "gzip"])
def test_partitions_hold_every_line_once(tmp_path, monkeypatch, step, form):
    rows = records(240 if step < 1500 else 1500)
    path = tmp_path / "a.vcf.gz"
    if form in ("index", "blocks"):
        write(path, rows, index=form == "index", monkeypatch=monkeypatch)
    else:
        path.write_bytes((gzip.compress if form == "gzip" else bytes)(("#head\n" + "\n".join(r[3] for r in rows)).encode()))
    got, _, parts = read(path, step=step)
    assert [r[4] for r in got] == [r[3] for r in rows]
    assert (len(parts) == 1) == (form == "gzip") or step > 1500 or form == "index"


def test_lines_at_block_and_range_edges(tmp_path, monkeypatch):
    """Blocks that end with a line, blocks within one line, and empty files."""
    rows = [("1", i, i + 1, f"1\t{i + 1}\t.\tA\tC") for i in range(10, 99)]
    for block in (len(rows[0][3]) + 1, 3, 21, 10_000):
        write(tmp_path / f"{block}.vcf.gz", rows, block=block, index=False, monkeypatch=monkeypatch)
        for step in (1, 40, 45, 1000):
            assert [r[4] for r in read(tmp_path / f"{block}.vcf.gz", step=step)[0]] == [r[3] for r in rows]
    write(tmp_path / "none.vcf.gz", [], monkeypatch=monkeypatch)
    (tmp_path / "empty.vcf").write_bytes(b"")
    assert read(tmp_path / "none.vcf.gz")[0] == read(tmp_path / "empty.vcf")[0] == []


def test_bed_regions_by_overlap(tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = sorted((rng.choice(["c1", "c2"]), s := rng.randint(0, 500_000), s + rng.choice([0, 10, 200, 100_000])) for _ in range(2000))
    rows = [(c, s, e, f"{c}\t{s}\t{e}\tx") for c, s, e in rows]
    write(tmp_path / "a.bed.gz", rows, kind="bed", monkeypatch=monkeypatch)
    for lo, hi in ((0, 1), (250_000, 250_001), (499_990, 700_000), (100_000, 120_000)):
        got, opened, _ = read(tmp_path / "a.bed.gz", [ds.EqualTo(("chrom",), "c2"), ds.LessThan(("start",), hi), ds.GreaterThan(("end",), lo)], kind="bed")
        want = [r[3] for r in rows if r[0] == "c2" and r[1] < hi and r[2] > lo]
        assert [r[4] for r in got if r[0] == "c2" and r[2] < hi and r[3] > lo] == want
        got, _, _ = read(tmp_path / "a.bed.gz", [ds.LessThanOrEqual(("start",), hi), ds.GreaterThanOrEqual(("end",), lo)], kind="bed")
        assert [r[4] for r in got if r[2] <= hi and r[3] >= lo] == [r[3] for r in rows if r[1] <= hi and r[2] >= lo]


def test_through_spark(spark, tmp_path):
    rows = records(1500)
    table = spark.createDataFrame([r for r in rows], "chrom string, start long, `end` long, line string").repartition(5)
    path = f"file://{tmp_path}/out"
    B.write_lines(table, path, "vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS", files=3)
    names = sorted(i.base_name for i in fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/out")))
    assert len(names) == 6 and all(n.startswith("part-") for n in names)
    with pytest.raises(FileExistsError):
        B.write_lines(table, path)
    back = B.read_lines(spark, path)
    assert sorted(r.line for r in back.collect()) == sorted(r[3] for r in rows)
    some = back.where("chrom = '2' AND pos BETWEEN 70000 AND 80000")
    assert "PushedFilters: [" in some._jdf.queryExecution().toString() or "genome_lines" in some._jdf.queryExecution().toString()
    assert sorted(r.line for r in some.collect()) == sorted(r[3] for r in rows if r[0] == "2" and 70_000 <= r[1] + 1 <= 80_000)
    assert some.select("block").distinct().count() <= back.select("block").distinct().count()
    both = files.read_vcf(spark, path, "X", (1, 2_000_000), biallelic=False, blocks=True)
    assert both.count() == sum(r[0] == "X" and r[1] < 2_000_000 for r in rows)


def test_positions_beyond_the_index_are_an_error(tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="ends at position"):
        write(tmp_path / "a.vcf.gz", [("1", 1 << 29, (1 << 29) + 1, "x")], monkeypatch=monkeypatch)
    with pytest.raises(ValueError, match="not together"):
        write(tmp_path / "b.vcf.gz", [("1", 5, 6, "x"), ("2", 5, 6, "x"), ("1", 9, 10, "x")], monkeypatch=monkeypatch)


def test_conserved_writes(spark, tmp_path):
    rows = spark.range(1000)
    counts = files.write_conserved(rows, lambda d: d.repartition(3), lambda d: d.write.parquet(str(tmp_path / "a")))
    assert counts == {"expected": 1000, "found": 1000}
    with pytest.raises(files.RowsLost, match="1000 rows before, 500 after"):
        files.write_conserved(rows, lambda d: d.where("id % 2 = 0"), lambda d: d.write.parquet(str(tmp_path / "b")))
    with pytest.raises(files.RowsLost):
        files.write_conserved(rows, lambda d: d.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), lambda d: d.write.parquet(str(tmp_path / "c")))
    assert files.write_conserved(rows, lambda d: d.where("id > 4"), lambda d: d.write.parquet(str(tmp_path / "d")), allowed_loss=5)["found"] == 995
