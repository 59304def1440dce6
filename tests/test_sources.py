"""Readers, sinks and the chunk stream on small written files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from strandwise.functions import predicates as P
from strandwise.sources import files
from strandwise.streaming import chunks


def test_region_flattening(spark, tmp_path):
    block = {"ac": 5, "an": 10, "populations": [{"id": "AFR", "ac": 1, "an": 4}, {"id": "afr_x", "ac": 4, "an": 4}]}
    empty = {"ac": 0, "an": 0, "populations": []}
    variants = [
        {"variant_id": "v1", "rsids": ["rs1", "rs2"], "pos": 15, "ref": "A", "alt": "T", "consequence": None, "transcript_consequence": {"gene_symbol": "G", "major_consequence": "missense_variant"}, "genome": block, "exome": None},
        {"variant_id": "v2", "rsids": [], "pos": 99, "ref": "A", "alt": "TT", "consequence": "x", "transcript_consequence": None, "genome": empty, "exome": block},
    ]
    (tmp_path / "r.json").write_text(json.dumps({"data": {"region": {"variants": variants}}}))
    rows = {r.variant_id: r for r in files.flatten_region(files.read_region(spark, str(tmp_path / "r.json")), "afr", (10, 20), {"rs1": "G1"}).collect()}
    assert rows["v1"].rsid == "rs1" and rows["v1"].risk_label == "G1" and rows["v1"].in_gene and rows["v1"].consequence == "missense_variant"
    assert rows["v1"].af_population == 0.25 and rows["v1"].af_global == 0.5
    assert rows["v2"].rsid is None and rows["v2"].risk_label is None and not rows["v2"].in_gene and rows["v2"].af_global == 0.5


def test_bed(spark, tmp_path):
    with gzip.open(tmp_path / "ENC1.bed.gz", "wt") as f:
        f.write("chr1\t0\t10\textra\nchr1\t20\t30\tx\nchr2\t0\t10\tx\n")
    read = lambda **k: [(r.accession, r.start, r.end) for r in files.read_bed(spark, str(tmp_path), **k).collect()]
    assert read(chrom="chr1", locus=(10, 20)) == []
    assert read(chrom="chr1", locus=(10, 20), inclusive=True) == [("ENC1", 0, 10), ("ENC1", 20, 30)]


def test_vcf_and_panel(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\nchr1\t5\t.\tA\tT\t.\t.\t.\tGT\t0|1\t.|1:9\nchr1\t5\t.\tA\tG,C\t.\t.\t.\tGT\t0|2\t1|1\nchr1\t9\t.\tA\tG\t.\t.\t.\tGT\t1|1\t0|0\n")
    (tmp_path / "panel").write_text("sample pop\ns1  YRI\ns2\tCEU\ns3 XXX\n")
    vcf = files.read_vcf(spark, str(tmp_path / "a.vcf"), biallelic=False)
    assert vcf.count() == 6 and files.read_vcf(spark, str(tmp_path / "a.vcf")).count() == 4
    assert [r.gt for r in files.point_lookup(vcf, 5, "A", "C").orderBy("sample").collect()] == ["0|2", "1|1"]
    assert files.point_lookup(files.read_vcf(spark, str(tmp_path / "a.vcf")), 5).count() == 2
    assert files.read_panel(spark, str(tmp_path / "panel"), ["YRI", "CEU"]).count() == 2


def test_chunks_sink_and_conservation(spark, tmp_path):
    out = str(tmp_path / "chunks")
    rows = spark.range(450).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id") * 1.0).alias("dnase_x")).coalesce(1)
    files.write_tsv(rows, out, rows_per_file=200)
    back = files.read_score_chunks(spark, out, "id long, dnase_x double")
    assert len(list((tmp_path / "chunks").glob("*.csv.gz"))) == 3
    assert back.where("dnase_x IS NULL").count() == 225 and files.conserved(rows, back).count() == 0 and files.conserved(rows, back.limit(3)).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_tsv(rows, out)
    query = chunks.first_arrivals(chunks.stream_score_chunks(spark, out, "id long, dnase_x double"), ["id"]).writeStream.format("memory").queryName("arrived").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT * FROM arrived").count() == 450


def test_provenance_and_order(spark, tmp_path):
    files.write_summary(files.provenance(spark, {"rule": "half-open", "ties": "by id"}), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first().rule == "half-open"
    manifest = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "accession string, priority int, path string")
    assert {tuple(r) for r in files.first_in_order(manifest).collect()} == {("a", "x"), ("b", "z")}


def test_two_definitions_of_coding(spark):
    t = spark.createDataFrame([("splice_region_variant",), ("Missense_variant",), (None,)], "c string")
    got = t.select(P.matches_any(F.col("c"), P.CODING_PATTERN).alias("p"), F.coalesce(F.col("c").isin(*P.CODING_TERMS), F.lit(False)).alias("t")).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, False), (False, False)]


def test_landed_json(spark, tmp_path):
    (tmp_path / "rs1__POP_A.json").write_text('[{"variation2": "rs9", "r2": "0.5", "d_prime": "0.9", "other": 1}, {"variation2": "rs8", "r2": "x", "d_prime": null}]')
    (tmp_path / "rs2__POP_B.json").write_text("[]")
    got = {(r.variant, r.population, r.variation2, r.r2, r.d_prime) for r in files.read_ld_pairs(spark, str(tmp_path)).collect()}
    assert got == {("rs1", "POP_A", "rs9", 0.5, 0.9), ("rs1", "POP_A", "rs8", None, None)}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.json").write_text('[{"id": "G1", "start": 5, "end": 9}, {"id": "G2", "external_name": "ABC", "start": 20, "end": 30}]')
    assert {tuple(r) for r in files.read_genes(spark, str(tmp_path / "g")).collect()} == {("G1", "G1", 5, 9), ("G2", "ABC", 20, 30)}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('[{"description": "Enhancer", "feature_type": "regulatory"}, {"feature_type": "regulatory"}]')
    assert sorted(r.feature for r in files.read_regulatory(spark, str(tmp_path / "r")).collect()) == ["Enhancer", "regulatory"]
