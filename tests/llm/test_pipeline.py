import corpus_pipeline
from pyspark.sql import functions as F

from strandwise.llm import decontam, quality
from strandwise.llm.common import word_count


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    x, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        x = corpus_pipeline.materialize(stage(spark, x, small), "test")
        seen[name] = x
        if name != "sharding":
            assert x.columns == docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    ids = {n: [r.doc_id for r in seen[n].select("doc_id").collect()] for n in names}
    judged = {r.doc_id: quality.assess(r.text, quality.QualityRules()) for r in docs.collect()}
    texts = {r.doc_id: r.text for r in seen[names[0]].collect()}
    assert texts == {i: a["cleaned_text"] for i, a in judged.items() if a["kept"]}
    kept = ids[names[1]]
    norm = [" ".join(texts[i].lower().split()) for i in kept]
    assert len(set(norm)) == len(norm) and {" ".join(texts[i].lower().split()) for i in ids[names[0]]} >= set(norm)
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(b in texts[i] for i in ids[names[2]] for b in bench)
    assert set(kept) - set(ids[names[2]]) == {i for i in kept if any(b in texts[i] for b in bench)}
    before = seen[names[2]].agg(F.sum(word_count(F.col("text")))).first()[0]
    after = seen[names[3]].agg(F.sum(word_count(F.col("text")))).first()[0]
    assert abs(after / before - 1.5) < 0.1 and max(ids[names[3]].count(i) for i in set(ids[names[3]])) <= 2
    last = seen[names[4]]
    assert last.count() == seen[names[3]].count() and last.select("shard", "slot").distinct().count() == last.count()


def test_stages_on_awkward_rows(spark, small, awkward, nothing):
    """Nulls, empties, ties, a very long text and columns with the stages' own names, through each stage and through all of them."""
    same = lambda df: sorted(str(r.asDict()) for r in df.collect())
    x = awkward
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, small)
        if name == "sharding":
            assert out.columns == [c for c in awkward.columns if c not in ("shard", "slot")] + ["shard", "slot"]
            assert same(out.drop("shard", "slot")) == same(awkward.drop("shard", "slot"))
            per = {}
            for r in out.collect():
                per.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(v) == list(range(len(v))) for v in per.values())
        else:
            assert out.columns == awkward.columns and (name == "quality rules" or set(same(out)) <= set(same(awkward))) and out.count() > 0
        assert stage(spark, nothing, small).count() == 0
        x = corpus_pipeline.materialize(stage(spark, x, small), "awkward")
    kept = [r.doc_id for r in x.collect()]
    assert len(kept) > 10 and not {100, 101, 102, 106} & set(kept) and kept.count(5) <= 2


def test_run_on_awkward_tables(spark, tmp_path, awkward, nothing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a benchmark item that is in no text at all")], "item_id long, text string")
    for name, docs in (("rows", awkward), ("none", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/rows")
    assert out.count() > 10 and corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert decontam.decontaminate(awkward, bench).count() == awkward.count()
