import corpus_pipeline
from loomtext.llm import registry

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            tokens = out.groupBy("sequence_id").sum("length").collect()
            assert max(r[1] for r in tokens) <= 1024 and out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        else:
            assert out.columns == columns and out.count() > 0
            if name != "mixing sources":
                assert out.count() <= before and out.count() == out.select("doc_id").distinct().count()
        docs, before = out, out.count()


def test_registry(spark):
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in registry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())
