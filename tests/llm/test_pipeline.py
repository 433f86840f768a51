"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline
from arbora.llm import decontaminate, simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"] for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert ids and set(ids) <= seen, name
        if name != "sharding":
            assert docs.columns == columns
        if name == "near duplicates":
            fps = simhash.classes(docs)
            assert fps.select("component").distinct().count() == len(ids) == len(set(ids))
        if name == "decontamination":
            bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
            assert decontaminate.annotate(docs, bench, "h").where("h.n_hit > 0").count() == 0
        if name == "mixing":
            assert set(ids) == seen  # every document at least once
        seen = set(ids)
    assert set(docs.columns) == {*columns, "shard", "slot"}
    sizes = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 16


def test_run_and_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "word " * 20_000, "en", None, 5, 1), (2, "other words here", "en", "s", 5, 1)], "doc_id long, text string, lang string, source string, n_chars long, shard int")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns.count("shard") == 1
    out.collect()
    docs.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/e/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
