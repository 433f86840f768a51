"""Every operator and every stage on nulls, empty and very long texts, ties, repeated rows and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arbora.llm import chat_format, decontaminate, language_id, mixing, quality_classifier, quality_rules, sharding, simhash, substring, token_output

DATA = "/root/testdata/sf0.001"
CLASHES = ["shard", "Slot", "mix_copies", "Mix_Source", "a.b", "hits", "gone_id", "twice", "content_hash", "k1", "cell", "part", "id", "fp", "p", "text_k1"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    long = ["x" * 1_000_000, " " * 1_000_000 + "a", "\U0001f642" * 250_000, "word and more " * 80_000, "a\nb " * 200_000]
    texts = [None, "", "  ", "One", "one", "tie a b c", "tie a b c", *long, long[3]]
    rows = [(i, t, ("en", None)[i % 2], ("s", None)[i % 3 == 0], 7) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (None, "one", None, None, None), (3, "One", None, "s", 7), (3, "One", None, "s", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    extra = {c: F.create_map(F.lit("k"), F.lit(1)) if i % 5 == 2 else F.lit(i) for i, c in enumerate(CLASHES)}
    df.withColumns(extra).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def side(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


OPERATORS = {
    "simhash": lambda s, d: simhash.classes(d),
    "near": lambda s, d: simhash.deduplicate(d),
    "decontaminate": lambda s, d: decontaminate.annotate(d, side(s, "benchmark"), "found"),
    "shards": lambda s, d: sharding.shuffle_into_shards(d, 4),
    "tokens": lambda s, d: token_output.place(*token_output.sequences(d, 256)),
    "rules": lambda s, d: quality_rules.judge(d, side(s, "labels")),
    "mixing": lambda s, d: mixing.mix(d, epoch_col="epoch"),
    "substring": lambda s, d: substring.deduplicate(d),
    "quality": lambda s, d: quality_classifier.score(d, quality_classifier.fit(d, side(s, "labels")), "score"),
    "chat": lambda s, d: chat_format.parse(d, [], "parsed", "text"),
    "language": lambda s, d: language_id.predict(d, language_id.fit(d), "found"),
}
ONE_ROW_EACH = {"simhash", "decontaminate", "shards", "rules", "substring", "quality", "chat", "language"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, docs, name):
    out = OPERATORS[name](spark, docs)
    rows = out.count()
    out.write.format("noop").mode("overwrite").save()
    if name in ONE_ROW_EACH:
        assert rows == docs.count()
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, docs, tmp_path, name, stage):
    stage(spark, docs, DATA).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.columns == (docs.columns if name != "sharding" else [c for c in docs.columns if c.lower() not in ("shard", "slot")] + ["shard", "slot"])
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    if name in ("mixing", "sharding"):
        assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
    if name == "near duplicates":
        assert {0, 3, 5, 10} <= kept and not {1, 2, 4, 6, 12} & kept
    assert stage(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize("given,want", [("64m", "4194304b"), ("67108864b", "4194304b"), ("1m", "1m"), ("2048", "2048"), ("1g", "4194304b")])
def test_batches_are_only_lowered(spark, given, want):
    from arbora.llm.common import prepare

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, given)
    prepare(spark)
    assert spark.conf.get(name) == want
    spark.conf.unset(name)
