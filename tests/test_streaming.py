"""Micro-batches give what a batch gives; a replayed batch changes nothing."""

import pytest
from pyspark.sql import functions as F

from arbora.functions.lineage import durable
from arbora.operators import posterior, quantize
from arbora.streaming import micro


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, i + 1, [float(i % 7), float(i % 5)], i % 3, float(i % 3 == i % 2)) for i in range(90)]
    return durable(spark.createDataFrame(rows, "row_id long, round long, x array<double>, arm int, reward double"))


def stream(spark, df, path, batches=3):
    n = df.count()
    for b in range(batches):
        df.where((F.col("round") > b * n // batches) & (F.col("round") <= (b + 1) * n // batches)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def key(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_learn_counters(spark, log, tmp_path):
    book = quantize.train_codebook(log, 2, 1, 2)
    coded = durable(quantize.encode(log, book))
    fold = lambda table, batch: micro.fold_counters(table, batch, 2)
    micro.learn_stream(stream(spark, coded, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c", fold).awaitTermination()
    want = None
    for b in range(3):
        want = durable(micro.fold_counters(want, coded.where((F.col("round") > b * 30) & (F.col("round") <= b * 30 + 30)), 2))
    cols = ("level", "code", "arm", "n", "f", "theta")
    got = micro.read_version(spark, f"{tmp_path}/t")
    assert key(got, *cols) == key(want, *cols)
    # the last batch once more
    last = coded.where("round > 60")
    micro.write_version(fold(micro.read_version(spark, f"{tmp_path}/t", before=2), last), f"{tmp_path}/t", 2)
    assert key(micro.read_version(spark, f"{tmp_path}/t"), *cols) == key(want, *cols)
    # the first batch is a level-by-level fit of level 0
    first = coded.where("round <= 30")
    assert key(micro.fold_counters(None, first, 1), *cols) == key(posterior.counter_posterior(first), *cols)


def test_fold_gram_sums(spark, log):
    whole = posterior.gram(log, ["arm"])
    parts = None
    for r in range(3):
        parts = durable(micro.fold_sums(parts, posterior.gram(log.where(F.col("row_id") % 3 == r), ["arm"]), ["arm", "i", "j"], ["v", "n"]))
    assert key(parts, "arm", "i", "j", "v", "n") == key(whole, "arm", "i", "j", "v", "n")


def test_decide_and_promote(spark, log, tmp_path):
    book = quantize.train_codebook(log, 2, 1, 2)
    decide = lambda batch, table: micro.decide_batch(batch, book, table, 2, 3, nu=0.5)
    micro.decide_stream(stream(spark, log, f"{tmp_path}/d"), decide, f"{tmp_path}/none", f"{tmp_path}/out", f"{tmp_path}/dc").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 90 and out.select("arm").distinct().count() == 3
    micro.promote_stream(stream(spark, log, f"{tmp_path}/p"), book, f"{tmp_path}/pr", f"{tmp_path}/pc", [(60, 0.05)], 20, 2, 3).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/pr/errors").count() == 90
    assert micro.read_version(spark, f"{tmp_path}/pr/counters").agg(F.sum("n")).first()[0] == 180


def test_running_counters(spark, log, tmp_path):
    q = micro.running_counters(stream(spark, log, f"{tmp_path}/r")).writeStream.outputMode("complete").format("memory").queryName("running_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert key(spark.table("running_test"), "arm", "n", "s") == key(log.groupBy("arm").agg(F.count("*").alias("n"), F.sum("reward").alias("s")), "arm", "n", "s")
    coded = quantize.encode(log, quantize.train_codebook(log, 2, 1, 1))
    assert micro.running_code_counters(coded).agg(F.sum("n")).first()[0] == 180
