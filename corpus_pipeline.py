"""A training corpus from the documents table, in five stages.

Each stage takes what the one before it kept, judges it on that input and returns the columns of
documents; only the last adds the shard and the slot.

Defined results: a document without a text is judged as an empty one; null ids, sources and languages
are values like any other; of rows equal in every column one is kept and may then be repeated by the
mixing; further columns are kept, whatever their names, but one that is called shard or slot, in any
case, is replaced by the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import decontaminate, mixing, quality_classifier, sharding, simhash
from arbora.llm.common import remove_folder, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As evenly from all sources as repeating the rarest up to twice allows; none is cut below one epoch."""
    return mixing.mix(docs, target_entropy=None, max_repeat=2.0, budget="cover")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into 16 shards of equal size."""
    return sharding.shuffle_into_shards(docs, shards=16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Fingerprints, learnt weights and keyed hashes have no DuckDB counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet, read again by the next stage and
    removed after it. The last stays for the result."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}")
    return docs
