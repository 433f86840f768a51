"""Where iterations cut their plans: the shared checkpoint folder of the cluster."""

from __future__ import annotations

import tempfile
from types import TracebackType
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where none is named, a fresh local folder serves a local master (tests); a cluster must name one,
    as machines do not see each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="arbora-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage at a copy in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new name under the checkpoint folder; nothing is made yet."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/arbora_{what}_{uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that a job writes under the checkpoint folder and removes when its result is durable.

    `with Scratch(spark, "name") as keep: table = keep(df)`; what leaves the block must not read
    such a table any more.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder, self.tables = spark, shared_folder(spark, what), 0

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.tables}"
        self.tables += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, before: int) -> None:
        """Removes the tables written before the last `before` ones."""
        for i in range(self.tables - before):
            remove_folder(self.spark, f"{self.folder}/{i}")

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        remove_folder(self.spark, self.folder)
