"""Typed result rows: written, extended, and appended to by micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_results(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = (), format: str = "parquet") -> None:
    """Fixed column order; `order` sorts by range partitions, so files are in order too."""
    out = df.select(*columns)
    if order:
        out = out.orderBy(*order)
    writer = out.write.mode("overwrite")
    (writer.option("header", True).csv if format == "csv" else writer.parquet)(path)


def read_results(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if format == "csv" else reader.parquet(path)


def append_results(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Earlier rows and new ones; to be written to another path than the one that is read."""
    return new if existing is None else existing.unionByName(new, allowMissingColumns=True)


def append_checkpoints(df: DataFrame, path: str, batch_id: int) -> None:
    """Rows of one micro-batch under their own folder: a batch that is replayed overwrites itself."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
