"""Context tables: features, labels and their splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.storagelevel import StorageLevel


def read_contexts(spark: SparkSession, path: str, features: str | Sequence[str], label: str | None = None, row_id: str | None = None, format: str = "parquet", schema: str | None = None, missing_ok: bool = False) -> DataFrame | None:
    """(row_id, x, label): `features` is an array column or a list of numeric columns.

    With `missing_ok` a path that does not exist gives None. Columns that are not named are never
    read. Without `row_id` rows have none: Spark has no stable row number to offer.
    """
    reader = spark.read.format(format)
    if schema:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", True)
    try:
        df = reader.load(path)
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return contexts(df, features, label, row_id)


def contexts(df: DataFrame, features: str | Sequence[str], label: str | None = None, row_id: str | None = None) -> DataFrame:
    x = F.col(features).cast("array<float>") if isinstance(features, str) else F.array(*[F.col(c).cast("float") for c in features])
    cols = [F.col(row_id).cast("bigint").alias("row_id")] if row_id else []
    cols.append(x.cast("array<double>").alias("x"))
    if label:
        cols.append(F.col(label).cast("int").alias("label"))
    return df.select(*cols)


def union_splits(splits: dict[str, DataFrame | None]) -> DataFrame:
    """Named splits one below the other with a column `split`; absent splits (None) are skipped and
    columns that a split lacks are null."""
    present = [df.withColumn("split", F.lit(name)) for name, df in splits.items() if df is not None]
    if not present:
        raise ValueError("no split is present")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def cached_contexts(df: DataFrame) -> DataFrame:
    """Keep a prepared table for several passes, in memory as far as it goes."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
