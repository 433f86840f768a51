"""White-space separated text whose first line counts the rows of each class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines from 0 in the order of files by name and of offsets within a file.

    A task reads a block's lines in turn, so a line's rank in it is its place less the least place there;
    ranks are shifted by the number of lines in the blocks before. One row a block is all that is
    ordered as a whole, and lines are neither sorted nor exchanged.
    """
    at = [F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("place")]
    lines = spark.read.text(path).select("value", *at)
    blocks = lines.groupBy("file", "start").agg(F.count("*").alias("count"), F.min("place").alias("first"))
    before = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(offsets), ["file", "start"]).select((F.col("place") + F.col("shift")).alias("line"), "value")


def read_counted_text(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(row_id, x, label): line 1 holds two counts; the first so many data lines have label 1.

    The label depends on the line's number. With `check` a number of lines other than the header's
    stops the job.
    """
    numbered = numbered_lines(spark, path)
    header = numbered.where("line = 0").first()
    if header is None:
        raise ValueError(f"{path} has no header line")
    signal, noise = (int(v) for v in header["value"].split()[:2])
    rows = numbered.where("line > 0 and length(trim(value)) > 0")
    if check and (n := rows.count()) != signal + noise:
        raise ValueError(f"{path} has {n} rows, its header says {signal} + {noise}")
    return rows.select((F.col("line") - 1).alias("row_id"), F.split(F.trim("value"), r"\s+").cast("array<double>").alias("x"), (F.col("line") <= signal).cast("int").alias("label"))
