"""Decision-log analytics: regret, summaries over runs, lookups and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def regret_curve(log: DataFrame, every: int, run_cols: Sequence[str] = ("method", "seed")) -> DataFrame:
    """(run, round, regret): cumulative regret (1 - reward) at every `every`-th and the last round.

    Rows are summed by stretches of rounds first; only stretches are accumulated in a window.
    """
    stretch = F.floor((F.col("round") - 1) / every)
    sums = log.groupBy(*run_cols, stretch.alias("_s")).agg(F.sum(1 - F.col("reward")).alias("_r"), F.max("round").alias("round"))
    upto = Window.partitionBy(*run_cols).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("regret", F.sum("_r").over(upto)).select(*run_cols, "round", "regret")


def final_regret(log: DataFrame, run_cols: Sequence[str] = ("method", "seed")) -> DataFrame:
    """(run, final_regret, regret_rate, rounds)."""
    return log.groupBy(*run_cols).agg(F.sum(1 - F.col("reward")).alias("final_regret"), F.avg(1 - F.col("reward")).alias("regret_rate"), F.count("*").alias("rounds"))


def method_summary(runs: DataFrame, value: str = "final_regret", method_col: str = "method") -> DataFrame:
    """(method, mean, sd, runs) over seeds, population deviation."""
    return runs.groupBy(method_col).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count("*").alias("runs"))


def relative_to_baseline(summary: DataFrame, base: str, method_col: str = "method") -> DataFrame:
    """`summary` with `relative` = (mean - base) / base * 100, null for the base itself."""
    row = summary.where(F.col(method_col) == base).select(F.col("mean").alias("_b")).limit(1)
    joined = summary.join(F.broadcast(row))  # one row
    return joined.withColumn("relative", F.when(F.col(method_col) != base, (F.col("mean") - F.col("_b")) / F.col("_b") * 100)).drop("_b")


def ordered_results(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def keyed_gather(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Look up integer keys in a table; Spark broadcasts it if its size allows, or joins by a shuffle."""
    return rows.join(table, list(keys), how)


def promotion_report(promotions: DataFrame, final_depths: DataFrame | None = None) -> DataFrame:
    """(run_id, report): 'old->new at t, ...' in order; with `final_depths` (run_id, depth) runs without
    a promotion report their depth."""
    step = F.concat(F.col("old_depth").cast("string"), F.lit("->"), F.col("new_depth").cast("string"), F.lit(" at "), F.col("t").cast("string"))
    found = promotions.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("t", step.alias("s")))).alias("p")).select("run_id", F.array_join(F.transform("p", lambda x: x["s"]), ", ").alias("report"))
    if final_depths is None:
        return found
    return final_depths.join(found, "run_id", "left").select("run_id", F.coalesce("report", F.concat(F.lit("depth "), F.col("depth").cast("string"))).alias("report"))


def sweep_grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """Every combination of the named parameter values: nested explodes of literal lists."""
    df = spark.range(1).drop("id")
    return reduce(lambda d, kv: d.withColumn(kv[0], F.explode(F.array(*[F.lit(v) for v in kv[1]]))), values.items(), df)
