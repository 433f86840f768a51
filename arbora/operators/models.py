"""Reward models: boosted trees, ridge and least squares, level-wise class means, refit schedules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.arrow import matrix, rows_of
from arbora.functions.lineage import durable
from arbora.functions.vectors import clip01, context_arm_features, doubles, one_hot, weighted_sum
from arbora.operators.boosting import Boosted, quantile_limits
from arbora.operators.posterior import gram, position_sums
from arbora.operators.prepare import expand_arms
from arbora.operators.score import choose, sent


#: Bins of a feature, which are all the cuts that MLlib's trees try (its default maxBins).
BINS = 32


@dataclass(frozen=True)
class RewardTrees:
    """MLlib's boosted trees over the numbers of a context's bins, and the limits of these."""

    limits: list[np.ndarray]
    model: GBTRegressionModel


def _binned(x: Column, limits: list[np.ndarray]) -> Column:
    """Each value's bin: how many limits of its feature lie below it."""
    by = Boosted(limits, 0)

    @F.arrow_udf("array<double>")
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            values, there = matrix(v)
            yield rows_of(by.bins(values).astype(float), there) if there.any() else pa.nulls(len(v), pa.list_(pa.float64()))

    return number(x)


def reward_cells(log: DataFrame, limits: list[np.ndarray]) -> DataFrame:
    """(x, arm, label, weight): how many rows have these bins, arm and reward. Rows with a null vector, arm
    or reward are left out."""
    rows = log.where(F.col("x").isNotNull() & F.col("arm").isNotNull() & F.col("reward").isNotNull())
    binned = rows.select(_binned(doubles("x"), limits).alias("x"), "arm", F.col("reward").cast("double").alias("label"))
    return binned.groupBy("x", "arm", "label").agg(F.count("*").cast("double").alias("weight"))


def fit_reward_gbt(log: DataFrame, n_arms: int, trees: int = 50, rate: float = 0.1, depth: int = 3) -> RewardTrees:
    """One boosted-tree regressor of the reward on the context and the arm's indicators.

    A tree sees of a value only its bin. So rows are put into exact quantile bins and rows of the same
    bins, arm and reward are counted once, before the trees' 150 passes; these go over the cells.
    """
    limits = quantile_limits(log, BINS)
    cells = durable(reward_cells(log, limits))
    rows = cells.select(array_to_vector(context_arm_features(F.col("x"), F.col("arm"), n_arms)).alias("features"), "label", "weight")
    return RewardTrees(limits, GBTRegressor(maxIter=trees, stepSize=rate, maxDepth=depth, maxBins=BINS, seed=1, weightCol="weight").fit(rows))


def predict_reward(model: RewardTrees, contexts: DataFrame, n_arms: int) -> DataFrame:
    """(row_id, arm, score): predictions for all arms."""
    return _scores(model, contexts.withColumn("x", _binned(doubles("x"), model.limits)), n_arms).select("row_id", "arm", "score")


def _scores(model: RewardTrees, binned: DataFrame, n_arms: int) -> DataFrame:
    """`binned`, whose x are numbers of bins, with every arm and its `score`."""
    features = array_to_vector(context_arm_features(F.col("x"), F.col("arm"), n_arms))
    return model.model.transform(expand_arms(binned, n_arms).withColumn("features", features)).withColumnRenamed("prediction", "score")


def choose_reward(model: RewardTrees, contexts: DataFrame, n_arms: int) -> DataFrame:
    """`contexts` with `arm`: of the greatest prediction, the lowest of equal ones; null for a null vector.

    Contexts of the same bins have the same predictions, so the trees decide each combination of bins that
    occurs once. Decisions are counted: up to SEND_BYTES they go to the tasks and nothing else is exchanged;
    beyond, the contexts are joined to them.
    """
    rows = contexts.drop("arm").withColumn("_bins", _binned(doubles("x"), model.limits))
    cells = rows.where(F.col("_bins").isNotNull()).select(F.col("_bins").alias("x")).distinct()
    arms = durable(choose(_scores(model, cells, n_arms), ("x",)).withColumnRenamed("x", "_bins"))
    return rows.join(sent(arms, arms.count(), 64 + 8 * len(model.limits)), "_bins", "left").drop("_bins")


def refit_every(log: DataFrame, contexts: DataFrame, n_arms: int, every: int, fit: Callable | None = None, predict: Callable | None = None, **settings) -> DataFrame:
    """(row_id, round, arm): each context is decided by a model of all logged rounds before its
    stretch of `every` rounds; the first stretch has none (null arm). One fit a stretch.

    `fit` takes the logged rows, `predict` the model and contexts and gives (row_id, arm, score);
    boosted trees with these `settings` by default, which decide by cells (`choose_reward`).
    """
    fit = fit or (lambda rows: fit_reward_gbt(rows, n_arms, **settings))
    last = contexts.agg(F.max("round")).first()[0] or 0
    out = contexts.where(F.col("round") <= every).select("row_id", "round", F.lit(None).cast("int").alias("arm"))
    for start in range(every, last, every):
        model = fit(log.where(F.col("round") <= start))
        part = contexts.where((F.col("round") > start) & (F.col("round") <= start + every))
        decided = part.select("row_id", "round").join(choose(predict(model, part)), "row_id") if predict else choose_reward(model, part.select("row_id", "round", "x"), n_arms)
        out = out.unionByName(decided.select("row_id", "round", "arm"))
    return out


def doubling_phase(round_col: str | Column = "round", init: int = 500) -> Column:
    """Phase 0, 1, 2, ... of a round counted from 1: phases last init, 2 * init, 4 * init, ... rounds.

    Whole numbers only: the number of binary digits of (t - 1) // init + 1, less one.
    """
    t = F.col(round_col) if isinstance(round_col, str) else round_col
    return (F.length(F.bin((F.floor((t - 1) / F.lit(init)) + 1).cast("bigint"))) - 1).cast("int")


def doubling_boundaries(init: int, rounds: int) -> list[int]:
    """Rounds after which a model is fitted again: init, 3 * init, 7 * init, ..."""
    out, k = [], 1
    while init * ((1 << k) - 1) <= rounds:
        out.append(init * ((1 << k) - 1))
        k += 1
    return out


def fit_ridge_multi(df: DataFrame, n_out: int, alpha: float = 1.0, label_col: str = "label", x_col: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Ridge with an unpenalised intercept, one output an arm: weights (n_out, d) and intercepts.

    The target is the arm's indicator. Sums of x x', x and x by label are made by the tasks; the d x d
    system is solved once for all outputs.
    """
    sums = gram(df.withColumn("_z", F.array_append(doubles(x_col), F.lit(1.0))), [], "_z", None)
    return _solve_ridge(*_ridge_sums(sums, position_sums(df, [label_col], x_col, F.lit(0.0)), [], label_col, n_out)[()], alpha)


def fit_ridge_folds(df: DataFrame, fold: Column, folds: int, n_out: int, alpha: float = 1.0, label_col: str = "label", x_col: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Weights (folds, n_out, d) and intercepts (folds, n_out) of models that each leave one fold out: the
    sums are made once, by fold, and each model takes those of the other folds."""
    rows = df.withColumn("_fold", fold).withColumn("_z", F.array_append(doubles(x_col), F.lit(1.0)))
    parts = _ridge_sums(gram(rows, ["_fold"], "_z", None), position_sums(rows, ["_fold", label_col], x_col, F.lit(0.0)), ["_fold"], label_col, n_out)
    total = [sum(p[i] for p in parts.values()) for i in range(3)]
    zero = [np.zeros_like(t) for t in total]
    found = [_solve_ridge(*[t - p for t, p in zip(total, parts.get((f,), zero), strict=True)], alpha) for f in range(folds)]
    return np.stack([w for w, _ in found]), np.stack([b for _, b in found])


def _ridge_sums(sums: DataFrame, by: DataFrame, keys: list[str], label_col: str, n_out: int) -> dict[tuple, list[np.ndarray]]:
    """By key: sums of z z' (z: the vector and 1), of x by label, and numbers of rows by label."""
    rows = sums.where("j >= 0").collect()
    d = max(r["i"] for r in rows)
    out: dict[tuple, list[np.ndarray]] = {}
    new = lambda: [np.zeros((d + 1, d + 1)), np.zeros((n_out, d)), np.zeros(n_out)]
    for r in rows:
        a = out.setdefault(tuple(r[k] for k in keys), new())[0]
        a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["v"]
    for r in by.where(F.col(label_col).between(0, n_out - 1)).collect():
        _, right, n = out.setdefault(tuple(r[k] for k in keys), new())
        right[r[label_col], r["i"]] = r["s"]
        n[r[label_col]] = r["n"]
    return out


def _solve_ridge(a: np.ndarray, right: np.ndarray, by_label: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    d = len(a) - 1
    n, mean, share = a[d, d], a[d, :d] / a[d, d], by_label / a[d, d]
    centred = a[:d, :d] - n * np.outer(mean, mean)
    w = np.linalg.solve(centred + alpha * np.eye(d), (right - n * share[:, None] * mean).T).T
    return w, share - w @ mean


def _pairs(encoded: DataFrame, depth: int, nbits: int) -> Column:
    """(level, code) of the first levels as one position: level * 2**nbits + code."""
    return F.transform(F.slice("codes", 1, depth), lambda c, l: l * (1 << nbits) + c)


def fit_additive_ols(encoded: DataFrame, n_arms: int, depth: int, nbits: int, ridge: float = 1e-8) -> list[np.ndarray]:
    """Additive model of the arm indicators on the codes of the first `depth` levels: theta by level,
    (2**nbits, n_arms) each, of least norm. Counts of code pairs and of codes by label are grouped
    sums; the design of indicators is never built."""
    b = 1 << nbits
    flat = encoded.select("label", _pairs(encoded, depth, nbits).alias("p"))
    pairs = flat.select("p", F.explode("p").alias("i")).select("i", F.explode("p").alias("j")).where("i <= j").groupBy("i", "j").count().collect()
    sides = flat.select("label", F.explode("p").alias("i")).groupBy("i", "label").count().collect()
    g, h = np.zeros((depth * b, depth * b)), np.zeros((depth * b, n_arms))
    for r in pairs:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["count"]
    for r in sides:
        if r["label"] is not None and 0 <= r["label"] < n_arms:
            h[r["i"], r["label"]] = r["count"]
    theta = np.linalg.lstsq(g + ridge * np.eye(len(g)), h, rcond=1e-12)[0]
    return list(theta.reshape(depth, b, n_arms))


def fit_boosted_centroids(encoded: DataFrame, n_arms: int, depth: int, nbits: int, eta: float = 0.5) -> DataFrame:
    """(level, code, mean, smoothed): mean residual indicator of every code and class, level by level.

    The residual is indicator - clip(sum of eta**j * mean_j) over lower levels; `smoothed` is
    (sum + 1/K) / (count + 1) on the same residuals. A code without rows has mean 0, smoothed 1/K.
    """
    spark = encoded.sparkSession
    rest = encoded.withColumn("_p", F.array(*[F.lit(0.0)] * n_arms))
    tables = []
    for level in range(depth):
        at = rest.withColumn("code", F.get("codes", F.lit(level)))
        residual = F.zip_with(one_hot(F.col("label"), n_arms), "_p", lambda y, p: y - clip01(p))
        each = at.select("code", F.posexplode(residual).alias("arm", "v")).groupBy("code", "arm").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
        means = each.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("arm", "s", "n"))).alias("c"))
        all_codes = spark.range(1 << nbits).select(F.col("id").cast("int").alias("code"))
        full = all_codes.join(means, "code", "left").select(
            F.lit(level).alias("level"),
            "code",
            F.coalesce(F.transform("c", lambda c: c["s"] / c["n"]), F.array(*[F.lit(0.0)] * n_arms)).alias("mean"),
            F.coalesce(F.transform("c", lambda c: (c["s"] + 1.0 / n_arms) / (c["n"] + 1)), F.array(*[F.lit(1.0 / n_arms)] * n_arms)).alias("smoothed"),
        )
        table = durable(full)
        tables.append(table)
        rest = at.join(F.broadcast(table.select("code", F.col("mean").alias("_m"))), "code").withColumn("_p", weighted_sum("_p", "_m", eta**level)).drop("code", "_m")  # 2**nbits rows
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def theta_table(spark, theta: Sequence[np.ndarray]) -> DataFrame:
    """(level, code, theta) of an additive model."""
    return spark.createDataFrame([(level, code, row.tolist()) for level, t in enumerate(theta) for code, row in enumerate(t)], "level int, code int, theta array<double>")
