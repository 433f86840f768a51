"""How well codes explain rewards, and when a deeper level pays off."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.arrow import matrix
from arbora.functions.vectors import add_intercept, clip01, dot, doubles, one_hot, sigmoid_clip, weighted_sum
from arbora.operators import models, sweep
from arbora.operators.posterior import position_sums
from arbora.operators.score import SEND_BYTES, sent


def _level_sum(encoded: DataFrame, table: DataFrame, value: str, depth: int, n_arms: int, eta: float | None) -> DataFrame:
    """(row_id, label, p): sums over levels of the looked-up vectors, weighted by eta**level if given.

    One lookup a level by a join with at most 2**nbits rows, so rows are never multiplied.
    """
    out = encoded.select("row_id", "label", "codes", F.array(*[F.lit(0.0)] * n_arms).alias("p"))
    for level in range(depth):
        look = table.where(F.col("level") == level).select(F.col("code").alias("_code"), F.col(value).alias("_v"))
        weight = 1.0 if eta is None else eta**level
        out = out.join(F.broadcast(look), F.get("codes", F.lit(level)) == F.col("_code"), "left").withColumn("p", F.when(F.col("_v").isNull(), F.col("p")).otherwise(weighted_sum("p", "_v", weight))).drop("_code", "_v")
    return out


def delta_additive(encoded: DataFrame, theta: DataFrame, depth: int, n_arms: int) -> DataFrame:
    """(depth, delta, n): mean over rows of the greatest |indicator - sum of theta| over arms."""
    rows = _level_sum(encoded, theta, "theta", depth, n_arms, None)
    worst = F.array_max(F.zip_with(one_hot(F.col("label"), n_arms), "p", lambda y, p: F.abs(y - p)))
    return rows.agg(F.avg(worst).alias("delta"), F.count("*").alias("n")).select(F.lit(depth).alias("depth"), "delta", "n")


def delta_additive_sweep(contexts: DataFrame, depths: Sequence[int], seeds: Sequence[int], holdout: int, n_arms: int, nbits: int = 4, iterations: int = 10) -> DataFrame:
    """(depth, seed, delta, n_fit, n_eval): codebook and model from a holdout, error on the rest.

    One codebook of the greatest depth a seed; depth l uses its first l levels, as levels are fitted
    greedily. All seeds and depths are run together (see `sweep`).
    """
    return sweep.delta_grid(contexts, depths, seeds, holdout, n_arms, nbits, iterations)


def summarize_sweep(sweep: DataFrame) -> DataFrame:
    """(depth, delta, twice, sd): mean over seeds, twice the mean, population deviation."""
    return sweep.groupBy("depth").agg(F.avg("delta").alias("delta"), (2 * F.avg("delta")).alias("twice"), F.stddev_pop("delta").alias("sd"))


def delta_boosted(encoded: DataFrame, means: DataFrame, depth: int, n_arms: int, eta: float = 0.5) -> DataFrame:
    """(depth, mae, mae_smoothed): mean |clip(sum of eta**l * mean) - indicator| over classes and rows."""
    y = one_hot(F.col("label"), n_arms)
    error = lambda col: F.aggregate(F.zip_with(y, col, lambda a, p: F.abs(a - clip01(p))), F.lit(0.0), lambda s, v: s + v) / n_arms
    both = _level_sum(encoded, means.withColumn("both", F.concat("mean", "smoothed")), "both", depth, 2 * n_arms, eta)
    return both.agg(F.avg(error(F.slice("p", 1, n_arms))).alias("mae"), F.avg(error(F.slice("p", n_arms + 1, n_arms))).alias("mae_smoothed")).select(F.lit(depth).alias("depth"), "mae", "mae_smoothed")


def delta_linear(contexts: DataFrame, weights: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """(mae): predictions clipped to [0, 1], divided by their sum (1e-10 at least), against indicators.
    Rows with a null vector are left out; a null label is no class."""

    @F.arrow_udf("double")
    def error(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, label in batches:
            v, there = matrix(x)
            out = np.zeros(len(v))
            if there.any():
                p = np.clip(v[there] @ weights.T + intercepts, 0, 1)
                p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-10)
                out[there] = np.abs(p - (label.fill_null(-1).to_numpy()[there][:, None] == np.arange(len(intercepts)))).mean(axis=1)
            yield pa.array(out, mask=~there)

    return contexts.select(error(doubles("x"), F.col("label").cast("int")).alias("_e")).agg(F.avg("_e").alias("mae"))


def correlation_ratio(df: DataFrame, x_col: str = "x", label_col: str = "label") -> DataFrame:
    """(rho): root of between-class over total sum of squares, all features; 0 if the total is below 1e-15."""
    by = position_sums(df, [label_col], x_col, F.lit(0.0))
    per = by.groupBy("i").agg(F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    base = F.col("s") * F.col("s") / F.col("n")
    return per.agg(F.sum(F.col("b") - base).alias("between"), F.sum(F.col("q") - base).alias("total")).select(F.when(F.col("total") < 1e-15, 0.0).otherwise(F.sqrt(F.greatest(F.col("between"), F.lit(0.0)) / F.col("total"))).alias("rho"))


def delta_report(dataset: str, contexts: DataFrame, depths: Sequence[int], n_arms: int, nbits: int = 4, iterations: int = 10, eta: float = 0.5, alpha: float = 1.0, folds: int = 0) -> DataFrame:
    """One row a depth: code-based and linear error, their gaps, rho, N, d and the number of classes.

    In-sample by default; with `folds` = k each fold (a keyed hash of the row id) is judged by models of
    the other folds, and errors are averaged over rows. All folds share each job.
    """
    spark, runs = contexts.sparkSession, max(folds, 1)
    rho = correlation_ratio(contexts).first()["rho"]
    n, d = contexts.agg(F.count("*"), F.max(F.size("x"))).first()
    fold = sweep.fold_of(runs)
    if folds:
        w, b = models.fit_ridge_folds(contexts, fold, folds, n_arms, alpha)
    else:
        w, b = (v[None] for v in models.fit_ridge_multi(contexts, n_arms, alpha))
    error, seen = sweep.linear_errors(contexts, fold, w, b).sum(axis=0)
    rows = sweep.with_runs(contexts, [fold != f for f in range(folds)] if folds else [F.lit(True)]).persist()
    books = sweep.train_codebooks(rows, runs, max(depths), nbits, iterations)
    coded = sweep.encode_runs(rows, books).select("row_id", "fit", "codes", "label").persist()
    mean, smooth = sweep.class_means(coded, runs, max(depths), n_arms, nbits, eta)
    sums = sweep.boosted_errors(coded, None if folds else [F.lit(True)], mean, smooth, depths, eta).sum(axis=0)
    coded.unpersist()
    rows.unpersist()
    lin = error / seen
    out = [(dataset, n, d, n_arms, depth, plain / k, soft / k, lin, lin - plain / k, lin - soft / k, rho) for depth, (plain, soft, k) in zip(depths, sums.tolist(), strict=True)]
    return spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in out], "dataset string, N long, d int, C int, depth int, delta_rq_mae double, delta_rq_mae_smoothed double, delta_lin_mae double, delta_gap double, delta_gap_smoothed double, rho double")


def dataset_stats(df: DataFrame, dataset: str, label_col: str = "label", x_col: str = "x") -> DataFrame:
    """(dataset, d, a, n, d2a, p_max): width, distinct labels, rows, d*d*a, share of the commonest label."""
    by = df.groupBy(label_col).agg(F.count("*").alias("c"), F.max(F.size(x_col)).alias("d"))
    return by.agg(F.max("d").alias("d"), F.count(label_col).alias("a"), F.sum("c").alias("n"), F.max("c").alias("m")).select(
        F.lit(dataset).alias("dataset"), "d", "a", "n", (F.col("d").cast("bigint") * F.col("d") * F.col("a")).alias("d2a"), F.round(F.col("m") / F.col("n"), 4).alias("p_max")
    )


def best_fixed_arm(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(arm, share): the commonest label, the lowest of equally common ones."""
    by = df.groupBy(F.col(label_col).alias("arm")).agg(F.count("*").alias("c"))
    return by.agg(F.max_by("arm", F.struct("c", -F.col("arm"))).alias("arm"), (F.max("c") / F.sum("c")).alias("share"))


def sufficiency_ratio(n: Column, b: Column | int, k: Column, d: Column) -> Column:
    """Rows for each cell and squared dimension: N / (b * K * d * d)."""
    return n / ((F.lit(b) if isinstance(b, int) else b) * k * d * d)


def squared_errors(scored_active: DataFrame, scored_shadow: DataFrame, log: DataFrame) -> DataFrame:
    """(row_id, sq_err_active, sq_err_shadow): squared error of the clipped prediction of the arm that
    was chosen, from mean scores at two depths."""
    chosen = log.select("row_id", "arm", "reward")
    error = lambda c: F.pow(F.col("reward") - sigmoid_clip(F.col(c)), F.lit(2.0))
    a = scored_active.select("row_id", "arm", F.col("mean").alias("_a"))
    s = scored_shadow.select("row_id", "arm", F.col("mean").alias("_s"))
    return chosen.join(a, ["row_id", "arm"]).join(s, ["row_id", "arm"]).select("row_id", error("_a").alias("sq_err_active"), error("_s").alias("sq_err_shadow"))


def counter_predictions(log: DataFrame, posterior: DataFrame, levels: int, eta: float = 0.5) -> DataFrame:
    """`log` with `preds`: for the arm that was chosen, the sum of eta**l * theta over the first 1, 2, ...
    `levels` levels. One lookup a level by (code, arm); arms that were not chosen are never scored."""
    rows, sums, size = log, [F.lit(0.0)], posterior.count()
    for level in range(levels):
        look = posterior.where(F.col("level") == level).select(F.col("code").alias("_code"), F.col("arm").alias("_arm"), F.col("theta").alias(f"_theta_{level}"))
        rows = rows.join(sent(look, size), (F.get("codes", F.lit(level)) == F.col("_code")) & (F.col("arm") == F.col("_arm")), "left").drop("_code", "_arm")
        sums.append(sums[-1] + eta**level * F.coalesce(f"_theta_{level}", F.lit(0.0)))
    return rows.withColumn("preds", F.array(*sums[1:])).drop(*[f"_theta_{level}" for level in range(levels)])


def weights(kind: str, models: DataFrame) -> DataFrame:
    """(level, code, arm, w): the mean weights of diagonal (`diag`) or full (`linear`) models."""
    return models.select("level", "code", "arm", (F.zip_with("f", "prec", lambda f, p: f / p) if kind == "diag" else F.col("mean")).alias("w"))


def chosen_predictions(log: DataFrame, cells: DataFrame, levels: int, eta: float = 0.5) -> DataFrame:
    """`log` with `preds` as from `counter_predictions`, for models of weights `w` on each level's
    residual and an intercept. A cell without weights adds nothing.

    The weights are measured. Up to SEND_BYTES they go to the tasks, which take the rows of a batch by
    cell; beyond, each level is one join by (code, arm). Arms that were not chosen are never scored.
    """
    rows = log.drop("preds")
    z = lambda level: add_intercept(F.get("residuals", F.lit(level)))
    if 8 * (cells.agg(F.sum(F.size("w"))).first()[0] or 0) > SEND_BYTES:
        sums = [F.lit(0.0)]
        for level in range(levels):
            look = cells.where(F.col("level") == level).select(F.col("code").alias("_code"), F.col("arm").alias("_arm"), F.col("w").alias(f"_w{level}"))
            rows = rows.join(look, (F.get("codes", F.lit(level)) == F.col("_code")) & (F.col("arm") == F.col("_arm")), "left").drop("_code", "_arm")
            sums.append(sums[-1] + eta**level * F.coalesce(dot(F.col(f"_w{level}"), z(level)), F.lit(0.0)))
        return rows.withColumn("preds", F.array(*sums[1:])).drop(*[f"_w{level}" for level in range(levels)])
    tables: dict[tuple[int, int, int], np.ndarray] = {(r["level"], r["code"], r["arm"]): np.array(r["w"]) for r in cells.where(F.col("level") < levels).collect()}
    shared = log.sparkSession.sparkContext.broadcast(tables)

    @F.arrow_udf("array<double>")
    def look(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arm, *parts in batches:
            n, total, out = len(arm), np.zeros(len(arm)), np.zeros((len(arm), levels))
            for level in range(levels):
                code, (x, there) = parts[2 * level], matrix(parts[2 * level + 1])
                usable = np.flatnonzero(np.asarray(arm.is_valid()) & np.asarray(code.is_valid()) & there)
                pairs = np.stack([code.fill_null(-1).to_numpy(), arm.fill_null(-1).to_numpy()], axis=1)[usable]
                found, at = np.unique(pairs, axis=0, return_inverse=True)
                for k, (c, a) in enumerate(found.tolist()):
                    w = shared.value.get((level, c, a))
                    if w is not None:
                        own = usable[at.ravel() == k]
                        total[own] += eta**level * (x[own] @ w)
                out[:, level] = total
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, n * levels + 1, levels, dtype=np.int32)), pa.array(out.ravel()))

    columns = [c for level in range(levels) for c in (F.get("codes", F.lit(level)), z(level))]
    return rows.withColumn("preds", look(F.col("arm").cast("int"), *columns))


def depth_errors(predicted: DataFrame, active: int, shadow: int, *keep: str) -> DataFrame:
    """(keep, sq_err_active, sq_err_shadow) at two depths, from `counter_predictions`."""
    error = lambda depth: F.pow(F.col("reward") - sigmoid_clip(F.get("preds", F.lit(depth - 1))), F.lit(2.0))
    return predicted.select(*keep, error(active).alias("sq_err_active"), error(shadow).alias("sq_err_shadow"))


# ---------------------------------------------------------------------------
# Promotion tests on windows of differences active - shadow of squared errors.


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d or tiny)
            c = 1.0 + num / c or tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """P(T > t) of Student's t with `df` degrees of freedom."""
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def regular(a: float, b: float, x: float) -> float:
        if x in (0.0, 1.0):
            return x
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b

    half = 0.5 * regular(a, b, x)
    return half if t >= 0 else 1 - half


def _diff() -> Column:
    return F.col("sq_err_active") - F.col("sq_err_shadow")


def window_moments(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, mean, sd, total, spread, top): what both tests need of each window, in one pass."""
    return errors.withColumn("_d", _diff()).groupBy(*keys).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("sd"), F.sum("_d").alias("total"), (F.var_pop("_d") * F.count("_d")).alias("spread"), F.max(F.abs("_d")).alias("top"))


def t_statistic() -> Column:
    """mean / (sd / sqrt(n)); null without spread."""
    return F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double"))))


def freedman_log_p() -> Column:
    """-S^2 / (2V + 2bS/3), the logarithm of Freedman's bound; null where S is not positive."""
    return F.when(F.col("total") > 0, -F.pow("total", F.lit(2.0)) / (2 * F.col("spread") + 2 * F.col("top") * F.col("total") / 3))


def paired_t_promotion(moments: DataFrame, alpha: float) -> DataFrame:
    """`moments` with t, p and promote_t: one-sided p below alpha; without spread a positive mean promotes."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_tail(float(v), float(k) - 1) if v == v and k > 1 else float("nan") for v, k in zip(t, n, strict=True)])

    p = tail(F.col("t"), F.col("n").cast("double"))
    flat = F.coalesce(F.col("sd"), F.lit(0.0)) == 0
    tested = moments.withColumn("t", t_statistic()).withColumn("p", p)
    return tested.withColumn("promote_t", F.when(flat, F.col("mean") > 0).otherwise((F.col("mean") > 0) & (F.col("p") < alpha)))


def freedman_promotion(moments: DataFrame, alpha: float) -> DataFrame:
    """`moments` with log_p and promote_freedman."""
    return moments.withColumn("log_p", freedman_log_p()).withColumn("promote_freedman", F.coalesce(F.col("log_p") < math.log(alpha), F.lit(False)))


def wins(test: str, n: int, mean: float, sd: float | None, total: float, spread: float, top: float, alpha: float) -> bool:
    """One test (`ttest` or `freedman`) on the moments of one window, as `paired_t_promotion` and
    `freedman_promotion` do it for tables of them."""
    if test == "freedman":
        return total > 0 and -total * total / (2 * spread + 2 * top * total / 3) < math.log(alpha)
    if not (sd or 0) > 0:
        return mean > 0
    return mean > 0 and t_tail(mean / (sd / math.sqrt(n)), n - 1) < alpha


def check_schedule(spark: SparkSession, c: int = 50, b: int = 16, n_arms: int = 2, max_depth: int = 8, alpha: float = 0.05) -> DataFrame:
    """(k, t, alpha): check rounds T0 * 2**k, T0 = c * b * K, 3 * max_depth of them, alpha shared evenly."""
    t0, checks = int(c * b * n_arms), 3 * max_depth
    return spark.range(checks).select(F.col("id").cast("int").alias("k"), (F.lit(t0) * F.pow(F.lit(2.0), F.col("id"))).cast("bigint").alias("t"), F.lit(alpha / checks).alias("alpha"))


def candidate_windows(errors: DataFrame, schedule: DataFrame, window: int) -> DataFrame:
    """(run_id, t, alpha, sq_err_active, sq_err_shadow): the last `window` rounds up to each check.
    The few checks go into the row expression, so no range join is needed."""
    checks = [(r["t"], r["alpha"]) for r in schedule.orderBy("t").collect()]  # 3 * max_depth rows
    hit = F.array_compact(F.array(*[F.when((F.col("round") <= t) & (F.col("round") > t - window), F.struct(F.lit(t).alias("t"), F.lit(a).alias("alpha"))) for t, a in checks]))
    return errors.select("run_id", "round", "sq_err_active", "sq_err_shadow", F.explode(hit).alias("c")).select("run_id", F.col("c.t").alias("t"), F.col("c.alpha").alias("alpha"), "round", "sq_err_active", "sq_err_shadow")


def promotion_log(errors: DataFrame, schedule: DataFrame, window: int, test: str = "ttest", start_depth: int = 1, max_level: int = 8) -> DataFrame:
    """(run_id, t, old_depth, new_depth): at each check a run with at least `window` rounds since its
    last promotion is tested on the last `window`; a check with too few is passed over.

    Windows are reduced to moments first, so a run's walk sees at most 3 * max_depth rows.
    """
    last = errors.groupBy("run_id").agg(F.max("round").alias("last"))
    moments = window_moments(candidate_windows(errors, schedule, window), ["run_id", "t", "alpha"]).join(last, "run_id").where("t <= last")
    small = moments.select("run_id", "t", "alpha", "n", "mean", "sd", "total", "spread", "top")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        depth, since, out = start_depth, 0, []
        for r in pdf.sort_values("t").itertuples(index=False):
            if depth >= max_level or r.n < window or r.t - since < window:
                continue
            win = wins(test, r.n, r.mean, r.sd, r.total, r.spread, r.top, r.alpha)
            if win:
                out.append((r.run_id, r.t, depth, depth + 1))
                depth, since = depth + 1, r.t
        return pd.DataFrame(out, columns=["run_id", "t", "old_depth", "new_depth"])

    kind = dict(errors.dtypes)["run_id"]
    return small.groupBy("run_id").applyInPandas(walk, f"run_id {kind}, t long, old_depth int, new_depth int")


def compare_promotion_tests(errors: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """Both tests side by side on the same windows, from one aggregation."""
    return freedman_promotion(paired_t_promotion(window_moments(errors, keys), alpha), alpha)
