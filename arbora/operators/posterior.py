"""Posterior tables: sufficient statistics of arms, by grouped aggregation.

All statistics are sums, so tasks combine before the shuffle and any order of rows gives the same
table. Row-wise updates of the usual learners (rank-one inverses, running means) are these sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.arrow import by_key
from arbora.functions.lineage import durable
from arbora.functions.vectors import add_intercept, dot, doubles, sigmoid_clip

PRIOR = (0.0, 1.0, 1.0, 1.0)


def _nig(n: Column, s: Column, ss: Column, mu: Column, lam: Column, alpha: Column, beta: Column) -> list[Column]:
    """Posterior of (mu, lam, alpha, beta) after n rewards of sum s and squared deviations ss."""
    total = lam + n
    gap = F.when(n > 0, F.pow(s / n - mu, F.lit(2.0)) * lam * n / total).otherwise(0.0)
    return [((lam * mu + s) / total).alias("mu"), total.alias("lam"), (alpha + n / 2).alias("alpha"), (beta + ss / 2 + gap / 2).alias("beta")]


def nig_posterior(log: DataFrame, n_arms: int, prior: Sequence[float] = PRIOR) -> DataFrame:
    """(arm, mu, lam, alpha, beta) of every arm 0 .. n_arms - 1; an unseen arm keeps the prior."""
    mu, lam, alpha, beta = (F.lit(float(v)) for v in prior)
    arms = log.sparkSession.range(n_arms).select(F.col("id").cast("int").alias("arm"), mu.alias("mu"), lam.alias("lam"), alpha.alias("alpha"), beta.alias("beta"))
    return nig_merge(arms, log)


def nig_merge(posterior: DataFrame, batch: DataFrame) -> DataFrame:
    """A posterior table with a batch of (arm, reward) folded in; any split into batches gives the same."""
    stats = batch.groupBy(F.col("arm").cast("int").alias("arm")).agg(F.count("reward").alias("n"), F.sum("reward").alias("s"), (F.var_pop("reward") * F.count("reward")).alias("ss"))
    joined = posterior.join(stats, "arm", "full_outer")
    n, s, ss = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("n", "s", "ss"))
    old = [F.coalesce(F.col(c), F.lit(float(v))) for c, v in zip(("mu", "lam", "alpha", "beta"), PRIOR, strict=True)]
    return joined.select("arm", *_nig(n, s, ss, *old))


def nig_summary(posterior: DataFrame, prior_lam: float = 1.0) -> DataFrame:
    """(arm, mean, n_eff): posterior mean and effective number of rewards."""
    return posterior.select("arm", F.col("mu").alias("mean"), (F.col("lam") - prior_lam).alias("n_eff"))


def gram(df: DataFrame, keys: Sequence[str], x_col: str = "x", reward_col: str | None = "reward") -> DataFrame:
    """(keys, i, j, v, n): sums of x[i] * x[j] for i <= j; with a reward also those of reward * x[i],
    as j = -1. Partial matrices are made a task, so the shuffle carries one matrix a key and task
    instead of d * d products a row."""
    keys = list(keys)
    names = [f"k{i}" for i in range(len(keys))]
    rewarded = reward_col is not None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for b in batches:
            for key, x, reward in by_key(b, len(names)):
                new = [x.T @ x, x.T @ reward if rewarded else np.zeros(x.shape[1]), len(x)]
                held[key] = [p + q for p, q in zip(held[key], new, strict=True)] if key in held else new
        for key, (a, f, n) in held.items():
            i, j = np.triu_indices(len(f))
            rows = [np.concatenate([i, np.arange(len(f))]), np.concatenate([j, np.full(len(f), -1)]), np.concatenate([a[i, j], f])]
            yield key_rows(names, key, {"i": pa.array(rows[0], pa.int32()), "j": pa.array(rows[1], pa.int32()), "v": pa.array(rows[2]), "n": pa.array(np.full(len(rows[2]), n))})

    cols = [F.col(k).cast("int").alias(a) for k, a in zip(keys, names, strict=True)]
    rows = df.select(*cols, doubles(x_col).alias("x"), (F.col(reward_col).cast("double") if rewarded else F.lit(0.0)).alias("reward"))
    schema = ", ".join([*(f"{a} int" for a in names), "i int, j int, v double, n long"])
    summed = rows.mapInArrow(partial, schema).groupBy(*names, "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return summed.select(*[F.col(a).alias(k) for k, a in zip(keys, names, strict=True)], "i", "j", "v", "n")


def solve(sums: DataFrame, keys: Sequence[str], lam: float | Column = 1.0) -> DataFrame:
    """(keys, n, a, f, cov, mean) from `gram`: a = lam * I + sums, cov its inverse (both row-major),
    mean = cov f. One matrix a group: as many small inversions as there are keys, spread over tasks."""
    keys = list(keys)
    types = dict(sums.dtypes)
    level = lam if isinstance(lam, Column) else F.lit(float(lam))

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["i"].max()) + 1
        a, f = np.eye(d) * float(pdf["lam"].iloc[0]), np.zeros(d)
        square = pdf[pdf["j"] >= 0]
        i, j, v = square["i"].to_numpy(), square["j"].to_numpy(), square["v"].to_numpy()
        a[i, j] += v
        a[j[i != j], i[i != j]] += v[i != j]
        right = pdf[pdf["j"] < 0]
        f[right["i"].to_numpy()] = right["v"].to_numpy()
        cov = np.linalg.inv(a)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "n": [int(pdf["n"].max())], "a": [a.ravel()], "f": [f], "cov": [cov.ravel()], "mean": [cov @ f]})

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "n long, a array<double>, f array<double>, cov array<double>, mean array<double>"])
    return sums.withColumn("lam", level).groupBy(*keys).applyInPandas(invert, schema)


def linear_posterior(log: DataFrame, lam: float = 1.0, x_col: str = "x") -> DataFrame:
    """(arm, n, a, f, cov, mean) with a = lam * I + sum of x x', f = sum of reward * x."""
    return solve(gram(log, ["arm"], x_col), ["arm"], lam)


def key_rows(names: Sequence[str], key: tuple, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of `columns` with one key repeated."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([*[pa.array(np.full(n, k), pa.int32()) for k in key], *columns.values()], names=[*names, *columns])


def position_sums(df: DataFrame, keys: Sequence[str], x_col: str, value: Column) -> DataFrame:
    """(keys, i, n, s, q, f): sums of 1, x[i], x[i] * x[i] and value * x[i], position by position. Tasks
    add up first, so the shuffle carries one vector a key and task."""
    names = [f"k{i}" for i in range(len(keys))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for b in batches:
            for key, x, v in by_key(b, len(names)):
                new = [len(x), x.sum(axis=0), (x * x).sum(axis=0), v @ x]
                held[key] = [p + q for p, q in zip(held[key], new, strict=True)] if key in held else new
        for key, (n, s, q, f) in held.items():
            yield key_rows(names, key, {"i": pa.array(np.arange(len(s)), pa.int32()), "n": pa.array(np.full(len(s), n)), "s": pa.array(s), "q": pa.array(q), "f": pa.array(f)})

    cols = [F.col(k).cast("int").alias(a) for k, a in zip(keys, names, strict=True)]
    schema = ", ".join([*(f"{a} int" for a in names), "i int, n long, s double, q double, f double"])
    parts = df.select(*cols, doubles(x_col).alias("x"), value.cast("double").alias("v")).mapInArrow(partial, schema)
    summed = parts.groupBy(*names, "i").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "f")])
    return summed.select(*[F.col(a).alias(k) for k, a in zip(keys, names, strict=True)], "i", "n", "s", "q", "f")


def diag_sums(df: DataFrame, keys: Sequence[str], x_col: str, target: Column) -> DataFrame:
    """(keys, n, s2, f): position-wise sums of x*x and target*x as arrays."""
    by = position_sums(df, keys, x_col, target)
    rows = by.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "q", "f"))).alias("p"), F.max("n").alias("n"))
    return rows.select(*keys, "n", F.transform("p", lambda p: p["q"]).alias("s2"), F.transform("p", lambda p: p["f"]).alias("f"))


def diag_posterior(log: DataFrame, lam: float = 1.0, x_col: str = "x") -> DataFrame:
    """(arm, n, prec, f) with prec = lam + sum of x*x, f = sum of reward * x, position by position."""
    sums = diag_sums(log.withColumn("x_", doubles(x_col)), ["arm"], "x_", F.col("reward").cast("double"))
    return sums.select("arm", "n", F.transform("s2", lambda v: v + lam).alias("prec"), "f")


def counter_posterior(log: DataFrame, level: int = 0, lam: float = 1.0, target: Column | None = None) -> DataFrame:
    """(level, code, arm, n, f, theta): cells that were seen; inverse precision 1 / (lam + n)."""
    value = F.col("reward") - 0.5 if target is None else target
    cells = log.groupBy(F.lit(level).alias("level"), F.get("codes", F.lit(level)).alias("code"), "arm").agg(F.count("*").alias("n"), F.sum(value).alias("f"))
    return cells.withColumn("theta", F.col("f") / (F.col("n") + lam))


def _small(table: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Broadcast only where the number of cells that can exist is within the limit."""
    return F.broadcast(table) if rows <= limit else table


def levelwise_counter_fit(log: DataFrame, levels: int, n_arms: int, nbits: int = 4, lam: float = 1.0, eta: float = 0.5, trained: Column | None = None) -> DataFrame:
    """Counter posteriors of all levels, fitted in turn.

    The target of a level is reward - clip(1/2 + sum over lower levels of eta**level * theta); level l
    is fitted when the levels below are final. `log` has codes, arm and reward; with `trained` a row
    counts for so many levels only (those that were active, and the shadow, when it was decided).
    """
    out, rest = [], log.withColumn("_pred", F.lit(0.0)).withColumn("_upto", F.lit(levels) if trained is None else trained)
    for level in range(levels):
        rest = rest.where(F.col("_upto") > level)
        table = durable(counter_posterior(rest, level, lam, F.col("reward") - sigmoid_clip(F.col("_pred"))))
        out.append(table)
        look = _small(table.select("code", "arm", "theta"), (1 << nbits) * n_arms)
        rest = rest.withColumn("code", F.get("codes", F.lit(level))).join(look, ["code", "arm"]).withColumn("_pred", F.col("_pred") + eta**level * F.col("theta")).drop("code", "theta")
    return _union(out)


def _union(tables: list[DataFrame]) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def levelwise_diag_fit(log: DataFrame, levels: int, n_arms: int, nbits: int = 4, lam: float = 1.0, eta: float = 0.5, trained: Column | None = None) -> DataFrame:
    """(level, code, arm, n, prec, f): diagonal models on residuals with an intercept, level by level;
    `trained` as for the counters."""
    out, rest = [], log.withColumn("_pred", F.lit(0.0)).withColumn("_upto", F.lit(levels) if trained is None else trained)
    for level in range(levels):
        at = rest.where(F.col("_upto") > level).withColumn("code", F.get("codes", F.lit(level))).withColumn("_z", add_intercept(F.get("residuals", F.lit(level))))
        sums = diag_sums(at, ["code", "arm"], "_z", F.col("reward") - sigmoid_clip(F.col("_pred")))
        table = durable(sums.select(F.lit(level).alias("level"), "code", "arm", "n", F.transform("s2", lambda v: v + lam).alias("prec"), "f"))
        out.append(table)
        look = _small(table.select("code", "arm", F.zip_with("f", "prec", lambda f, p: f / p).alias("_w")), (1 << nbits) * n_arms)
        rest = at.join(look, ["code", "arm"]).withColumn("_pred", F.col("_pred") + eta**level * dot(F.col("_w"), F.col("_z"))).drop("code", "_w", "_z")
    return _union(out)


def levelwise_linear_fit(log: DataFrame, levels: int, n_arms: int, nbits: int = 4, lam: float = 1.0, eta: float = 0.5, trained: Column | None = None) -> DataFrame:
    """(level, code, arm, n, a, f, cov, mean): full models on residuals with an intercept; the prior of
    level l is lam * 0.25**l; `trained` as for the counters."""
    out, rest = [], log.withColumn("_pred", F.lit(0.0)).withColumn("_upto", F.lit(levels) if trained is None else trained)
    for level in range(levels):
        at = rest.where(F.col("_upto") > level).withColumn("code", F.get("codes", F.lit(level))).withColumn("_z", add_intercept(F.get("residuals", F.lit(level)))).withColumn("_t", F.col("reward") - sigmoid_clip(F.col("_pred")))
        table = durable(solve(gram(at, ["code", "arm"], "_z", "_t"), ["code", "arm"], lam * 0.25**level).withColumn("level", F.lit(level)))
        out.append(table)
        look = _small(table.select("code", "arm", F.col("mean").alias("_w")), (1 << nbits) * n_arms)
        rest = at.join(look, ["code", "arm"]).withColumn("_pred", F.col("_pred") + eta**level * dot(F.col("_w"), F.col("_z"))).drop("code", "_w", "_z", "_t")
    return _union(out)


def rebuild_from_log(log: DataFrame, features: DataFrame, lam: float = 1.0, id_col: str = "row_id") -> DataFrame:
    """The linear posterior of all logged rows after their feature vectors changed; `features` is
    (row_id, x). The prior stays lam."""
    return linear_posterior(log.drop("x").join(features.select(id_col, "x"), id_col), lam)
