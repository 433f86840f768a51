"""Scores of every arm for whole tables of contexts, and the choice of an arm.

A draw of a Gaussian weight vector enters a decision only through its product with the context,
which is normal with the posterior mean and variance of that product. So one keyed normal number a
context and arm replaces the draw of a vector, without any factorisation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from arbora.functions import noise
from arbora.functions.arrow import matrix
from arbora.functions.vectors import add_intercept, argmax_arm, dot, doubles, squared_norm
from arbora.operators.prepare import expand_arms

#: Bytes of posterior tables that are sent to every task, at most; more is joined instead.
SEND_BYTES = 64 << 20
#: Parts that contexts are dealt over for each key where large posteriors are joined.
SALTS = 32


def _quadratic(cov: Column, x: Column) -> Column:
    """x' cov x of a row-major matrix."""
    d = F.size(x)
    return F.aggregate(F.transform(x, lambda v, i: v * dot(F.slice(cov, i * d + 1, d), x)), F.lit(0.0), lambda s, v: s + v)


def _bytes(table: DataFrame, *arrays: str) -> int:
    return 8 * sum(v or 0 for v in table.agg(*[F.sum(F.size(c)) for c in arrays]).first())


def sent(look: DataFrame, cells: int, cell_bytes: int = 64) -> DataFrame:
    """A lookup table, broadcast where its counted cells are within SEND_BYTES."""
    return F.broadcast(look) if cells * cell_bytes <= SEND_BYTES else look


def _salted_join(rows: DataFrame, models: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a model table of few keys, each key's rows dealt over SALTS tasks."""
    spread = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


def score_linear(contexts: DataFrame, posterior: DataFrame, x_col: str = "x", variance: bool = True) -> DataFrame:
    """`contexts` once for each arm of the posterior, with `mean` = x . mean and, if asked for, `var` =
    x' cov x. Columns of these names that the contexts had, such as a logged arm, are replaced. A null
    vector has null scores.

    The matrices are measured first. Up to SEND_BYTES they go to the tasks, which score a batch by one
    product an arm; beyond that contexts are joined to them arm by arm.
    """
    contexts = contexts.drop("arm", "mean", "var")
    fields = ["mean", "cov"] if variance else ["mean"]
    if _bytes(posterior, *fields) > SEND_BYTES:
        long = contexts.withColumn("arm", F.explode(F.array(*[F.lit(r[0]) for r in posterior.select("arm").collect()])))
        joined = _salted_join(long, posterior.select("arm", *[F.col(c).alias(f"_{c}") for c in fields]), ["arm"])
        x = doubles(x_col)
        out = joined.withColumn("mean", dot(F.col("_mean"), x))
        return (out.withColumn("var", F.greatest(_quadratic(F.col("_cov"), x), F.lit(0.0))) if variance else out).drop("_mean", "_cov")
    models = sorted((tuple([r["arm"], *[np.array(r[c]) for c in fields]]) for r in posterior.select("arm", *fields).collect()), key=lambda m: m[0])
    arms = np.array([m[0] for m in models], dtype=np.int32)
    means = np.stack([m[1] for m in models], axis=1) if models else None
    shared = contexts.sparkSession.sparkContext.broadcast((means, [m[2] for m in models] if variance else []))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, covs = shared.value
        for b in batches:
            x, there = matrix(b.column(b.num_columns - 1))
            if not len(arms) or not there.any():
                x = np.full((len(there), 0 if means is None else means.shape[0]), np.nan)
            row = np.repeat(np.arange(len(x)), len(arms))
            gone = None if there.all() else np.repeat(~there, len(arms))
            new = [pa.array(np.tile(arms, len(x)))]
            if len(arms):
                new.append(pa.array((x @ means).ravel(), mask=gone))
                if variance:
                    new.append(pa.array(np.stack([np.einsum("nd,nd->n", x @ c.reshape(x.shape[1], -1), x) for c in covs], axis=1).clip(0).ravel(), mask=gone))
            else:
                new += [pa.array([], pa.float64())] * (1 + variance)
            old = b.drop_columns([names[-1]]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*old.columns, *new], names=[*names[:-1], "arm", "mean", *(["var"] if variance else [])])

    names = [*contexts.columns, "_x"]
    schema = StructType([*contexts.schema.fields, StructField("arm", IntegerType()), StructField("mean", DoubleType()), *([StructField("var", DoubleType())] if variance else [])])
    return contexts.withColumn("_x", doubles(x_col)).mapInArrow(apply, schema)


def thompson(scored: DataFrame, nu: float, seed: int, keys: tuple[str, ...] = ("row_id", "arm")) -> DataFrame:
    """`score` = mean + nu * sqrt(var) * a keyed normal."""
    return scored.withColumn("score", F.col("mean") + nu * F.sqrt(F.greatest(F.col("var"), F.lit(0.0))) * noise.normal(*keys, seed))


def upper_bound(scored: DataFrame, alpha: float = 1.0) -> DataFrame:
    """`score` = mean + alpha * sqrt(var)."""
    return scored.withColumn("score", F.col("mean") + alpha * F.sqrt(F.greatest(F.col("var"), F.lit(0.0))))


def score_mean_linear(contexts: DataFrame, posterior: DataFrame) -> DataFrame:
    return score_linear(contexts, posterior, variance=False).withColumn("score", F.col("mean"))


def score_ts_linear(contexts: DataFrame, posterior: DataFrame, nu: float = 0.1, seed: int = 0) -> DataFrame:
    return thompson(score_linear(contexts, posterior), nu, seed)


def score_linucb(contexts: DataFrame, posterior: DataFrame, alpha: float = 1.0, x_col: str = "x") -> DataFrame:
    """Linear upper confidence bound on any vector column."""
    return upper_bound(score_linear(contexts, posterior, x_col), alpha)


def score_ucb_on_prediction(predictions: DataFrame, posterior: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(row_id, arm, pred, g) rows -> `score` = pred + gamma * sqrt(g' Z^-1 g), Z = lam * I + sum g g'.

    Rows of an arm without a matrix are left out. As in `score_linear`, matrices go to the tasks by size.
    """
    predictions = predictions.drop("score")
    bound = lambda var: F.col("pred") + gamma * F.sqrt(F.greatest(var, F.lit(0.0)))
    if _bytes(posterior, "cov") > SEND_BYTES:
        joined = _salted_join(predictions, posterior.select("arm", F.col("cov").alias("_c")), ["arm"])
        return joined.withColumn("score", bound(_quadratic(F.col("_c"), doubles("g")))).drop("_c")
    shared = predictions.sparkSession.sparkContext.broadcast({r["arm"]: np.array(r["cov"]) for r in posterior.select("arm", "cov").collect()})

    @F.pandas_udf("double")
    def quadratic(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for arm, g in batches:
            out = np.full(len(arm), np.nan)
            for a in np.unique(arm.dropna()):
                at = np.flatnonzero((arm == a).to_numpy() & g.notna().to_numpy())
                if a in shared.value and len(at):
                    x = np.stack(g.iloc[at].to_numpy())
                    out[at] = np.einsum("nd,nd->n", x @ shared.value[a].reshape(x.shape[1], -1), x)
            yield pd.Series(out)

    known = predictions.where(F.col("arm").isin(list(shared.value))) if shared.value else predictions.limit(0)
    return known.withColumn("score", bound(quadratic("arm", doubles("g"))))


def score_diag(contexts: DataFrame, posterior: DataFrame, x_col: str = "x") -> DataFrame:
    """Mean sum f/p*x and variance sum x*x/p for each arm of a diagonal posterior.

    The posterior is one row an arm. As in `score_linear` it is measured: up to SEND_BYTES it goes to
    the tasks, and beyond that each arm's contexts are dealt over several of them.
    """
    arms = sorted(r[0] for r in posterior.select("arm").collect())
    x, contexts = doubles(x_col), contexts.drop("arm", "mean", "var")
    long = contexts.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms]))) if arms else contexts.withColumn("arm", F.lit(None).cast("int")).limit(0)
    mean = dot(F.zip_with("_f", "_p", lambda f, p: f / p), x)
    var = dot(F.zip_with(x, "_p", lambda v, p: v / p), x)
    models = posterior.select("arm", F.col("prec").alias("_p"), F.col("f").alias("_f"))
    joined = long.join(F.broadcast(models), "arm") if _bytes(models, "_p", "_f") <= SEND_BYTES else _salted_join(long, models, ["arm"])
    return joined.withColumn("mean", mean).withColumn("var", var).drop("_p", "_f")


#: Proposals for a gamma number; one is accepted with a chance of over 0.95, so none is once in 1e13 draws.
GAMMA_TRIES = 10


def gamma(shape: Column, *keys: Column | str | int) -> Column:
    """A keyed gamma number of unit rate, for shapes of 1 and more: Marsaglia and Tsang's squeeze-free
    method, the first accepted of GAMMA_TRIES proposals (the mode if none is)."""
    d = shape - 1.0 / 3
    tries = []
    for t in range(GAMMA_TRIES):
        z = noise.normal(*keys, 100 + t)
        v = F.pow(1 + z / F.sqrt(9 * d), F.lit(3.0))
        accepted = F.log(noise.uniform(*keys, 200 + t)) < z * z / 2 + d - d * v + d * F.log(v)
        tries.append(F.when((v > 0) & accepted, d * v))
    return F.coalesce(*tries, d)


def sample_nig_means(posterior: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(draw, arm, mean, variance): variance ~ inverse gamma(alpha, beta), mean ~ N(mu, variance / lam)."""
    fields = ["arm", "mu", "lam", "alpha", "beta"]
    arms = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in fields]) for r in posterior.select(*fields).collect()])  # one an arm
    rows = posterior.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(arms).alias("a")).select("draw", "a.*")
    # below a shape of 1: a gamma of shape + 1 times u ** (1 / shape)
    small = F.col("alpha") < 1
    g = gamma(F.col("alpha") + small.cast("double"), "draw", "arm", seed) * F.when(small, F.pow(noise.uniform("draw", "arm", seed, 3), 1 / F.col("alpha"))).otherwise(1.0)
    drawn = rows.withColumn("variance", F.col("beta") / F.greatest(g, F.lit(1e-10)))
    return drawn.select("draw", "arm", (F.col("mu") + noise.normal("draw", "arm", seed) * F.sqrt(F.col("variance") / F.col("lam"))).alias("mean"), "variance")


def select_ts_nig(posterior: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(draw, arm): the arm of the greatest sampled mean in each draw."""
    return sample_nig_means(posterior, draws, seed).groupBy("draw").agg(argmax_arm(F.col("arm"), F.col("mean")).alias("arm"))


def _weighted(rows: DataFrame, keep: list[str], nu: float, seed: int, eta: float) -> DataFrame:
    """(keep, mean, score) from `level_mean` and `level_var`, arrays over the levels."""
    levels = F.arrays_zip("level_mean", "level_var")
    weight = lambda l: F.pow(F.lit(eta), l)
    mean = F.aggregate(F.transform("level_mean", lambda m, l: weight(l) * m), F.lit(0.0), lambda s, v: s + v)
    if not nu:
        return rows.select(*keep, mean.alias("mean"), mean.alias("score"))
    draw = F.transform(levels, lambda s, l: weight(l) * nu * F.sqrt(F.greatest(s["level_var"], F.lit(0.0))) * noise.normal("row_id", "arm", l, seed))
    return rows.select(*keep, mean.alias("mean"), (mean + F.aggregate(draw, F.lit(0.0), lambda s, v: s + v)).alias("score"))


def score_counter_rq(encoded: DataFrame, posterior: DataFrame, depth: int, n_arms: int, eta: float = 0.5, nu: float = 0.0, lam: float = 1.0, seed: int = 0) -> DataFrame:
    """(row_id, arm, mean, score): sum over levels of eta**level * (theta + nu * sqrt(1/(lam+n)) * z).

    A cell that was never seen has the prior: theta 0, inverse precision 1 / lam. Each level is one
    lookup of all arms' cells by the context's code; rows are never exchanged where the table is small.
    """
    rows, size = encoded.select("row_id", F.slice("codes", 1, depth).alias("codes")), posterior.count()
    for level in range(depth):
        cells = F.map_from_entries(F.collect_list(F.struct("arm", F.struct("n", "theta"))))
        look = posterior.where(F.col("level") == level).groupBy(F.col("code").alias("_code")).agg(cells.alias(f"_cells_{level}"))
        rows = rows.join(sent(look, size), F.get("codes", F.lit(level)) == F.col("_code"), "left").drop("_code")
    long = expand_arms(rows, n_arms)
    mean = F.array(*[F.coalesce(F.try_element_at(F.col(f"_cells_{level}"), F.col("arm"))["theta"], F.lit(0.0)) for level in range(depth)])
    var = F.array(*[1 / (F.coalesce(F.try_element_at(F.col(f"_cells_{level}"), F.col("arm"))["n"], F.lit(0)) + F.lit(float(lam))) for level in range(depth)])
    return _weighted(long.select("row_id", "arm", mean.alias("level_mean"), var.alias("level_var")), ["row_id", "arm"], nu, seed, eta)


#: Means and variances of all arms (n, arms) for contexts (n, d) of one cell, from the cell's models by arm.
Model = Callable[[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]], int], tuple[np.ndarray, np.ndarray]]


def _score_cells(encoded: DataFrame, posterior: DataFrame, fields: tuple[str, str], depth: int, n_arms: int, model: Model) -> DataFrame:
    """(row_id, arm, level_mean, level_var): models of a small posterior table applied batch by batch."""
    tables: dict[tuple[int, int], dict[int, tuple]] = {}
    for r in posterior.where(F.col("level") < depth).select("level", "code", "arm", *fields).collect():
        tables.setdefault((r["level"], r["code"]), {})[r["arm"]] = (np.array(r[fields[0]]), np.array(r[fields[1]]))
    shared = encoded.sparkSession.sparkContext.broadcast(tables)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            mean, var = np.zeros((n, n_arms, depth)), np.zeros((n, n_arms, depth))
            for level in range(depth):
                code = b.column(1 + 2 * level).to_numpy(zero_copy_only=False)
                z, _ = matrix(b.column(2 + 2 * level))
                for c in np.unique(code[~np.isnan(code.astype(float))]):
                    at = np.flatnonzero(code == c)
                    mean[at, :, level], var[at, :, level] = model(z[at], shared.value.get((level, int(c)), {}), level)
            ends = pa.array(np.arange(0, (n * n_arms + 1) * depth, depth, dtype=np.int32)) if depth else None
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1))) for v in (mean, var)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(n), n_arms))), pa.array(np.tile(np.arange(n_arms, dtype=np.int32), n)), *lists], names=["row_id", "arm", "level_mean", "level_var"])

    at = [c for level in range(depth) for c in (F.get("codes", F.lit(level)).alias(f"c{level}"), add_intercept(F.get("residuals", F.lit(level))).alias(f"z{level}"))]
    schema = StructType([encoded.schema["row_id"], StructField("arm", IntegerType()), StructField("level_mean", ArrayType(DoubleType())), StructField("level_var", ArrayType(DoubleType()))])
    return encoded.select("row_id", *at).mapInArrow(apply, schema)


def _by_level(encoded: DataFrame, posterior: DataFrame, fields: tuple[str, str], depth: int, n_arms: int, mean: Column, var: Column) -> DataFrame:
    """The same for a large posterior table, joined by (level, code, arm); `z` is the level's vector."""
    at = F.transform(F.slice("codes", 1, depth), lambda c, l: F.struct(l.alias("level"), c.alias("code"), add_intercept(F.get("residuals", l)).alias("z")))
    rows = expand_arms(encoded.select("row_id", F.explode(at).alias("_l")).select("row_id", "_l.*"), n_arms)
    joined = rows.join(posterior.select("level", "code", "arm", *fields), ["level", "code", "arm"], "left")
    each = joined.groupBy("row_id", "arm").agg(F.sort_array(F.collect_list(F.struct("level", mean.alias("m"), var.alias("v")))).alias("s"))
    return each.select("row_id", "arm", F.transform("s", lambda s: s["m"]).alias("level_mean"), F.transform("s", lambda s: s["v"]).alias("level_var"))


def score_diag_rq(encoded: DataFrame, posterior: DataFrame, depth: int, n_arms: int, eta: float = 0.5, nu: float = 0.0, lam: float = 1.0, seed: int = 0) -> DataFrame:
    """As the counters, with a diagonal model on the level's residual and an intercept."""
    fields = ("prec", "f")
    if _bytes(posterior, *fields) > SEND_BYTES:
        z = F.col("z")
        mean = F.coalesce(dot(F.zip_with("f", "prec", lambda f, p: f / p), z), F.lit(0.0))
        var = F.coalesce(dot(F.zip_with(z, "prec", lambda v, p: v * v / p), F.transform(z, lambda v: F.lit(1.0))), squared_norm(z) / lam)
        rows = _by_level(encoded, posterior, fields, depth, n_arms, mean, var)
    else:

        def model(z: np.ndarray, cell: dict, level: int) -> tuple[np.ndarray, np.ndarray]:
            mean, var = np.zeros((len(z), n_arms)), np.repeat((z * z).sum(axis=1, keepdims=True) / lam, n_arms, axis=1)
            for arm, (prec, f) in cell.items():
                mean[:, arm], var[:, arm] = z @ (f / prec), (z * z) @ (1 / prec)
            return mean, var

        rows = _score_cells(encoded, posterior, fields, depth, n_arms, model)
    return _weighted(rows, ["row_id", "arm"], nu, seed, eta)


def score_linear_rq(encoded: DataFrame, posterior: DataFrame, depth: int, n_arms: int, eta: float = 0.5, nu: float = 0.0, lam: float = 1.0, seed: int = 0) -> DataFrame:
    """As the counters, with a full model; the variance has a jitter of 1e-6 * 10**level * |r|**2."""
    fields, scale = ("mean", "cov"), nu * nu if nu else 1.0
    if _bytes(posterior, *fields) > SEND_BYTES:
        z = F.col("z")
        mean = F.coalesce(dot(F.col("mean"), z), F.lit(0.0))
        jitter = 1e-6 * F.pow(F.lit(10.0), F.col("level")) * squared_norm(z) / scale
        var = F.coalesce(_quadratic(F.col("cov"), z), squared_norm(z) / (lam * F.pow(F.lit(0.25), F.col("level")))) + jitter
        rows = _by_level(encoded, posterior, fields, depth, n_arms, mean, var)
    else:

        def model(z: np.ndarray, cell: dict, level: int) -> tuple[np.ndarray, np.ndarray]:
            norm = (z * z).sum(axis=1, keepdims=True)
            mean, var = np.zeros((len(z), n_arms)), np.repeat(norm / (lam * 0.25**level), n_arms, axis=1)
            for arm, (w, cov) in cell.items():
                mean[:, arm], var[:, arm] = z @ w, np.einsum("nd,nd->n", z @ cov.reshape(z.shape[1], -1), z)
            return mean, var + 1e-6 * 10.0**level * norm / scale

        rows = _score_cells(encoded, posterior, fields, depth, n_arms, model)
    return _weighted(rows, ["row_id", "arm"], nu, seed, eta)


def choose(scored: DataFrame, by: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(by, arm): the arm of the greatest score; the lowest of equal ones; NaN never wins."""
    return scored.groupBy(*by).agg(argmax_arm(F.col("arm"), F.col("score")).alias("arm"))


def select_uniform(contexts: DataFrame, n_arms: int, seed: int) -> DataFrame:
    return contexts.withColumn("arm", F.floor(noise.uniform("row_id", seed, 5) * n_arms).cast("int"))


def select_eps_greedy(chosen: DataFrame, n_arms: int, seed: int, eps: float | Column = 0.05) -> DataFrame:
    """(row_id, arm[, round]) with a share `eps` of the arms replaced by uniform ones; a null arm (no
    model) is always uniform."""
    share = eps if isinstance(eps, Column) else F.lit(float(eps))
    explore = F.col("arm").isNull() | (noise.uniform("row_id", seed, 4) < share)
    return chosen.withColumn("arm", F.when(explore, F.floor(noise.uniform("row_id", seed, 5) * n_arms).cast("int")).otherwise(F.col("arm")))


def decaying_eps(eps0: float = 0.1, round_col: str = "round") -> Column:
    """eps0 / ln(round + 1), rounds counted from 1."""
    return F.lit(eps0) / F.log(F.col(round_col) + 1.0)
