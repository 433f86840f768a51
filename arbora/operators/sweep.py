"""Many runs at once: codebooks, models and errors keyed by run, in a number of jobs that does not depend
on how many runs there are.

A run is a set of rows to learn from, given as a condition on each row; a row may belong to many. Tasks
hold the runs' small tables (codebooks, least-squares weights, class means) and add up what their rows
give to each run; sums keyed by (run, level, code) are exchanged, rows never.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import noise
from arbora.functions.arrow import matrix, rows_of
from arbora.functions.vectors import doubles
from arbora.operators.quantize import Codebook, _walk, nearest

#: Ranges that hashes are counted in to find a holdout's bound.
RANGES = 4096


def holdout_bounds(df: DataFrame, n: int, seeds: Sequence[int], id_col: str = "row_id") -> list[tuple[float, object]]:
    """For each seed the (hash, id) of the last of the min(n, half) rows of least keyed hash; the same
    rows as `prepare.split_holdout`. Hashes are counted by range, and only the range that holds the bound
    is ranked."""
    draws = F.array(*[F.struct(F.lit(i).alias("run"), noise.uniform("id", s).alias("u")) for i, s in enumerate(seeds)])
    each = df.select(F.col(id_col).alias("id")).select("id", F.explode(draws).alias("d")).select("id", "d.run", "d.u", F.floor(F.col("d.u") * RANGES).cast("int").alias("at"))
    counts = np.zeros((len(seeds), RANGES), dtype=np.int64)
    for r in each.groupBy("run", "at").count().collect():  # seeds times RANGES rows
        counts[r["run"], r["at"]] = r["count"]
    n = min(n, int(counts[0].sum()) // 2) if len(seeds) else 0
    if n <= 0:
        return [(-1.0, None)] * len(seeds)
    ends = counts.cumsum(axis=1)
    at = [int(np.searchsorted(e, n)) for e in ends]
    rest = [int(n - (e[a - 1] if a else 0)) for e, a in zip(ends, at, strict=True)]
    wanted = F.array(*[F.lit(a) for a in at])
    rank = F.row_number().over(Window.partitionBy("run").orderBy("u", "id"))
    near = each.where(F.col("at") == F.get(wanted, F.col("run"))).withColumn("rank", rank)
    found = {r["run"]: (r["u"], r["id"]) for r in near.where(F.col("rank") == F.get(F.array(*[F.lit(k) for k in rest]), F.col("run"))).collect()}
    return [found[i] for i in range(len(seeds))]


def holdouts(df: DataFrame, n: int, seeds: Sequence[int], id_col: str = "row_id") -> list[Column]:
    """For each seed the condition that holds for its holdout rows."""
    u = lambda s: noise.uniform(id_col, s)
    return [F.lit(False) if last is None else (u(s) < bound) | ((u(s) == F.lit(bound)) & (F.col(id_col) <= F.lit(last))) for s, (bound, last) in zip(seeds, holdout_bounds(df, n, seeds, id_col), strict=True)]


def with_runs(df: DataFrame, fits: Sequence[Column], x_col: str = "x", id_col: str = "row_id") -> DataFrame:
    """(row_id, label, x, fit): rows with a vector, and for each run whether it learns from the row."""
    label = F.col("label").cast("int") if "label" in df.columns else F.lit(None).cast("int")
    return df.select(F.col(id_col).alias("row_id"), label.alias("label"), doubles(x_col).alias("x"), F.array(*[F.coalesce(f, F.lit(False)) for f in fits]).alias("fit")).where("x is not null")


def _flags(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(bool)


def _sums(rows: DataFrame, shape: tuple[int, ...], add: Callable[[pa.RecordBatch, np.ndarray], None]) -> DataFrame:
    """(at, v): what `add` adds to an array of `shape` in all batches, by position; zeros are left out."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                add(b, total)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], names=["at", "v"])

    return rows.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))


def _gather(sums: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The totals as an array; `shape` is bounded by the runs' parameters."""
    out = np.zeros(int(np.prod(shape)))
    found = sums.toPandas()
    out[found["at"].to_numpy(dtype=np.int64)] = found["v"].to_numpy(dtype=float)
    return out.reshape(shape)


def train_codebooks(rows: DataFrame, runs: int, levels: int, nbits: int, iterations: int) -> list[Codebook]:
    """The codebook of every run as `quantize.train_codebook` makes it from the run's rows: two jobs and
    one for each level and iteration. `rows` comes from `with_runs`, and is worth caching."""
    b = 1 << nbits
    each = rows.select("row_id", "x", F.posexplode("fit").alias("run", "own")).where("own")
    first = each.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy("row_id"))).where(F.col("rank") <= b).collect()  # 2**nbits a run
    starts: list[np.ndarray] = []
    for run in range(runs):
        x = np.array([r["x"] for r in sorted((r for r in first if r["run"] == run), key=lambda r: r["rank"])])
        if not len(x):
            raise ValueError(f"run {run} has no rows to train on")
        starts.append(np.concatenate([x, np.tile(x[-1:], (b - len(x), 1))]))
    d, done = starts[0].shape[1], [[] for _ in range(runs)]
    shape = (runs, b, d + 1)
    for _ in range(levels):
        books = [_walk(start, own)[1][-1].copy() for start, own in zip(starts, done, strict=True)]
        for _ in range(iterations):
            shared = rows.sparkSession.sparkContext.broadcast((done, books))

            def add(batch: pa.RecordBatch, total: np.ndarray, shared=shared) -> None:
                x, fit = matrix(batch.column(0))[0], _flags(batch.column(1))
                before, current = shared.value
                for run in range(runs):
                    r = _walk(x[fit[:, run]], before[run])[1][-1]
                    code = nearest(r, current[run])
                    np.add.at(total[run, :, :d], code, r)
                    total[run, :, d] += np.bincount(code, minlength=b)

            total = _gather(_sums(rows.select("x", "fit"), shape, add), shape)
            for run in range(runs):
                seen = total[run, :, d] > 0
                books[run] = books[run].copy()
                books[run][seen] = total[run, seen, :d] / total[run, seen, d:]
        for own, book in zip(done, books, strict=True):
            own.append(book)
    return done


def encode_runs(rows: DataFrame, books: Sequence[Codebook]) -> DataFrame:
    """`rows` with `codes`: for each run the codes of its levels, one after another."""
    shared = rows.sparkSession.sparkContext.broadcast(list(books))

    @F.arrow_udf("array<int>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            v = matrix(x)[0]
            codes = [c for book in shared.value for c in _walk(v, book)[0]] if len(v) else []
            yield rows_of(np.stack(codes, axis=1).astype(np.int32)) if codes else pa.array([[]] * len(v), pa.list_(pa.int32()))

    return rows.withColumn("codes", look("x"))


def _codes(column: pa.Array, runs: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), runs, -1)


def additive_models(coded: DataFrame, runs: int, depths: Sequence[int], n_arms: int, nbits: int, ridge: float = 1e-8) -> np.ndarray:
    """theta by [run, depth, level * 2**nbits + code, arm], as `models.fit_additive_ols` makes it from
    each run's rows. One job counts code pairs and codes by label of all runs; the systems are solved
    run by run in tasks."""
    b, levels = 1 << nbits, max(depths)
    size = levels * b
    shape = (runs, size, size + n_arms)

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        fit, codes = _flags(batch.column(0)), _codes(batch.column(1), runs)
        label = batch.column(2).fill_null(-1).to_numpy()
        for run in range(runs):
            at = codes[fit[:, run], run, :levels] + np.arange(levels) * b
            own = label[fit[:, run]]
            known = (own >= 0) & (own < n_arms)
            for i in range(levels):
                for j in range(levels):
                    np.add.at(total[run], (at[:, i], at[:, j]), 1.0)
                np.add.at(total[run], (at[known, i], size + own[known]), 1.0)

    sums = _sums(coded.select("fit", "codes", "label"), shape, add)
    per = size * (size + n_arms)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        run, flat = int(pdf["run"].iloc[0]), np.zeros(per)
        flat[pdf["at"].to_numpy(dtype=np.int64) - run * per] = pdf["v"].to_numpy()
        g, h, out = flat.reshape(size, -1)[:, :size], flat.reshape(size, -1)[:, size:], []
        for depth in depths:
            n = depth * b
            theta = np.zeros((size, n_arms))
            theta[:n] = np.linalg.lstsq(g[:n, :n] + ridge * np.eye(n), h[:n], rcond=1e-12)[0]
            out.append((run, depth, theta.ravel()))
        return pd.DataFrame(out, columns=["run", "depth", "theta"])

    keyed = sums.select(F.floor(F.col("at") / per).cast("int").alias("run"), "at", "v")
    theta = np.zeros((runs, len(depths), size, n_arms))
    for r in keyed.groupBy("run").applyInPandas(solve, "run int, depth int, theta array<double>").collect():  # one a run and depth
        theta[r["run"], list(depths).index(r["depth"])] = np.array(r["theta"]).reshape(size, n_arms)
    return theta


def additive_errors(coded: DataFrame, theta: np.ndarray, depths: Sequence[int], n_arms: int, nbits: int) -> DataFrame:
    """(run, depth, delta, n_fit, n_eval): for each run the mean over the rows that it did not learn from
    of the greatest |indicator - sum of theta| over arms. One job."""
    runs, b = len(theta), 1 << nbits
    shared = coded.sparkSession.sparkContext.broadcast(theta)
    shape = (runs, len(depths), 3)

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        fit, codes = _flags(batch.column(0)), _codes(batch.column(1), runs)
        y = batch.column(2).fill_null(-1).to_numpy()[:, None] == np.arange(n_arms)
        for run in range(runs):
            judged = ~fit[:, run]
            for k, depth in enumerate(depths):
                p = sum(shared.value[run, k, level * b + codes[judged, run, level]] for level in range(depth))
                total[run, k] += [np.abs(y[judged] - p).max(axis=1).sum(), fit[:, run].sum(), judged.sum()]

    sums = _sums(coded.select("fit", "codes", "label"), shape, add)
    cell = F.floor(F.col("at") / 3).cast("int")
    value = lambda i: F.coalesce(F.sum(F.when(F.col("at") % 3 == i, F.col("v"))), F.lit(0.0))
    by = sums.groupBy(cell.alias("cell")).agg(value(0).alias("e"), value(1).alias("f"), value(2).alias("n"))
    depth = F.get(F.array(*[F.lit(k) for k in depths]), F.col("cell") % len(depths))
    delta = F.when(F.col("n") > 0, F.col("e") / F.col("n"))
    return by.select(F.floor(F.col("cell") / len(depths)).cast("int").alias("run"), depth.alias("depth"), delta.alias("delta"), F.col("f").cast("long").alias("n_fit"), F.col("n").cast("long").alias("n_eval"))


def class_means(coded: DataFrame, runs: int, depth: int, n_arms: int, nbits: int, eta: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Plain and smoothed means by [run, level, code, class], as `models.fit_boosted_centroids` makes them
    from each run's rows: one job a level."""
    b = 1 << nbits
    mean, smooth = np.zeros((runs, depth, b, n_arms)), np.full((runs, depth, b, n_arms), 1.0 / n_arms)
    for level in range(depth):
        shared = coded.sparkSession.sparkContext.broadcast(mean[:, :level])
        shape = (runs, b, n_arms + 1)

        def add(batch: pa.RecordBatch, total: np.ndarray, shared=shared, level=level) -> None:
            fit, codes = _flags(batch.column(0)), _codes(batch.column(1), runs)
            y = (batch.column(2).fill_null(-1).to_numpy()[:, None] == np.arange(n_arms)).astype(float)
            for run in range(runs):
                own = fit[:, run]
                p = sum((eta**j * shared.value[run, j, codes[own, run, j]] for j in range(level)), np.zeros((int(own.sum()), n_arms)))
                np.add.at(total[run, :, :n_arms], codes[own, run, level], y[own] - np.clip(p, 0, 1))
                total[run, :, n_arms] += np.bincount(codes[own, run, level], minlength=b)

        total = _gather(_sums(coded.select("fit", "codes", "label"), shape, add), shape)
        s, n = total[:, :, :n_arms], total[:, :, n_arms:]
        mean[:, level] = np.where(n > 0, s / np.maximum(n, 1), 0.0)
        smooth[:, level] = np.where(n > 0, (s + 1.0 / n_arms) / (n + 1), 1.0 / n_arms)
    return mean, smooth


def boosted_errors(coded: DataFrame, judges: Sequence[Column] | None, mean: np.ndarray, smooth: np.ndarray, depths: Sequence[int], eta: float = 0.5) -> np.ndarray:
    """Sums by [run, depth, (plain error, smoothed error, rows)] over the rows that each run is judged on
    (those it did not learn from, or where its condition in `judges` holds). One job."""
    runs, n_arms = mean.shape[0], mean.shape[3]
    shared = coded.sparkSession.sparkContext.broadcast((mean, smooth))
    shape = (runs, len(depths), 3)

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        judged, codes = _flags(batch.column(0)), _codes(batch.column(1), runs)
        y = (batch.column(2).fill_null(-1).to_numpy()[:, None] == np.arange(n_arms)).astype(float)
        for run in range(runs):
            own = judged[:, run]
            for k, depth in enumerate(depths):
                for i, table in enumerate(shared.value):
                    p = sum(eta**level * table[run, level, codes[own, run, level]] for level in range(depth))
                    total[run, k, i] += np.abs(np.clip(p, 0, 1) - y[own]).mean(axis=1).sum() if own.any() else 0.0
                total[run, k, 2] += own.sum()

    flags = F.transform("fit", lambda f: ~f) if judges is None else F.array(*judges)
    return _gather(_sums(coded.select(flags.alias("judged"), "codes", "label"), shape, add), shape)


def linear_errors(contexts: DataFrame, run: Column, weights: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Sums by [run, (error, rows)] of `diagnose.delta_linear`, each row judged by the model of its run."""
    n_arms = intercepts.shape[1]
    shared = contexts.sparkSession.sparkContext.broadcast((weights, intercepts))
    shape = (len(weights), 2)

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        x, there = matrix(batch.column(0))
        label, at = batch.column(1).fill_null(-1).to_numpy(), batch.column(2).to_numpy()
        w, b = shared.value
        for r in range(len(w)):
            own = there & (at == r)
            if own.any():
                p = np.clip(x[own] @ w[r].T + b[r], 0, 1)
                p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-10)
                total[r] += [np.abs(p - (label[own][:, None] == np.arange(n_arms))).mean(axis=1).sum(), own.sum()]

    return _gather(_sums(contexts.select(doubles("x").alias("x"), F.col("label").cast("int").alias("label"), run.cast("int").alias("run")), shape, add), shape)


def delta_grid(contexts: DataFrame, depths: Sequence[int], seeds: Sequence[int], holdout: int, n_arms: int, nbits: int = 4, iterations: int = 10) -> DataFrame:
    """(depth, seed, delta, n_fit, n_eval): for each seed a codebook and an additive model from its own
    holdout, judged on the rest, at every depth. All seeds and depths share each job."""
    rows = with_runs(contexts, holdouts(contexts, holdout, seeds)).persist()
    try:
        books = train_codebooks(rows, len(seeds), max(depths), nbits, iterations)
        coded = encode_runs(rows, books).select("fit", "codes", "label").persist()
        theta = additive_models(coded, len(seeds), depths, n_arms, nbits)
        found = additive_errors(coded, theta, depths, n_arms, nbits).collect()  # one a run and depth
        coded.unpersist()
    finally:
        rows.unpersist()
    out = [(r["depth"], seeds[r["run"]], r["delta"], r["n_fit"], r["n_eval"]) for r in found]
    return contexts.sparkSession.createDataFrame(sorted(out), "depth int, seed int, delta double, n_fit long, n_eval long")


def fold_of(folds: int, id_col: str = "row_id") -> Column:
    """The fold of a row, by a keyed hash of its id."""
    return F.floor(noise.uniform(id_col, 17) * max(folds, 1)).cast("int")



# ---------------------------------------------------------------------------
# Sweeps over synthetic tables: one run for each (dimension, number of arms, seed).

Grid = Sequence[tuple[int, int, int]]


def grid_contexts(ids: DataFrame, grid: Grid) -> DataFrame:
    """(run, seed, arms, row_id, x, label): each id once in every run of (d, K, seed), with d normal
    features (zeros up to the grid's greatest d) and the arm of the greatest score under
    `prepare.linear_weights` as label. Drawn by keys and without an exchange."""
    from arbora.operators.prepare import linear_weights

    width = max((d for d, _, _ in grid), default=0)
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(d).alias("d"), F.lit(k).alias("arms"), F.lit(seed).alias("seed")) for r, (d, k, seed) in enumerate(grid)])
    weights = [np.pad(linear_weights(d, k, seed), ((0, 0), (0, width - d))) for d, k, seed in grid]
    shared = ids.sparkSession.sparkContext.broadcast(weights)  # one small matrix a run

    @F.arrow_udf("int")
    def best(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, run in batches:
            v, at = matrix(x)[0], run.to_numpy()
            out = np.zeros(len(v), dtype=np.int32)
            for r in np.unique(at):
                out[at == r] = np.argmax(v[at == r] @ shared.value[r].T, axis=1)
            yield pa.array(out)

    rows = ids.select("row_id", F.explode(runs).alias("g")).select("row_id", "g.*")
    x = F.array(*[F.when(F.col("d") > j, noise.normal("row_id", F.col("seed"), j)).otherwise(0.0) for j in range(width)])
    drawn = rows.withColumn("x", x)
    return drawn.select("run", "seed", "arms", "row_id", "x", best("x", "run").alias("label"))


def sufficiency_sweep(ids: DataFrame, grid: Grid, kind: str = "linear", lam: float = 1.0, b: int = 16) -> DataFrame:
    """(d, K, ratio, method, seed, final_regret, regret_rate): for every run the rows of one keyed half
    are logged with uniform arms, models (`linear` or `diag`) are fitted to the log, and the other half is
    decided by their means and by uniform arms. `ratio` is rows / (b * K * d * d).

    Statistics are keyed by (run, arm); the number of jobs does not depend on the grid.
    """
    from arbora.functions.lineage import durable
    from arbora.operators import posterior, refit

    rows = durable(grid_contexts(ids, grid)).withColumn("arm", F.floor(noise.uniform("row_id", F.col("seed"), 5) * F.col("arms")).cast("int"))
    rows = rows.withColumn("reward", (F.col("arm") == F.col("label")).cast("double")).withColumn("logged", noise.uniform("row_id", F.col("seed"), 6) < 0.5)
    log, rest = rows.where("logged"), rows.where(~F.col("logged"))
    if kind == "linear":
        fitted = posterior.solve(posterior.gram(log, ["run", "arm"]), ["run", "arm"], lam).select(F.col("run").alias("stretch"), "arm", "mean")
    else:
        sums = posterior.diag_sums(log, ["run", "arm"], "x", F.col("reward"))
        fitted = sums.select(F.col("run").alias("stretch"), "arm", F.zip_with("f", "s2", lambda f, q: f / (q + lam)).alias("mean"))
    chosen = refit.choose_by_stretch(rest.select("run", "row_id", "x", "label"), durable(fitted), F.col("run"))
    both = chosen.select("run", "label", "arm", F.lit(kind).alias("method")).unionByName(rest.select("run", "label", "arm", F.lit("uniform").alias("method")))
    miss = F.coalesce((F.col("arm") != F.col("label")).cast("double"), F.lit(1.0))
    by = both.groupBy("run", "method").agg(F.sum(miss).alias("final_regret"), F.avg(miss).alias("regret_rate"), F.count("*").alias("n"))
    at = lambda i: F.get(F.array(*[F.lit(g[i]) for g in grid]), F.col("run"))
    named = by.select(at(0).alias("d"), at(1).alias("K"), "method", at(2).alias("seed"), "final_regret", "regret_rate", "n")
    return named.select("d", "K", (F.col("n") / (b * F.col("K") * F.col("d") * F.col("d"))).alias("ratio"), "method", "seed", "final_regret", "regret_rate")
