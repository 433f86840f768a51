"""Boosted regression trees of the reward on a context and an arm, grown from histograms.

Every feature is cut into at most `bins` quantile bins. A level of a tree is one pass: tasks add up the
residuals and counts of their rows by (node, feature, bin), the exchange carries these sums only, and
running sums over the bins of a node and feature give the gain of every cut. The cuts that are chosen,
one a node, are all that reaches the driver.

Several models grow in the same passes: model r learns from the rounds up to its own end, so a schedule
of refits takes as many jobs as one fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import noise
from arbora.functions.arrow import matrix
from arbora.functions.lineage import durable
from arbora.functions.vectors import doubles

#: Rows up to which quantiles are read off the rows; of larger logs the expected size of the sample that
#: parts each feature's values into about SLICES slices, in which the exact quantiles are then found.
QUANTILE_ROWS, SLICES = 1 << 16, 256
#: Trees after which predictions are written, so that passes need not walk all earlier trees.
REFRESH = 16


@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of k are 2k (bin at most the cut's) and 2k + 1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 << depth
        return Tree(np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32), np.zeros(n), np.zeros(n, dtype=np.int64))

    def nodes(self, bins: np.ndarray, arm: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        d, node, row = bins.shape[1], np.ones(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(len(self.feature).bit_length() - 2):
            f = self.feature[node]
            value = np.where(f < d, bins[row, np.clip(f, 0, d - 1)], arm == f - d)
            node = np.where(f >= 0, 2 * node + (value > self.cut[node]), node)
        return node


@dataclass
class Boosted:
    """A model: limits of bins by feature, the mean reward, and trees that add to it."""

    limits: list[np.ndarray]
    n_arms: int
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """How many limits of its feature lie below each value."""
        return np.stack([np.searchsorted(t, x[:, i], side="left") for i, t in enumerate(self.limits)], axis=1) if len(self.limits) else np.zeros((len(x), 0), dtype=np.int64)

    def predict(self, bins: np.ndarray, arm: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += tree.value[tree.nodes(bins, arm)]
        return out


def quantile_limits(log: DataFrame, bins: int, x_col: str = "x", id_col: str = "row_id") -> list[np.ndarray]:
    """For each feature the values of rank ceil(k * n / bins), k = 1 .. bins - 1, of all rows.

    A keyed sample only parts each feature's values into SLICES: tasks count the rows by slice, and the
    slices that hold a wanted rank are ranked by Spark, each on its own.
    """
    rows = log.select(F.col(id_col).alias("id"), doubles(x_col).alias("x")).where("x is not null")
    n = rows.count()
    if not n:
        raise ValueError("no rows to learn from")
    sample = rows if n <= QUANTILE_ROWS else rows.where(noise.uniform("id", 21) < QUANTILE_ROWS / n)
    x = np.sort(np.array([r["x"] for r in sample.select("x").collect()], dtype=float), axis=0)  # about QUANTILE_ROWS vectors at most
    ranks = -(-np.arange(1, bins) * n // bins)
    if n <= QUANTILE_ROWS:
        return list(x[ranks - 1].T)
    edges = [np.unique(column[:: -(-len(x) // SLICES)]) for column in x.T] if len(x) else [np.zeros(0)] * len(rows.first()["x"])
    counts = [np.zeros(len(e) + 1, dtype=np.int64) for e in edges]
    for r in _slices(rows, edges).groupBy("feature", "slice").agg(F.sum("n").alias("n")).collect():  # SLICES + 1 a feature
        counts[r["feature"]][r["slice"]] = r["n"]
    before = [np.cumsum(c) - c for c in counts]
    slices = [np.searchsorted(np.cumsum(c), ranks) for c in counts]
    wanted = [(f, int(s), k, int(ranks[k] - before[f][s])) for f, at in enumerate(slices) for k, s in enumerate(at)]
    values = _slices(rows, edges, [np.unique(at) for at in slices]).groupBy("feature", "slice", "v").agg(F.sum("n").alias("n"))
    ranked = values.withColumn("upto", F.sum("n").over(Window.partitionBy("feature", "slice").orderBy("v")))
    found = ranked.join(F.broadcast(log.sparkSession.createDataFrame(wanted, "feature int, slice int, k int, rank long")), ["feature", "slice"])
    limits = [np.zeros(bins - 1) for _ in edges]
    for r in found.where("rank between upto - n + 1 and upto").collect():  # bins - 1 a feature
        limits[r["feature"]][r["k"]] = r["v"]
    return limits


def _slices(rows: DataFrame, edges: list[np.ndarray], only: list[np.ndarray] | None = None) -> DataFrame:
    """(feature, slice, v, n): a task's numbers of rows by slice, which is how many edges of the feature
    lie below the value; with `only`, by value within these slices."""
    shared = rows.sparkSession.sparkContext.broadcast((edges, only))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, only = shared.value
        totals = [np.zeros(len(e) + 1, dtype=np.int64) for e in edges]
        out = lambda f, s, v, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(s), f), pa.int32()), pa.array(s, pa.int32()), pa.array(v, pa.float64()), pa.array(n, pa.int64())], names=["feature", "slice", "v", "n"])
        for b in batches:
            if not b.num_rows:
                continue
            for f, column in enumerate(matrix(b.column(0))[0].T):
                if only is None:
                    totals[f] += np.bincount(np.searchsorted(edges[f], column), minlength=len(totals[f]))
                else:
                    v, n = np.unique(column, return_counts=True)
                    s = np.searchsorted(edges[f], v)
                    own = np.isin(s, only[f])
                    yield out(f, s[own], v[own], n[own])
        if only is None:
            for f, n in enumerate(totals):
                s = np.flatnonzero(n)
                yield out(f, s, np.zeros(len(s)), n[s])

    return rows.select("x").mapInArrow(partial, "feature int, slice int, v double, n long")


def _packed(log: DataFrame, model: Boosted, runs: int, x_col: str, round_col: str | None) -> DataFrame:
    """(bins, arm, reward, round, margin): bins as 16-bit numbers in bytes, margin by run."""

    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([r.tobytes() for r in model.bins(matrix(x)[0]).astype(np.uint16)], pa.binary()) if len(x) else pa.array([], pa.binary())

    usable = log.where(F.col(x_col).isNotNull() & F.col("arm").isNotNull() & F.col("reward").isNotNull())
    return usable.select(pack(doubles(x_col)).alias("bins"), F.col("arm").cast("int").alias("arm"), F.col("reward").cast("double").alias("reward"), (F.col(round_col).cast("long") if round_col else F.lit(0).cast("long")).alias("round"), F.array(*[F.lit(0.0)] * runs).alias("margin"))


def _read(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint16).reshape(b.num_rows, d).astype(np.int64)
    return bins, b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), matrix(b.column(4))[0]


def _histograms(rows: DataFrame, models: list[Boosted], since: int, growing: list[Tree], ends: Sequence[int], level: int, bins: int) -> DataFrame:
    """(run, node, feature, bin, s, n): residuals and counts of the nodes of one level."""
    shared = rows.sparkSession.sparkContext.broadcast((models, growing))
    first, d, n_arms = 1 << level, len(models[0].limits), models[0].n_arms

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, trees = shared.value
        sums, counts = np.zeros((len(ends), d, first, bins)), np.zeros((len(ends), d, first, bins), dtype=np.int64)
        arm_sums, arm_counts = np.zeros((len(ends), first, n_arms)), np.zeros((len(ends), first, n_arms), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            all_bins, all_arms, reward, at, margin = _read(b, d)
            for r, (model, tree, end) in enumerate(zip(trained, trees, ends, strict=True)):
                own = np.flatnonzero(at <= end)
                x, arm = all_bins[own], all_arms[own]
                rest = reward[own] - model.base - margin[own, r]
                for t in model.trees[since:]:
                    rest -= t.value[t.nodes(x, arm)]
                node = tree.nodes(x, arm) - first
                here = np.flatnonzero(node >= 0)
                x, arm, rest, node = x[here], arm[here], rest[here], node[here]
                for f in range(d):
                    key = node * bins + x[:, f]
                    sums[r, f] += np.bincount(key, weights=rest, minlength=first * bins).reshape(first, bins)
                    counts[r, f] += np.bincount(key, minlength=first * bins).reshape(first, bins)
                arm_sums[r] += np.bincount(node * n_arms + arm, weights=rest, minlength=first * n_arms).reshape(first, n_arms)
                arm_counts[r] += np.bincount(node * n_arms + arm, minlength=first * n_arms).reshape(first, n_arms)
        for r in range(len(ends)):
            # an arm's indicator has two bins: other arms, and the arm
            pair = lambda v: np.stack([v.sum(axis=1, keepdims=True) - v, v], axis=2).transpose(1, 0, 2)
            for s, n, start in ((sums[r], counts[r], 0), (pair(arm_sums[r]), pair(arm_counts[r]), d)):
                f, node, bin_ = np.nonzero(n)
                cols = [np.full(len(f), r), node + first, f + start, bin_]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cols], pa.array(s[f, node, bin_]), pa.array(n[f, node, bin_])], names=["run", "node", "feature", "bin", "s", "n"])

    parts = rows.mapInArrow(partial, "run int, node int, feature int, bin int, s double, n long")
    keys = ["run", "node", "feature"]
    # tasks have added up already; one exchange serves the sums and the running sums
    return parts.repartition(*keys).groupBy(*keys, "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _best_cuts(histograms: DataFrame, lam: float) -> DataFrame:
    """(run, node, best): the cut of greatest gain of each node; of equal ones (nine places) the lowest
    feature, then the lowest bin. `best.g` is null where a node has one bin in every feature."""
    whole = Window.partitionBy("run", "node", "feature")
    left = whole.orderBy("bin")
    rows = histograms.select("*", F.sum("s").over(left).alias("sl"), F.sum("n").over(left).alias("nl"), F.sum("s").over(whole).alias("st"), F.sum("n").over(whole).alias("nt"))
    part = lambda s, n: s * s / (n + lam)
    gain = part(F.col("sl"), F.col("nl")) + part(F.col("st") - F.col("sl"), F.col("nt") - F.col("nl")) - part(F.col("st"), F.col("nt"))
    cut = F.struct(F.when(F.col("nl") < F.col("nt"), F.round(gain, 9)).alias("g"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "sl", "nl", "st", "nt")
    return rows.groupBy("run", "node").agg(F.max(cut).alias("best"))


def fit(log: DataFrame, n_arms: int, trees: int = 50, rate: float = 0.1, depth: int = 3, bins: int = 32, lam: float = 1.0, ends: Sequence[int] | None = None, x_col: str = "x", id_col: str = "row_id", round_col: str = "round") -> list[Boosted]:
    """One model for each of `ends`, learnt from the rounds up to it (one model of all rows without).

    A node is cut where that gains; its value is rate * sum / (rows + lam) of its residuals. Rows with
    a null vector, arm or reward are not learnt from. A model without rows has no trees.
    """
    if not 2 <= bins <= 1 << 16:
        raise ValueError("bins must be from 2 to 65536")
    timed, ends = ends is not None, list(ends) if ends is not None else [0]
    limits = quantile_limits(log, bins, x_col, id_col)
    models = [Boosted(limits, n_arms) for _ in ends]
    rows = durable(_packed(log, models[0], len(ends), x_col, round_col if timed else None))
    means = rows.agg(*[F.avg(F.when(F.col("round") <= e, F.col("reward"))) for e in ends]).first()
    for model, mean in zip(models, means, strict=True):
        model.base = mean or 0.0
    since = 0
    for t in range(trees):
        growing = [Tree.empty(depth) for _ in ends]
        for level in range(depth):
            found = _best_cuts(_histograms(rows, models, since, growing, ends, level, bins), lam).collect()  # one a node
            for r in found:
                _cut(growing[r["run"]], r["node"], r["best"], rate, lam)
            if not any(r["best"]["g"] is not None and r["best"]["g"] > 0 for r in found):
                break
        for model, tree in zip(models, growing, strict=True):
            model.trees.append(tree)
        if (t + 1) % REFRESH == 0 and t + 1 < trees:
            rows, since = durable(_with_margins(rows, models, since)), t + 1
    return models


def _cut(tree: Tree, node: int, best, rate: float, lam: float) -> None:
    value = lambda s, n: rate * s / (n + lam)
    if node == 1:
        tree.value[1], tree.rows[1] = value(best["st"], best["nt"]), best["nt"]
    if best["g"] is not None and best["g"] > 0:
        tree.feature[node], tree.cut[node] = -best["f"], -best["b"]
        tree.value[2 * node], tree.rows[2 * node] = value(best["sl"], best["nl"]), best["nl"]
        tree.value[2 * node + 1], tree.rows[2 * node + 1] = value(best["st"] - best["sl"], best["nt"] - best["nl"]), best["nt"] - best["nl"]


def _with_margins(rows: DataFrame, models: list[Boosted], since: int) -> DataFrame:
    shared, d = rows.sparkSession.sparkContext.broadcast(models), len(models[0].limits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins, arm, _, _, margin = _read(b, d)
                margin = margin.copy()
                for r, model in enumerate(shared.value):
                    for t in model.trees[since:]:
                        margin[:, r] += t.value[t.nodes(bins, arm)]
                ends = pa.array(np.arange(0, margin.size + 1, margin.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.ListArray.from_arrays(ends, pa.array(margin.ravel()))], names=b.schema.names)

    return rows.mapInArrow(add, rows.schema)


def tree_table(spark, models: Sequence[Boosted]) -> DataFrame:
    """(run, tree, node, feature, cut, limit, value, n) of all nodes: inner ones have a feature and the
    greatest value that goes left (0.5 for an arm's indicator), leaves have neither."""
    out = []
    for run, model in enumerate(models):
        d = len(model.limits)
        for t, tree in enumerate(model.trees):
            for node in np.flatnonzero(tree.rows).tolist():
                f, c = int(tree.feature[node]), int(tree.cut[node])
                limit = None if f < 0 else 0.5 if f >= d else float(model.limits[f][c])
                out.append((run, t, node, *((f, c) if f >= 0 else (None, None)), limit, float(tree.value[node]), int(tree.rows[node])))
    return spark.createDataFrame(out, "run int, tree int, node int, feature int, cut int, limit double, value double, n long")


def predict_arms(models: Sequence[Boosted], contexts: DataFrame, run: Column | None = None, x_col: str = "x") -> DataFrame:
    """`contexts` with `scores`, the predictions for all arms by the model of number `run` (the first
    without); null where the vector or the run is null or no such model is there. No exchange."""
    shared = contexts.sparkSession.sparkContext.broadcast(list(models))

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, which in batches:
            (v, there), n_arms = matrix(x), shared.value[0].n_arms
            number = np.where(np.asarray(which.is_valid()), which.fill_null(-1).to_numpy(), -1)
            out, known = np.zeros((len(v), n_arms)), there & (number >= 0) & (number < len(shared.value))
            for r in np.unique(number[known]):
                own = np.flatnonzero(known & (number == r))
                model = shared.value[r]
                bins = model.bins(v[own])
                for a in range(n_arms):
                    out[own, a] = model.predict(bins, np.full(len(own), a))
            ends = pa.array(np.arange(0, out.size + 1, n_arms, dtype=np.int32))
            yield pa.ListArray.from_arrays(ends, pa.array(out.ravel()), mask=pa.array(~known))

    return contexts.withColumn("scores", score(doubles(x_col), F.lit(0) if run is None else run.cast("int")))


def best_arm(scores: Column) -> Column:
    """The arm of the greatest score, the lowest of equal ones; null for null scores."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
