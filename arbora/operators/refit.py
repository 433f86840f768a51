"""Schedules of refits in a constant number of jobs: every context is decided by the model of all rounds
before its stretch.

A schedule is a stretch number for each round: `every_stretch` has stretches of one length, while
`doubling_phase` of `models` doubles them. Linear models come from running sums: each stretch's Gram
matrices are added up once, a running sum over stretches gives the sums at every boundary, and each is
solved once. Trees of all stretches grow in the same passes (see `boosting`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.arrow import matrix
from arbora.functions.lineage import durable
from arbora.functions.vectors import dot, doubles
from arbora.operators import boosting, score
from arbora.operators.posterior import gram, solve


def every_stretch(every: int, round_col: str = "round") -> Column:
    """Stretch 0, 1, 2, ... of `every` rounds each, rounds counted from 1."""
    return F.floor((F.col(round_col) - 1) / F.lit(every)).cast("int")


def boundaries(stretch: Sequence[tuple[int, int]]) -> list[int]:
    """Last rounds before stretch 1, 2, ... from the (stretch, last round) that occur."""
    last = dict(stretch)
    out, end = [], 0
    for s in range(max(last, default=0)):
        end = max(end, last.get(s, 0))
        out.append(end)
    return out


def running_posteriors(log: DataFrame, stretch: Column, lam: float = 1.0) -> DataFrame:
    """(stretch, arm, n, a, f, cov, mean): the linear posterior of all rounds before each stretch but the
    first. `log` has x, arm, reward and what `stretch` reads."""
    parts = durable(gram(log.withColumn("_s", stretch), ["_s", "arm"]))
    last = (parts.agg(F.max("_s")).first()[0] or 0) + 1
    cells = parts.select("arm", "i", "j").distinct().withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(last - 1))))
    full = cells.join(parts, ["_s", "arm", "i", "j"], "left")
    so_far = Window.partitionBy("arm", "i", "j").orderBy("_s")
    sums = full.select((F.col("_s") + 1).alias("stretch"), "arm", "i", "j", F.sum(F.coalesce("v", F.lit(0.0))).over(so_far).alias("v"), F.sum(F.coalesce("n", F.lit(0))).over(so_far).alias("n"))
    return solve(sums.where("n > 0"), ["stretch", "arm"], lam)


def choose_by_stretch(contexts: DataFrame, posteriors: DataFrame, stretch: Column) -> DataFrame:
    """`contexts` with `arm`: of the greatest x . mean among the models of its stretch, the lowest of
    equal ones; null where the stretch has no model or the vector is null. Stretches after the last model's
    are decided by it.

    Means are measured: up to `score.SEND_BYTES` they go to the tasks and nothing is exchanged; beyond,
    each context is joined to its stretch's models.
    """
    means = posteriors.select("stretch", "arm", "mean")
    last, numbers = means.agg(F.max("stretch"), F.sum(F.size("mean"))).first()
    rows = contexts.drop("arm").withColumn("_s", F.least(stretch.cast("int"), F.lit(last or 0)))
    if 8 * (numbers or 0) > score.SEND_BYTES:
        x = doubles("x")
        models = means.groupBy(F.col("stretch").alias("_s")).agg(F.sort_array(F.collect_list(F.struct("arm", "mean"))).alias("_m"))
        scores = F.transform("_m", lambda m: dot(m["mean"], x))
        best = F.element_at("_m", F.array_position(scores, F.array_max(scores)).cast("int"))
        return rows.join(models, "_s", "left").withColumn("arm", F.when(F.col("x").isNotNull(), best["arm"])).drop("_m", "_s")
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in means.orderBy("stretch", "arm").collect():
        arms, w = tables.get(r["stretch"], (np.zeros(0, dtype=np.int32), np.zeros((0, len(r["mean"])))))
        tables[r["stretch"]] = np.append(arms, np.int32(r["arm"])), np.vstack([w, r["mean"]])
    shared = contexts.sparkSession.sparkContext.broadcast(tables)

    @F.arrow_udf("int")
    def pick(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, at in batches:
            v, there = matrix(x)
            number, out = at.fill_null(-1).to_numpy(), np.zeros(len(v), dtype=np.int32)
            known = there & np.isin(number, list(shared.value))
            for s in np.unique(number[known]):
                own, (arms, w) = np.flatnonzero(known & (number == s)), shared.value[s]
                out[own] = arms[np.argmax(v[own] @ w.T, axis=1)]
            yield pa.array(out, pa.int32(), mask=~known)

    return rows.withColumn("arm", pick(doubles("x"), F.col("_s"))).drop("_s")


def refit_linear(log: DataFrame, contexts: DataFrame, stretch: Column, lam: float = 1.0) -> DataFrame:
    """`contexts` with the arm that a linear posterior of all logged rounds before their stretch prefers;
    null in the first stretch."""
    return choose_by_stretch(contexts, durable(running_posteriors(log, stretch, lam)), stretch)


def refit_trees(log: DataFrame, contexts: DataFrame, stretch: Column, n_arms: int, **settings) -> DataFrame:
    """The same by boosted trees, which all stretches' models grow in the same passes."""
    ends = boundaries([(r["s"], r["last"]) for r in log.groupBy(stretch.alias("s")).agg(F.max("round").alias("last")).collect()])  # one a stretch
    rows = contexts.drop("arm")
    if not ends:
        return rows.withColumn("arm", F.lit(None).cast("int"))
    scored = boosting.predict_arms(boosting.fit(log, n_arms, ends=ends, **settings), rows, F.when(stretch > 0, F.least(stretch, F.lit(len(ends))) - 1))
    return scored.withColumn("arm", boosting.best_arm(F.col("scores"))).drop("scores")
