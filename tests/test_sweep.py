"""Runs that share jobs give what each would give alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions import noise
from arbora.functions.lineage import durable
from arbora.operators import diagnose, models, prepare, quantize, sweep


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) + rng.integers(0, 3, size=(300, 1)) * 2
    rows = [(i, v.tolist(), int(v[0] + v[1] > 4) + int(v[2] > 3)) for i, v in enumerate(x)]
    return durable(spark.createDataFrame([*rows, (300, None, 1), (301, [0.0] * 4, None)], "row_id long, x array<double>, label int").repartition(3))


def test_holdouts_are_those_of_single_splits(spark, points):
    for n in (90, 1000, 0):
        conditions = sweep.holdouts(points, n, (1, 2, 9))
        for seed, condition in zip((1, 2, 9), conditions, strict=True):
            want = {r["row_id"] for r in prepare.split_holdout(points, n, seed).where("holdout").collect()}
            assert {r["row_id"] for r in points.where(condition).collect()} == want


def test_grid_against_single_runs(spark, points):
    usable = points.where("x is not null")
    found = {(r["depth"], r["seed"]): r for r in sweep.delta_grid(usable, (1, 2, 3), (1, 2), 100, 3, 2, 3).collect()}
    for seed in (1, 2):
        split = durable(prepare.split_holdout(usable, 100, seed))
        book = quantize.train_codebook(split.where("holdout"), 3, 2, 3)
        coded = durable(quantize.encode(split, book))
        for depth in (1, 2, 3):
            theta = models.theta_table(spark, models.fit_additive_ols(coded.where("holdout"), 3, depth, 2))
            want = diagnose.delta_additive(coded.where("not holdout"), theta, depth, 3).first()
            r = found[depth, seed]
            assert r["delta"] == pytest.approx(want["delta"], abs=1e-6) and (r["n_fit"], r["n_eval"]) == (100, 201)


def test_jobs_do_not_depend_on_seeds(spark, points):
    def jobs(seeds):
        group = f"seeds-{len(seeds)}"
        spark.sparkContext.setJobGroup(group, group)
        sweep.delta_grid(points, (1, 2, 3, 4, 5), seeds, 100, 3, 1, 2).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs((1,)) == jobs((1, 2, 3, 4, 5))


def test_folds_against_single_folds(spark, points):
    usable = points.where("x is not null")
    report = {r["depth"]: r for r in diagnose.delta_report("p", usable, (1, 2), 3, 2, 2, folds=3).collect()}
    fold, sums, lin, n = sweep.fold_of(3), {1: 0.0, 2: 0.0}, 0.0, 0
    for f in range(3):
        fit, judge = durable(usable.where(fold != f)), durable(usable.where(fold == f))
        k = judge.count()
        book = quantize.train_codebook(fit, 2, 2, 2)
        means = durable(models.fit_boosted_centroids(quantize.encode(fit, book), 3, 2, 2))
        for depth in (1, 2):
            sums[depth] += k * diagnose.delta_boosted(quantize.encode(judge, book), means, depth, 3).first()["mae"]
        lin, n = lin + k * diagnose.delta_linear(judge, *models.fit_ridge_multi(fit, 3)).first()["mae"], n + k
    for depth in (1, 2):
        assert report[depth]["delta_rq_mae"] == pytest.approx(sums[depth] / n) and report[depth]["delta_lin_mae"] == pytest.approx(lin / n)


def test_values_on_the_driver_are_those_of_the_columns(spark):
    row = spark.range(1).select(noise.uniform(F.lit("a"), 3, F.lit(7)).alias("u"), noise.normal(F.lit(5), F.lit("w"), 2).alias("z")).first()
    assert row["u"] == noise.uniform_value("a", 3, 7) and row["z"] == pytest.approx(noise.normal_value(5, "w", 2), abs=1e-14)


def test_tabular_rule(spark):
    rule = prepare.TabularRule(14, 3, 5)
    sizes = np.bincount(rule.group)
    assert len(rule.group) == 7 and all(3 <= s <= 5 for s in sizes[:-1]) and len(rule.splits) == 4 and sorted(rule.leaf_class) == sorted(i % 3 for i in range(16))
    assert len({f for f, _ in rule.splits}) == 4
    x = np.array([r["x"] for r in prepare.tabular_contexts(spark, 4000, 14, 3, 5).collect()])
    assert np.abs(x[:, :7].mean(axis=0)).max() < 1e-9 and np.abs(x[:, :7].std(axis=0) - 1).max() < 1e-6 and set(x[:, 7:].ravel()) == {0.0, 1.0}
    c = np.corrcoef(x[:, :7].T)
    inside = [c[i, j] for i in range(7) for j in range(i) if rule.group[i] == rule.group[j]]
    across = [c[i, j] for i in range(7) for j in range(i) if rule.group[i] != rule.group[j]]
    assert min(inside) > 0.4 and (not across or max(map(abs, across)) < 0.1)
    assert np.abs(x[:, 7:].mean(axis=0) - rule.frequency).max() < 0.04


@pytest.mark.parametrize("kind", ["linear", "diag"])
def test_sufficiency_sweep(spark, kind):
    ids = spark.range(3000).withColumnRenamed("id", "row_id")
    grid = [(2, 3, 0), (4, 3, 0), (2, 3, 1)]
    found = {(r["d"], r["K"], r["seed"], r["method"]): r for r in sweep.sufficiency_sweep(ids, grid, kind).collect()}
    assert len(found) == 6
    for d, k, seed in grid:
        own, rest = found[d, k, seed, kind], found[d, k, seed, "uniform"]
        assert own["regret_rate"] < 0.3 < 0.6 < rest["regret_rate"] < 0.73
        n = own["final_regret"] / own["regret_rate"]
        assert own["ratio"] == pytest.approx(n / (16 * k * d * d))
    # a run does not depend on the others
    alone = {(r["d"], r["K"], r["seed"], r["method"]): r["final_regret"] for r in sweep.sufficiency_sweep(ids, grid[1:2], kind).collect()}
    assert all(found[key]["final_regret"] == v for key, v in alone.items())
    assert len({r["label"] for r in sweep.grid_contexts(ids, grid).collect()}) == 3
