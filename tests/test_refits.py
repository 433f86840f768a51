"""Histogram trees against plain ones; refits in one pass against refits one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions.lineage import durable
from arbora.operators import boosting, models, posterior, refit, score
from arbora.plans import refits  # noqa: F401  registers its queries
from arbora.plans.catalogue import ORACLE, QUERIES
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)).round(2)
    arm = rng.integers(0, 3, size=400)
    reward = (x[:, 0] > 0) * (arm == 1) + 0.5 * (x[:, 1] + x[:, 2] > 0.3) * (arm == 2) + 0.1 * rng.normal(size=400)
    rows = [(i, i + 1, v.tolist(), int(a), float(r)) for i, (v, a, r) in enumerate(zip(x, arm, reward, strict=True))]
    return durable(spark.createDataFrame([*rows, (400, 401, None, 0, 1.0), (401, 402, [0.0, 0.0, 0.0], 0, None)], "row_id long, round long, x array<double>, arm int, reward double").repartition(3))


def plain(rows, n_arms, limits, trees, rate, depth, lam=1.0):
    """Predictions by trees that are grown row by row: {(row_id, arm): score}, and cuts by (tree, node)."""
    bins = {r["row_id"]: [sum(t < v for t in limits[i]) for i, v in enumerate(r["x"])] for r in rows}
    value = lambda rid, arm, f: bins[rid][f] if f < len(limits) else int(arm == f - len(limits))
    base = float(np.mean([r["reward"] for r in rows]))
    rest, score_of = {r["row_id"]: r["reward"] - base for r in rows}, {(r["row_id"], a): base for r in rows for a in range(n_arms)}
    cuts = {}
    for t in range(trees):
        at, leaves = {1: rows}, {}
        while at:
            node, own = at.popitem()
            s, n = sum(rest[r["row_id"]] for r in own), len(own)
            best = (0.0,)
            for f in range(len(limits) + n_arms) if node < 1 << depth else ():
                for c in sorted({value(r["row_id"], r["arm"], f) for r in own}):
                    left = [rest[r["row_id"]] for r in own if value(r["row_id"], r["arm"], f) <= c]
                    if len(left) < n:
                        gain = sum(left) ** 2 / (len(left) + lam) + (s - sum(left)) ** 2 / (n - len(left) + lam) - s * s / (n + lam)
                        best = max(best, (round(gain, 9), -f, -c))
            if best[0] > 0:
                f, c = -best[1], -best[2]
                cuts[t, node] = (f, c)
                at[2 * node] = [r for r in own if value(r["row_id"], r["arm"], f) <= c]
                at[2 * node + 1] = [r for r in own if value(r["row_id"], r["arm"], f) > c]
            else:
                leaves[node] = rate * s / (n + lam)

        def leaf(rid, arm):
            node = 1
            while (t, node) in cuts:
                f, c = cuts[t, node]
                node = 2 * node + (value(rid, arm, f) > c)
            return leaves[node]

        for r in rows:
            rest[r["row_id"]] -= leaf(r["row_id"], r["arm"])
            for a in range(n_arms):
                score_of[r["row_id"], a] += leaf(r["row_id"], a)
    return score_of, cuts


@pytest.mark.parametrize("depth,trees", [(3, 4), (6, 2)])
def test_trees_against_plain(spark, log, depth, trees, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    fitted = boosting.fit(log, 3, trees, 0.3, depth, 8, ends=[150, 400])
    for end, model in zip((150, 400), fitted, strict=True):
        rows = [r.asDict() for r in log.where(F.col("round") <= end).where("x is not null and reward is not null").collect()]
        want, cuts = plain(rows, 3, model.limits, trees, 0.3, depth)
        assert {(t, n): (int(tree.feature[n]), int(tree.cut[n])) for t, tree in enumerate(model.trees) for n in np.flatnonzero(tree.feature >= 0)} == cuts
        scored = boosting.predict_arms([model], log.where(F.col("round") <= end)).collect()
        assert all(np.allclose(r["scores"], [want[r["row_id"], a] for a in range(3)]) for r in scored if r["x"] is not None and r["row_id"] != 401)
    assert {r["scores"] for r in boosting.predict_arms(fitted, log.where("x is null")).collect()} == {None}


def test_trees_learn_and_do_not_depend_on_partitions(spark, log):
    one = boosting.fit(log, 3, 8, 0.4, 3, 16)[0]
    two = boosting.fit(log.repartition(7), 3, 8, 0.4, 3, 16)[0]
    rows = log.where("x is not null and reward is not null")
    error = lambda m: boosting.predict_arms([m], rows).agg(F.avg(F.pow(F.get("scores", F.col("arm")) - F.col("reward"), F.lit(2.0)))).first()[0]
    assert error(one) < 0.35 * rows.agg(F.var_pop("reward")).first()[0]
    assert abs(error(one) - error(two)) < 1e-9


def test_number_of_jobs_does_not_depend_on_runs(spark, log):
    def jobs(ends):
        group = f"runs-{len(ends)}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.fit(log, 3, 1, depth=2, bins=8, ends=ends)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs([400]) == jobs([100, 150, 200, 250, 300, 350, 400])


def test_no_rows_and_wrong_settings(spark, log):
    with pytest.raises(ValueError):
        boosting.fit(log.limit(0), 3)
    with pytest.raises(ValueError):
        boosting.fit(log, 3, bins=1)
    early = boosting.fit(log, 3, 2, depth=2, bins=8, ends=[0, 402])
    assert early[0].base == 0 and not early[0].trees[0].rows.any() and early[1].trees[0].rows[1] == 400


@pytest.mark.parametrize("stretch,edges", [(lambda: refit.every_stretch(90), [90, 180, 270, 360]), (lambda: models.doubling_phase("round", 60), [60, 180])])
def test_linear_refits(spark, log, stretch, edges, monkeypatch):
    stretch = stretch()
    rows = log.where("x is not null")
    want, bounds = {}, [0, *edges, 10_000]
    for i in range(1, len(edges) + 1):
        model = posterior.linear_posterior(rows.where(F.col("round") <= bounds[i]).where("reward is not null"))
        part = rows.where((F.col("round") > bounds[i]) & (F.col("round") <= bounds[i + 1]))
        want |= {r["row_id"]: r["arm"] for r in score.choose(score.score_mean_linear(part.drop("arm"), durable(model))).collect()}
    for limit in (64 << 20, 0):
        monkeypatch.setattr(score, "SEND_BYTES", limit)
        found = refit.refit_linear(log, log, stretch).collect()
        assert len(found) == 402
        assert {r["row_id"]: r["arm"] for r in found if r["arm"] is not None} == want


def test_tree_refits(spark, log):
    found = {r["row_id"]: r["arm"] for r in refit.refit_trees(log, log, refit.every_stretch(150), 3, trees=3, depth=3, bins=8).collect()}
    limits = boosting.quantile_limits(log, 8)
    rows = [r.asDict() for r in log.where("x is not null and reward is not null").collect()]
    for s, end in ((1, 150), (2, 300)):
        model = boosting.fit(log, 3, 3, depth=3, bins=8, ends=[end])[0]
        assert all((a == b).all() for a, b in zip(model.limits, limits, strict=True))
        own = log.where((F.col("round") > 150 * s) & (F.col("round") <= 150 * s + 150))
        want = {r["row_id"]: r["a"] for r in boosting.predict_arms([model], own).withColumn("a", boosting.best_arm(F.col("scores"))).collect()}
        assert {k: found[k] for k in want} == want
    assert all(found[r["row_id"]] is None for r in rows if r["round"] <= 150) and found[400] is None
    assert {r["arm"] for r in refit.refit_trees(log, log, refit.every_stretch(1000), 3, trees=1).collect()} == {None}


def test_boundaries():
    assert refit.boundaries([(0, 90), (1, 180), (2, 250)]) == [90, 180]
    assert refit.boundaries([(0, 90), (3, 250)]) == [90, 90, 90]
    assert refit.boundaries([]) == []


@pytest.mark.parametrize("sample", [0, 1, 20, 1000])
def test_limits_are_quantiles_of_all_rows(spark, sample, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=900), rng.integers(0, 4, size=900), np.zeros(900)], axis=1)
    log = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "row_id long, x array<double>").repartition(3)
    monkeypatch.setattr(boosting, "QUANTILE_ROWS", sample)
    ranks = [-(-k * 900 // 16) - 1 for k in range(1, 16)]
    assert np.array_equal(boosting.quantile_limits(log, 16), [np.sort(c)[ranks] for c in x.T])


@pytest.mark.parametrize("name", ["m1_fit_reward_trees", "m2_predict_reward_trees", "m3_refit_every_trees"])
def test_twins_of_logs_beyond_the_sample(spark, name, monkeypatch):
    monkeypatch.setattr(boosting, "QUANTILE_ROWS", 100)
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), QUERIES[name], ORACLE[name], folder) is None


def test_trees_over_counted_cells_are_those_over_rows(spark, log):
    """The cells' model equals MLlib's over one row each, and few cells stand for many rows."""
    many = durable(log.crossJoin(spark.range(5)).withColumn("x", F.transform("x", lambda v: F.round(v))))
    found = models.fit_reward_gbt(many, 3, 5)
    cells = models.reward_cells(many, found.limits)
    each = cells.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    features = lambda df: df.select(models.array_to_vector(models.context_arm_features(F.col("x"), F.col("arm"), 3)).alias("features"), "label")
    plain_model = models.GBTRegressor(maxIter=5, stepSize=0.1, maxDepth=3, seed=1).fit(features(each))
    # predictions, as cuts of equal gain (an arm or the only other one) share importance either way
    score_of = lambda m: {(tuple(r["features"]), r["label"]): r["prediction"] for r in m.transform(features(cells)).collect()}
    one, two = score_of(found.model), score_of(plain_model)
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)
    assert cells.count() <= 400 and cells.agg(F.sum("weight")).first()[0] == 2000
    contexts = log.where("x is not null").select("row_id", "x")
    scored = models.predict_reward(found, contexts, 3)
    assert scored.count() == 3 * contexts.count() and scored.where("score is null or isnan(score)").count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_refits_decide_each_combination_of_bins_once(spark, log, limit, monkeypatch):
    """Few cells stand for many contexts, and each context has the arm that its own predictions prefer."""
    monkeypatch.setattr(score, "SEND_BYTES", limit)
    many = log.withColumn("x", F.transform("x", lambda v: F.round(v)))
    predicted, expand = [], models.expand_arms
    monkeypatch.setattr(models, "expand_arms", lambda df, n_arms: predicted.append(df.count()) or expand(df, n_arms))
    found = {r["row_id"]: r["arm"] for r in models.refit_every(many, many, 3, 200, trees=3).collect()}
    stretches = [many.where("x is not null").where(F.col("round").between(s + 1, s + 200)) for s in (200, 400)]
    assert len(found) == 402 and len(predicted) == 2
    assert all(0 < n <= part.select("x").distinct().count() for n, part in zip(predicted, stretches, strict=True)) and predicted[0] < 150
    for end, part in zip((200, 400), stretches, strict=True):
        model = models.fit_reward_gbt(many.where(F.col("round") <= end), 3, 3)
        want = {r["row_id"]: r["arm"] for r in score.choose(models.predict_reward(model, part, 3)).collect()}
        assert {k: found[k] for k in want} == want
    assert found[400] is None and all(found[i] is None for i in range(200))
