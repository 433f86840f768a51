"""Identities, goldens, invariance and edge cases of the bandit operators."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions.lineage import durable
from arbora.operators import decisions, diagnose, models, posterior, prepare, quantize, score


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 5)) + rng.integers(0, 3, size=(240, 1)) * 3
    rows = [(i, [float(v) for v in x[i]], int(i % 4), int((i * 7) % 4), float((i % 4) == (i * 7) % 4 or i % 5 == 0)) for i in range(240)]
    return durable(spark.createDataFrame(rows, "row_id long, x array<double>, label int, arm int, reward double"))


def table(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


# --------------------------------------------------------------- preparation


def test_standardize(spark):
    df = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(4)], "row_id long, x array<double>")
    z = np.array([r["x"] for r in prepare.standardize(df).orderBy("row_id").collect()])
    assert z[:, 0] == pytest.approx((np.arange(4) - 1.5) / np.std(range(4))) and (z[:, 1] == 0).all()
    e = np.array([r["x"] for r in prepare.standardize(df, "eps").orderBy("row_id").collect()])
    assert e[:, 0] == pytest.approx(z[:, 0], abs=1e-7)


def test_split_and_rounds(spark, points):
    s = prepare.split_holdout(points, 50, 1)
    assert s.where("holdout").count() == 50
    assert prepare.split_holdout(points, 10_000, 1).where("holdout").count() == 120
    again = prepare.split_holdout(points.repartition(9), 50, 1)
    assert {r[0] for r in s.where("holdout").select("row_id").collect()} == {r[0] for r in again.where("holdout").select("row_id").collect()}
    r = prepare.shuffle_rounds(points, 3, ["label"])
    for label in range(4):
        assert sorted(x["round"] for x in r.where(F.col("label") == label).collect()) == list(range(1, 61))
    assert prepare.cap_rounds(r, 0).count() == 240 and prepare.cap_rounds(r, 10).count() == 40


def test_labels_and_noise(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "row_id long, x array<double>")
    assert [r["label"] for r in prepare.label_by_linear_argmax(df, [[1, 0], [0, 1]]).orderBy("row_id").collect()] == [0, 1, 0]
    assert [r["label"] for r in prepare.label_by_tree(df, [(0, 0.5), (1, 0.5)], [5, 6, 7, 8]).orderBy("row_id").collect()] == [7, 6, 5]
    big = spark.range(20_000).selectExpr("id as row_id", "-1 as label")
    noisy = prepare.inject_label_noise(big, 0.1, 5, 2).where("label >= 0")
    assert abs(noisy.count() / 20_000 - 0.1) < 0.01 and noisy.select("label").distinct().count() == 5


@pytest.mark.parametrize("kind", ["clusters", "linear", "tabular"])
def test_synthetic(spark, kind):
    df = prepare.synthetic_contexts(spark, kind, 600, 8, 4, 1)
    assert df.count() == 600 and df.where("size(x) <> 8").count() == 0
    assert {r[0] for r in df.select("label").distinct().collect()} <= set(range(4))
    if kind == "clusters":
        assert {r["count"] for r in df.groupBy("label").count().collect()} == {150}


def test_pca_is_centred(spark, points):
    out, share = prepare.pca_fit_transform(points, points, 5)
    pc = np.array([r["pc"] for r in out.collect()])
    assert np.abs(pc.mean(axis=0)).max() < 1e-9 and share == pytest.approx(1)
    assert np.abs(np.cov(pc.T) - np.diag(np.diag(np.cov(pc.T)))).max() < 1e-8


# -------------------------------------------------------------- quantisation


def test_codebook_identities(spark, points):
    x = np.array([r["x"] for r in points.orderBy("row_id").collect()])
    losses = []
    for it in (0, 1, 3, 6):
        book = quantize.train_codebook(points, 2, 2, it)
        codes, left = quantize._walk(x, book)
        losses.append((left[1] ** 2).sum())
        assert x == pytest.approx(left[-1] + sum(b[c] for b, c in zip(book, codes, strict=True)))
    assert all(a >= b - 1e-9 for a, b in zip(losses, losses[1:], strict=False))
    other = quantize.train_codebook(points.repartition(7), 2, 2, 6)
    assert all(np.allclose(a, b) for a, b in zip(book, other, strict=True))
    deeper = quantize.train_codebook(points, 3, 2, 6)
    assert np.allclose(deeper[0], book[0]) and np.allclose(deeper[1], book[1])
    back = quantize.codebook_from_table(quantize.codebook_table(spark, book))
    assert all(np.allclose(a, b) for a, b in zip(book, back, strict=True))


def test_encode_ties_few_rows_and_residuals(spark, points):
    tie = spark.createDataFrame([(0, [0.0])], "row_id long, x array<double>")
    assert quantize.encode(tie, [np.array([[1.0], [-1.0]])]).first()["codes"] == [0]
    few = quantize.train_codebook(tie, 1, 2, 2)
    assert few[0].shape == (4, 1)
    book = quantize.train_codebook(points, 3, 2, 3)
    wide = quantize.encode(points, book, residuals=True)
    long = table(quantize.residual_features(wide, quantize.codebook_table(spark, book)), "row_id", "level")
    for r in wide.collect():
        for level in range(3):
            assert long[r["row_id"], level]["r"] == pytest.approx(r["residuals"][level])
    assert quantize.code_histogram(wide).agg(F.sum("n")).first()[0] == 720


# ---------------------------------------------------------------- posteriors


def test_nig_golden_and_order(spark):
    log = spark.createDataFrame([(0, 1.0), (0, 0.0), (0, 1.0), (1, 0.25)], "arm int, reward double")
    p = table(posterior.nig_posterior(log, 3), "arm")
    assert [p[0][c] for c in ("mu", "lam", "alpha", "beta")] == pytest.approx([0.5, 4, 2.5, 1.5])
    assert [p[2][c] for c in ("mu", "lam", "alpha", "beta")] == [0, 1, 1, 1]
    mu, lam, alpha, beta = 0.0, 1.0, 1.0, 1.0
    for x in (1.0, 0.0, 1.0):
        beta += 0.5 * lam * (x - mu) ** 2 / (lam + 1)
        mu, lam, alpha = (lam * mu + x) / (lam + 1), lam + 1, alpha + 0.5
    assert [mu, lam, alpha, beta] == pytest.approx([0.5, 4, 2.5, 1.5])


def test_linear_matches_rank_one_updates(spark, points):
    got = table(posterior.linear_posterior(points, 1.0), "arm")
    inv, f = {a: np.eye(5) for a in range(4)}, {a: np.zeros(5) for a in range(4)}
    for r in points.orderBy("row_id").collect():
        x = np.array(r["x"])
        v = inv[r["arm"]] @ x
        inv[r["arm"]] = inv[r["arm"]] - np.outer(v, v) / (1 + x @ v)
        f[r["arm"]] += r["reward"] * x
    for a in range(4):
        assert np.array(got[a]["cov"]).reshape(5, 5) == pytest.approx(inv[a])
        assert got[a]["mean"] == pytest.approx(inv[a] @ f[a])
        assert got[a]["n"] == 60


def test_goldens(spark):
    log = spark.createDataFrame([(0, [1.0, 2.0], 1.0), (0, [0.0, 1.0], 0.0)], "arm int, x array<double>, reward double")
    d = posterior.diag_posterior(log).first()
    assert d["prec"] == [2, 6] and d["f"] == [1, 2]
    full = posterior.linear_posterior(spark.createDataFrame([(0, [1.0, 0.0], 1.0)], log.schema)).first()
    assert full["a"] == [2, 0, 0, 1] and full["f"] == [1, 0] and full["mean"][0] == 0.5
    cell = spark.createDataFrame([([0], 0, 1.0), ([0], 0, 0.0), ([0], 0, 1.0)], "codes array<int>, arm int, reward double")
    c = posterior.counter_posterior(cell).first()
    assert (c["n"], c["f"], c["theta"]) == (3, 0.5, 0.125)
    assert diagnose.check_schedule(spark, 50, 16, 2, 4).agg(F.min("t"), F.max("t"), F.count("*"), F.max("alpha")).first()[:3] == (1600, 3276800, 12)


def test_depth_one_equals_counters(spark, points):
    coded = durable(quantize.encode(points, quantize.train_codebook(points, 2, 2, 3), residuals=True))
    one = table(posterior.counter_posterior(coded), "code", "arm")
    many = table(posterior.levelwise_counter_fit(coded, 2, 4, 2).where("level = 0"), "code", "arm")
    assert one.keys() == many.keys() and all(one[k]["theta"] == pytest.approx(many[k]["theta"]) for k in one)
    fits = {n: f(coded, 2, 4, 2) for n, f in (("d", posterior.levelwise_diag_fit), ("l", posterior.levelwise_linear_fit))}
    s = table(score.score_diag_rq(coded, fits["d"], 2, 4), "row_id", "arm")
    t = table(score.score_linear_rq(coded, fits["l"], 2, 4), "row_id", "arm")
    assert len(s) == len(t) == 960
    r = coded.where("row_id = 17").first()
    want = 0.0
    model = table(fits["l"], "level", "code", "arm")
    for level in range(2):
        m = model.get((level, r["codes"][level], 2))
        want += 0.5**level * (np.array(m["mean"]) @ np.array([*r["residuals"][level], 1.0]) if m else 0)
    assert t[17, 2]["mean"] == pytest.approx(want)


# ------------------------------------------------------------------- scoring


def test_scores_sent_and_joined(spark, points, monkeypatch):
    p = durable(posterior.linear_posterior(points))
    a = table(score.score_linear(points, p), "row_id", "arm")
    monkeypatch.setattr(score, "SEND_BYTES", 0)
    b = table(score.score_linear(points.drop("arm"), p), "row_id", "arm")
    assert len(b) == 960 and all(b[k]["mean"] == pytest.approx(a[k]["mean"]) and b[k]["var"] == pytest.approx(a[k]["var"]) for k in a if k in b)


def test_thompson_moments(spark):
    rows = spark.range(30_000).selectExpr("id as row_id", "0 as arm", "2.0D as mean", "4.0D as var")
    m, s = score.thompson(rows, 0.5, 7).agg(F.avg("score"), F.stddev("score")).first()
    assert abs(m - 2) < 0.03 and abs(s - 1) < 0.03


def test_nig_draws(spark):
    p = spark.createDataFrame([(0, 0.3, 5.0, 4.0, 5.0), (1, 0.3, 5.0, 4.0, 5.0)], "arm int, mu double, lam double, alpha double, beta double")
    d = score.sample_nig_means(p, 6000, 1)
    m, v = d.agg(F.avg("mean"), F.avg("variance")).first()
    assert abs(m - 0.3) < 0.03 and abs(v - 5 / 3) < 0.1
    assert score.select_ts_nig(p, 200, 1).count() == 200


def test_eps_share(spark):
    rows = spark.range(20_000).selectExpr("id as row_id", "9 as arm", "id + 1 as round")
    moved = score.select_eps_greedy(rows, 5, 3, 0.05).where("arm <> 9").count() / 20_000
    assert abs(moved - 0.05) < 0.006
    assert score.select_eps_greedy(rows.withColumn("arm", F.lit(None).cast("int")), 5, 3).where("arm is null").count() == 0
    eps = rows.where("round = 1").select(score.decaying_eps().alias("e")).first()["e"]
    assert eps == pytest.approx(0.144270, abs=1e-6)


# ----------------------------------------------------- models and diagnostics


def test_doubling():
    assert models.doubling_boundaries(500, 8000) == [500, 1500, 3500, 7500]


def test_phases(spark):
    df = spark.range(1, 4000).select(F.col("id").alias("round"), models.doubling_phase(F.col("id"), 500).alias("p"))
    assert {r["p"]: (r["a"], r["b"]) for r in df.groupBy("p").agg(F.min("round").alias("a"), F.max("round").alias("b")).collect()} == {0: (1, 500), 1: (501, 1500), 2: (1501, 3500), 3: (3501, 3999)}


def test_ridge(spark, points):
    w, b = models.fit_ridge_multi(points, 4, 2.0)
    x = np.array([r["x"] for r in points.collect()])
    y = np.eye(4)[[r["label"] for r in points.collect()]]
    c = x - x.mean(axis=0)
    want = np.linalg.solve(c.T @ c + 2 * np.eye(5), c.T @ (y - y.mean(axis=0))).T
    assert w == pytest.approx(want) and b == pytest.approx(y.mean(axis=0) - want @ x.mean(axis=0))


def test_additive_predictions(spark, points):
    coded = durable(quantize.encode(points, quantize.train_codebook(points, 2, 2, 3)))
    theta = models.fit_additive_ols(coded, 4, 2, 2)
    rows = coded.collect()
    design = np.zeros((len(rows), 8))
    for i, r in enumerate(rows):
        for level, c in enumerate(r["codes"]):
            design[i, level * 4 + c] = 1
    y = np.eye(4)[[r["label"] for r in rows]]
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = design @ np.concatenate(theta)
    assert got == pytest.approx(want, abs=1e-6)
    d = diagnose.delta_additive(coded, models.theta_table(spark, theta), 2, 4).first()
    assert d["delta"] == pytest.approx(np.abs(y - want).max(axis=1).mean(), abs=1e-6)


def test_boosted_empty_code(spark):
    df = spark.createDataFrame([(0, 1, [0])], "row_id long, label int, codes array<int>")
    m = table(models.fit_boosted_centroids(df, 5, 1, 1), "code")
    assert m[1]["mean"] == [0] * 5 and m[1]["smoothed"] == [0.2] * 5
    assert m[0]["smoothed"] == pytest.approx([0.1, 0.6, 0.1, 0.1, 0.1])


def test_trees(spark, points):
    model = models.fit_reward_gbt(points, 4, trees=3)
    assert score.choose(models.predict_reward(model, points.select("row_id", "x"), 4)).count() == 240
    log = points.withColumn("round", F.col("row_id") + 1)
    out = models.refit_every(log, log, 4, 100, trees=2)
    assert out.count() == 240 and out.where("arm is null").count() == 100


def test_report_and_stats(spark, points):
    for folds in (0, 3):
        r = diagnose.delta_report("p", points, (1, 2), 4, 2, 2, folds=folds).collect()
        assert [x["depth"] for x in r] == [1, 2] and all(0 < x["delta_rq_mae"] < 0.5 and x["N"] == 240 and x["d"] == 5 for x in r)
        assert r[0]["delta_gap"] == pytest.approx(r[0]["delta_lin_mae"] - r[0]["delta_rq_mae"])
    assert diagnose.dataset_stats(points, "p").first()[:] == ("p", 5, 4, 240, 100, 0.25)
    assert diagnose.best_fixed_arm(points).first()["arm"] == 0
    flat = spark.createDataFrame([(0, [1.0], 0), (1, [1.0], 1)], "row_id long, x array<double>, label int")
    assert diagnose.correlation_ratio(flat).first()["rho"] == 0
    apart = spark.createDataFrame([(0, [1.0], 0), (1, [5.0], 1)], "row_id long, x array<double>, label int")
    assert diagnose.correlation_ratio(apart).first()["rho"] == 1
    sweep = diagnose.delta_additive_sweep(points, (1, 2), (0, 1), 100, 4, 2, 2)
    assert sweep.count() == 4 and diagnose.summarize_sweep(sweep).where("twice <> 2 * delta").count() == 0


# ----------------------------------------------------------- promotion tests


def errors(spark, diffs, run=0):
    return spark.createDataFrame([(run, i + 1, 1.0 + d, 1.0) for i, d in enumerate(diffs)], "run_id int, round long, sq_err_active double, sq_err_shadow double")


def test_t_tail():
    assert diagnose.t_tail(0, 5) == pytest.approx(0.5)
    assert diagnose.t_tail(2.570582, 5) == pytest.approx(0.025, abs=1e-6)
    assert diagnose.t_tail(1.644854, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert diagnose.t_tail(-1.0, 3) == pytest.approx(1 - diagnose.t_tail(1.0, 3))


def test_freedman_golden(spark):
    alpha = 0.05 / 12
    r = diagnose.compare_promotion_tests(errors(spark, [0.1] * 1000), ["run_id"], alpha).first()
    assert r["total"] == pytest.approx(100) and r["log_p"] == pytest.approx(-1500, rel=1e-6) and r["promote_freedman"] and r["promote_t"]
    low = diagnose.compare_promotion_tests(errors(spark, [-0.1, 0.1] * 20), ["run_id"], alpha).first()
    assert not low["promote_freedman"] and not low["promote_t"]
    flat = diagnose.compare_promotion_tests(errors(spark, [0.0] * 9), ["run_id"], alpha).first()
    assert not flat["promote_freedman"] and not flat["promote_t"]


@pytest.mark.parametrize("test", ["ttest", "freedman"])
def test_promotion_walk(spark, test):
    sched = spark.createDataFrame([(k, 20 * 2**k, 0.01) for k in range(4)], "k int, t long, alpha double")
    rng = np.random.default_rng(2)
    diffs = (0.5 + 0.05 * rng.normal(size=200)).tolist()
    both = errors(spark, diffs).union(errors(spark, (-np.array(diffs)).tolist(), 1))
    got = sorted(tuple(r) for r in diagnose.promotion_log(both, sched, 30, test).collect())
    # 20 has too few rows; 40 promotes; 80 and 160 have a whole window since
    assert got == [(0, 40, 1, 2), (0, 80, 2, 3), (0, 160, 3, 4)]
    assert [tuple(r) for r in diagnose.promotion_log(both, sched, 50, test, max_level=2).collect()] == [(0, 80, 1, 2)]
    report = {r["run_id"]: r["report"] for r in decisions.promotion_report(diagnose.promotion_log(both, sched, 30, test), spark.createDataFrame([(0, 4), (1, 1)], "run_id int, depth int")).collect()}
    assert report == {0: "1->2 at 40, 2->3 at 80, 3->4 at 160", 1: "depth 1"}


def test_regret(spark):
    log = spark.createDataFrame([("a", 1, r, float(r % 3 == 0)) for r in range(1, 26)], "method string, seed int, round long, reward double")
    curve = {r["round"]: r["regret"] for r in decisions.regret_curve(log, 10).collect()}
    assert curve == {10: 7, 20: 14, 25: 17}
    assert decisions.final_regret(log).first()["final_regret"] == 17
    s = spark.createDataFrame([("a", 10.0), ("b", 15.0)], "method string, mean double")
    assert {r["method"]: r["relative"] for r in decisions.relative_to_baseline(s, "a").collect()} == {"a": None, "b": 50}
    assert decisions.sweep_grid(spark, a=[1, 2], b=["x"]).count() == 2



def test_score_diag_deals_no_arm_to_one_task(spark, points, monkeypatch):
    fitted = durable(posterior.diag_posterior(points))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = score.score_diag(points, fitted)
        plan = sent._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        monkeypatch.setattr(score, "SEND_BYTES", 0)
        dealt = score.score_diag(points, fitted)
        assert "_salt" in dealt._jdf.queryExecution().executedPlan().toString()
        one, two = table(sent, "row_id", "arm"), table(dealt, "row_id", "arm")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert one == two and len(one) == 960
