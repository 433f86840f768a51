"""Ledgers merge, compact and replay; adaptive learners agree with a plain walk over batches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions.lineage import durable
from arbora.operators import diagnose, posterior, quantize
from arbora.plans import adaptive as plans
from arbora.streaming import adaptive
from arbora.streaming.ledger import Ledger, versions


def key(df, *cols):
    return sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(*(cols or df.columns)).collect())


def folders(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_ledger_sums(spark, tmp_path):
    ledger = Ledger(str(tmp_path), "k int, n long, f double", ("k",), "sum", every=3)
    assert ledger.read(spark) is None
    want = {}
    for v in range(8):
        rows = [(v % 4, 1, 0.5), (4 + v, 2, 1.0)]
        ledger.append(spark.createDataFrame(rows, ledger.schema).coalesce(1), v)
        for k, n, f in rows:
            a, b = want.get(k, (0, 0.0))
            want[k] = (a + n, b + f)
        assert key(ledger.read(spark)) == sorted((k, n, f) for k, (n, f) in want.items())
    # two bases and what came after the earlier one are all that is kept
    assert versions(spark, f"{tmp_path}/base") == [2, 5] and versions(spark, f"{tmp_path}/delta") == [3, 4, 5, 6, 7]
    assert key(ledger.read(spark, before=7)) == sorted((k, n - 2 * (k == 11) - (k == 3), f - (k == 11) - 0.5 * (k == 3)) for k, (n, f) in want.items() if k != 11)
    assert key(ledger.read(spark, only=spark.createDataFrame([(3,), (99,)], "k int"))) == [(3, *want[3])]
    # a replay of a compacting version, and of the last one, changes nothing
    before = key(ledger.read(spark))
    ledger.append(spark.createDataFrame([(5 % 4, 1, 0.5), (9, 2, 1.0)], ledger.schema), 5)
    ledger.append(spark.createDataFrame([(7 % 4, 1, 0.5), (11, 2, 1.0)], ledger.schema), 7)
    assert key(ledger.read(spark)) == before


def test_ledger_writes_follow_the_batch(spark, tmp_path):
    ledger = Ledger(str(tmp_path), "k long, n long", ("k",), "sum", every=100)
    size = lambda v: sum(os.path.getsize(f"{tmp_path}/delta/version={v}/{f}") for f in folders(f"{tmp_path}/delta/version={v}") if f.endswith(".parquet"))
    ledger.append(spark.range(200_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("n")), 0)
    ledger.append(spark.range(10).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")).coalesce(1), 1)
    assert size(1) * 100 < size(0)


def test_ledger_last(spark, tmp_path):
    ledger = Ledger(str(tmp_path), "k int, n long", ("k",), "last", every=2)
    for v, rows in enumerate([[(1, 1), (2, 1)], [(1, 5)], [(3, 1)], [(2, 9)], [(1, 6)]]):
        ledger.append(spark.createDataFrame(rows, ledger.schema), v)
    assert key(ledger.read(spark)) == [(1, 6), (2, 9), (3, 1)]
    assert key(ledger.read(spark, before=4)) == [(1, 5), (2, 9), (3, 1)]


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 2)) + 3 * rng.integers(0, 2, size=(240, 1))
    rows = [(i, i + 1, v.tolist(), int(rng.integers(0, 2)), 0.0) for i, v in enumerate(x)]
    df = durable(spark.createDataFrame(rows, "row_id long, round long, x array<double>, arm int, reward double"))
    book = quantize.train_codebook(df, 3, 1, 3)
    out = quantize.encode(df, book, residuals=True)
    # the reward follows the codes of deeper levels
    good = (F.get("codes", F.lit(1)) + (F.col("round") > 120).cast("int") * F.get("codes", F.lit(2))) % 2 == F.col("arm")
    return book, durable(out.withColumn("reward", good.cast("double")))


class Walk:
    """A learner by plain loops, one batch at a time, statistics of the batch's start."""

    def __init__(self, kind, levels, schedule, window, lam=1.0, eta=0.5):
        self.kind, self.levels, self.schedule, self.window, self.lam, self.eta = kind, levels, schedule, window, lam, eta
        self.a, self.f, self.depth, self.since, self.errors, self.promoted = {}, {}, 1, 0, [], []

    def vector(self, r, level):
        return np.array([1.0]) if self.kind == "counter" else np.append(r["residuals"][level], 1.0)

    def weights(self, cell, d):
        if cell not in self.a:
            return np.zeros(d)
        lam = self.lam * 0.25 ** cell[0] if self.kind == "linear" else self.lam
        return np.linalg.solve(lam * np.eye(d) + (np.diag(np.diag(self.a[cell])) if self.kind == "diag" else self.a[cell]), self.f[cell])

    def batch(self, rows):
        new, preds = [], {}
        for r in rows:
            total, out = 0.0, []
            for level in range(self.levels):
                z = self.vector(r, level)
                total += self.eta**level * z @ self.weights((level, r["codes"][level], r["arm"]), len(z))
                out.append(total)
            preds[r["round"]] = out
        clip = lambda v: min(max(v + 0.5, 0), 1)
        for r in sorted(rows, key=lambda r: r["round"]):
            p, t = preds[r["round"]], r["round"]
            shadow = min(self.depth + 1, self.levels)
            self.errors.append((t, (r["reward"] - clip(p[self.depth - 1])) ** 2, (r["reward"] - clip(p[shadow - 1])) ** 2))
            for level in range(shadow):
                new.append(((level, r["codes"][level], r["arm"]), self.vector(r, level), r["reward"] - clip(p[level - 1] if level else 0.0)))
            if t in self.schedule and self.depth < self.levels and t - self.since >= self.window:
                d = np.array([a - s for u, a, s in self.errors if t - self.window < u <= t])
                s, v, b = d.sum(), ((d - d.mean()) ** 2).sum(), abs(d).max()
                if s > 0 and -s * s / (2 * v + 2 * b * s / 3) < np.log(self.schedule[t]):
                    self.promoted.append((t, self.depth, self.depth + 1))
                    self.depth, self.since = self.depth + 1, t
        for cell, z, target in new:
            self.a[cell] = self.a.get(cell, 0) + np.outer(z, z)
            self.f[cell] = self.f.get(cell, 0) + target * z


@pytest.mark.parametrize("kind", ["counter", "diag", "linear"])
def test_learner_against_walk(spark, coded, tmp_path, kind):
    book, rows = coded
    # checks in the middle of batches, so that a batch is trained at two depths
    schedule = {100: 0.9, 130: 0.9, 190: 0.9, 230: 0.9}
    learner = adaptive.AdaptiveLearner(kind, book, str(tmp_path), 2, tuple(schedule.items()), 40, test="freedman", compact_every=2)
    walk = Walk(kind, 3, schedule, 40)
    for b in range(4):
        part = rows.where((F.col("round") > 60 * b) & (F.col("round") <= 60 * b + 60))
        walk.batch([r.asDict() for r in part.collect()])
        state = learner.learn(part, b)
        assert (state.depth, state.since, state.seen) == (walk.depth, walk.since, 60 * b + 60)
    assert len(walk.promoted) == 2 if kind == "counter" else walk.promoted
    assert key(learner.promotions(spark), "t", "old_depth", "new_depth") == walk.promoted
    errors = adaptive.read_batches(spark, f"{tmp_path}/errors", "round long, sq_err_active double, sq_err_shadow double")
    assert np.allclose(key(errors, "round", "sq_err_active", "sq_err_shadow"), sorted(walk.errors), atol=1e-7)
    found = learner.ledger.read(spark).collect()
    for r in found:
        cell = (r["level"], r["code"], r["arm"])
        if kind == "counter":
            assert r["n"] == walk.a[cell][0, 0] and abs(r["f"] - walk.f[cell][0]) < 1e-8
        elif kind == "diag":
            assert abs(r["q"] - walk.a[cell][r["i"], r["i"]]) < 1e-8 and abs(r["f"] - walk.f[cell][r["i"]]) < 1e-8
        else:
            assert abs(r["v"] - (walk.a[cell][r["i"], r["j"]] if r["j"] >= 0 else walk.f[cell][r["i"]])) < 1e-8
    assert {(r["level"], r["code"], r["arm"]) for r in found} == set(walk.a)
    # the last batch once more
    learner.learn(rows.where("round > 180"), 3)
    assert key(learner.ledger.read(spark)) == sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in found)


def test_decisions_follow_promotions(spark, coded, tmp_path):
    """A deciding stream uses the depth that a learning one reached; the choice differs from depth 1."""
    book, rows = coded
    learner = adaptive.AdaptiveLearner("counter", book, f"{tmp_path}/l", 2, ((120, 0.9),), 60, nu=0.0, test="freedman")
    contexts = rows.select("row_id", "x")
    contexts.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(contexts.schema).parquet(f"{tmp_path}/in")
    learner.learn(rows.where("round <= 60"), 0)
    adaptive.decide_stream(stream(), learner, f"{tmp_path}/a", f"{tmp_path}/ca").awaitTermination()
    assert learner.learn(rows.where("round > 60 and round <= 120"), 1).depth == 2
    adaptive.decide_stream(stream(), learner, f"{tmp_path}/b", f"{tmp_path}/cb").awaitTermination()
    a, b = ({r["row_id"]: r for r in spark.read.parquet(f"{tmp_path}/{p}").collect()} for p in "ab")
    assert {(r["depth"], r["version"]) for r in a.values()} == {(1, 0)} and {(r["depth"], r["version"]) for r in b.values()} == {(2, 1)}
    shallow = learner.decide(learner.encode(contexts), adaptive.State(1, 1, 0, 120), learner.models(spark, adaptive.State(1, 1, 0, 120)))
    assert any(r["arm"] != b[r["row_id"]]["arm"] for r in shallow.collect())


def test_settings_are_checked(coded):
    book, _ = coded
    for wrong in ({"min_level": 4}, {"min_level": 0}, {"min_level": 3, "max_level": 2}, {"test": "none"}, {"kind": "tree"}):
        with pytest.raises(ValueError):
            adaptive.AdaptiveLearner(**{"kind": "counter", "codebook": book, "folder": "x", "n_arms": 2, **wrong})
    assert adaptive.AdaptiveLearner("counter", book, "x", 2, min_level=2, max_level=9).levels == 3


def test_shadow_set_in_batch_form(spark, coded):
    """Statistics of a trained set equal those of the rows that train each level."""
    _, rows = coded
    at = rows.withColumn("trained", F.when(F.col("round") > 100, 3).otherwise(2))
    fit = posterior.levelwise_counter_fit(at, 3, 2, 1, trained=F.col("trained"))
    assert {(r["level"], r["n"]) for r in fit.groupBy("level").agg(F.sum("n").alias("n")).collect()} == {(0, 240), (1, 240), (2, 140)}
    whole = posterior.levelwise_counter_fit(rows, 2, 2, 1)
    assert key(fit.where("level < 2"), "level", "code", "arm", "n", "f") == key(whole, "level", "code", "arm", "n", "f")


@pytest.mark.parametrize("kind", ["diag", "linear"])
def test_chosen_predictions_equal_all_arms(spark, coded, kind, monkeypatch):
    _, rows = coded
    fit = durable((posterior.levelwise_diag_fit if kind == "diag" else posterior.levelwise_linear_fit)(rows.where("arm = 0 or round > 50"), 3, 2, 1))
    score_all = {"diag": __import__("arbora.operators.score", fromlist=["x"]).score_diag_rq, "linear": __import__("arbora.operators.score", fromlist=["x"]).score_linear_rq}[kind]
    want = {}
    for depth in (1, 2, 3):
        for r in score_all(rows, fit, depth, 2).join(rows.select("row_id", "arm"), ["row_id", "arm"]).collect():
            want.setdefault(r["row_id"], []).append(r["mean"])
    for limit in (64 << 20, 0):  # sent to the tasks, and joined
        monkeypatch.setattr(diagnose, "SEND_BYTES", limit)
        out = diagnose.chosen_predictions(rows.withColumn("arm", F.when(F.col("row_id") > 0, F.col("arm"))), diagnose.weights(kind, fit), 3)
        assert "expand" not in out._jdf.queryExecution().executedPlan().toString().lower()
        for r in out.collect():
            assert np.allclose(r["preds"], want[r["row_id"]] if r["row_id"] else [0, 0, 0], atol=1e-9)


def test_update_mode_restarts(spark, tmp_path):
    ledger = adaptive.counters_ledger(f"{tmp_path}/t", "arm int", every=2)
    rows = [(i % 3, float(i)) for i in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part::3] + rows[:part], "arm int, reward double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("arm int, reward double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        adaptive.upsert_stream(stream, ("arm",), ledger, f"{tmp_path}/c").awaitTermination()
    want = spark.read.parquet(f"{tmp_path}/in").groupBy("arm").agg(F.count("*").alias("n"), F.sum("reward").alias("s"))
    assert key(ledger.read(spark), "arm", "n", "s") == key(want, "arm", "n", "s")


def test_batches_do_not_follow_the_input_files(spark, tmp_path, monkeypatch):
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    source.repartition(6).write.parquet(f"{tmp_path}/embeddings.parquet")
    started, upsert = [], adaptive.upsert_stream

    def counted(*args):
        started.append(upsert(*args))
        return started[-1]

    monkeypatch.setattr(adaptive, "upsert_stream", counted)
    found = plans.r4_running_code_counters(spark, str(tmp_path))
    assert found.agg(F.sum("n")).first()[0] == 2 * source.count()
    assert [sum(p["numInputRows"] > 0 for p in q.recentProgress) for q in started] == [1, 2]
