"""Deciding and learning in micro-batches of Structured Streaming.

A batch is decided and learnt from with the tables as they were at its start; statistics are sums, so
each batch adds to them. Tables are written as `version=<batch id>`, and a batch that is replayed
starts from the version before it and overwrites its own: nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbora.functions import noise
from arbora.functions.vectors import add_intercept, dot, sigmoid_clip
from arbora.operators import diagnose, posterior, quantize, score
from arbora.sources.results import append_checkpoints


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions of a table that were written as a whole."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_version(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest version, or the newest below `before`; None if there is none."""
    usable = [v for v in _versions(spark, folder) if before is None or v < before]
    return spark.read.parquet(f"{folder}/version={usable[-1]}") if usable else None


def write_version(df: DataFrame, folder: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")


_EMPTY = {
    "counter": "level int, code int, arm int, n long, f double, theta double",
    "diag": "level int, code int, arm int, n long, prec array<double>, f array<double>",
    "linear": "level int, code int, arm int, n long, a array<double>, f array<double>, cov array<double>, mean array<double>",
}
_SCORES = {"counter": score.score_counter_rq, "diag": score.score_diag_rq, "linear": score.score_linear_rq}


def decide_batch(contexts: DataFrame, codebook: quantize.Codebook, table: DataFrame | None, depth: int, n_arms: int, eta: float = 0.5, nu: float = 0.1, lam: float = 1.0, seed: int = 0, kind: str = "counter") -> DataFrame:
    """(row_id, codes, arm): encode, score with the hierarchical model of this kind (counter, diag or
    linear) and choose, for one batch. Without a table all cells have the prior."""
    coded = quantize.encode(contexts, codebook, residuals=kind != "counter")
    if table is None:
        table = contexts.sparkSession.createDataFrame([], _EMPTY[kind])
    picked = score.choose(_SCORES[kind](coded, table, depth, n_arms, eta, nu, lam, seed))
    return coded.select("row_id", "codes").join(picked, "row_id").select("row_id", "codes", "arm")


def decide_flat_batch(contexts: DataFrame, table: DataFrame, kind: str = "linear", nu: float = 0.1, seed: int = 0) -> DataFrame:
    """(row_id, arm) for one batch by a flat model: `linear` or `diag` on x, or `nig`, which draws each
    arm's mean anew for every context."""
    if kind == "nig":
        fields = ["arm", "mu", "lam", "alpha", "beta"]
        arms = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in fields]) for r in table.select(*fields).collect()])  # one an arm
        long = contexts.select("row_id", F.explode(arms).alias("a")).select("row_id", "a.*")
        variance = F.col("beta") / F.greatest(score.gamma(F.col("alpha"), "row_id", "arm", seed), F.lit(1e-10))
        scored = long.withColumn("score", F.col("mu") + noise.normal("row_id", "arm", seed) * F.sqrt(variance / F.col("lam")))
    else:
        scored = score.thompson((score.score_linear if kind == "linear" else score.score_diag)(contexts.select("row_id", "x"), table), nu, seed)
    return score.choose(scored)


def decide_stream(contexts: DataFrame, decide: Callable[[DataFrame, DataFrame | None], DataFrame], table_folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Decides every context of the stream with the newest posterior at its batch's start.

    `decide` takes the batch and that table (None if there is none yet): `decide_batch` or
    `decide_flat_batch` with their settings bound.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        append_checkpoints(decide(df, read_version(df.sparkSession, table_folder)), out, batch_id)

    return contexts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _targets(batch: DataFrame, table: DataFrame | None, levels: int, eta: float, value: str, predict: Callable[[str], Column]) -> list[DataFrame]:
    """For each level the batch with `code`, the level's vector `_z` and the target `_t`: the reward less
    the prediction of the lower levels by the table at the batch's start."""
    rows, out = batch.withColumn("_p", F.lit(0.0)), []
    residuals = "residuals" in batch.columns
    for level in range(levels):
        at = rows.withColumn("code", F.get("codes", F.lit(level))).withColumn("_t", F.col("reward") - sigmoid_clip(F.col("_p")))
        if residuals:
            at = at.withColumn("_z", add_intercept(F.get("residuals", F.lit(level))))
        out.append(at)
        if table is not None:
            look = table.where(F.col("level") == level).select("code", "arm", F.col(value).alias("_v"))
            at = at.join(look, ["code", "arm"], "left").withColumn("_p", F.col("_p") + eta**level * F.coalesce(predict("_v"), F.lit(0.0))).drop("_v")
        rows = at.drop("code", "_t", "_z")
    return out


def fold_counters(table: DataFrame | None, batch: DataFrame, levels: int, lam: float = 1.0, eta: float = 0.5) -> DataFrame:
    """Counters with a batch of (codes, arm, reward) added; targets use the values at its start."""
    at = _targets(batch.select("codes", "arm", "reward"), table, levels, eta, "theta", F.col)
    total = posterior._union([a.groupBy(F.lit(level).alias("level"), "code", "arm").agg(F.count("*").alias("n"), F.sum("_t").alias("f")) for level, a in enumerate(at)])
    if table is not None:
        total = total.unionByName(table.select("level", "code", "arm", "n", "f"))
    summed = total.groupBy("level", "code", "arm").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    return summed.withColumn("theta", F.col("f") / (F.col("n") + lam))


def fold_diag(table: DataFrame | None, batch: DataFrame, levels: int, lam: float = 1.0, eta: float = 0.5) -> DataFrame:
    """(level, code, arm, n, prec, f): diagonal models on residuals and an intercept with a batch of
    (codes, residuals, arm, reward) added; targets use the values at its start."""
    weights = table.withColumn("w", F.zip_with("f", "prec", lambda f, p: f / p)) if table is not None else None
    at = _targets(batch.select("codes", "residuals", "arm", "reward"), weights, levels, eta, "w", lambda v: dot(F.col(v), F.col("_z")))
    new = posterior._union([posterior.diag_sums(a, ["code", "arm"], "_z", F.col("_t")).withColumn("level", F.lit(level)) for level, a in enumerate(at)])
    new = new.select("level", "code", "arm", "n", F.transform("s2", lambda v: v + lam).alias("prec"), "f")
    if table is None:
        return new
    keys, add = ["level", "code", "arm"], lambda a, b, less: F.coalesce(F.zip_with(a, b, lambda x, y: x + y - less), a, b)
    both = table.join(new.select(*keys, F.col("n").alias("n2"), F.col("prec").alias("prec2"), F.col("f").alias("f2")), keys, "full_outer")
    return both.select(*keys, (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), add(F.col("prec"), F.col("prec2"), lam).alias("prec"), add(F.col("f"), F.col("f2"), 0.0).alias("f"))


def fold_linear(table: DataFrame | None, batch: DataFrame, levels: int, lam: float = 1.0, eta: float = 0.5) -> DataFrame:
    """(level, code, arm, i, j, v, n): the sums of full models on residuals and an intercept (see
    `posterior.gram`) with a batch added; `solve_levels` makes the models. Targets use those at its start."""
    models = solve_levels(table, levels, lam) if table is not None else None
    at = _targets(batch.select("codes", "residuals", "arm", "reward"), models, levels, eta, "mean", lambda v: dot(F.col(v), F.col("_z")))
    new = posterior._union([posterior.gram(a, ["code", "arm"], "_z", "_t").withColumn("level", F.lit(level)) for level, a in enumerate(at)])
    keys = ["level", "code", "arm", "i", "j"]
    return fold_sums(table, new.select(*keys, "v", "n"), keys, ["v", "n"])


def solve_levels(sums: DataFrame, levels: int, lam: float = 1.0) -> DataFrame:
    """(level, code, arm, n, a, f, cov, mean) from `fold_linear`; the prior of level l is lam * 0.25**l."""
    return posterior.solve(sums, ["level", "code", "arm"], lam * F.pow(F.lit(0.25), F.col("level")))


def fold_sums(table: DataFrame | None, new: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Any table of sums with a batch's sums added: one aggregation over both."""
    both = new if table is None else table.unionByName(new)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def learn_stream(rewards: DataFrame, folder: str, checkpoint: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame]) -> StreamingQuery:
    """Folds every batch into the newest table below its id and writes version = batch id.

    `fold` takes the table at the batch's start (None at first) and the batch: `fold_counters`,
    `fold_diag`, `fold_linear`, `nig_merge`, or `fold_sums` over the sums of a flat model.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        table = read_version(df.sparkSession, folder, before=batch_id)
        write_version(fold(table, df), folder, batch_id)

    return rewards.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def promote_stream(rewards: DataFrame, codebook: quantize.Codebook, folder: str, checkpoint: str, schedule: list[tuple[int, float]], window: int, levels: int, n_arms: int, lam: float = 1.0, eta: float = 0.5, test: str = "freedman") -> StreamingQuery:
    """Learns counters, appends the errors of the active and the next depth of every batch, and at each
    check round in it tests the last `window` of them; promotions are appended under
    `folder`/promotions. Rows after a promotion, and later checks of the same batch, are judged at the
    new depth.

    Rows carry row_id, round, x, arm and reward. Errors are those of the batch-start tables. All levels
    are trained from the start and no decision reads the depth; `streaming.adaptive` has learners of every
    kind that train up to their shadow and decide by the depth they reached.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        coded = quantize.encode(df, codebook).persist()
        table = read_version(spark, f"{folder}/counters", before=batch_id)
        done = _read(spark, f"{folder}/promotions", "t long, old_depth int, new_depth int", batch_id)
        depth, since = done.agg(F.coalesce(F.max("new_depth"), F.lit(1)), F.coalesce(F.max("t"), F.lit(0))).first()
        use = table if table is not None else spark.createDataFrame([], _EMPTY["counter"])
        predicted = diagnose.counter_predictions(coded, use, levels, eta).select("round", "reward", "preds").persist()
        first, last = predicted.agg(F.min("round"), F.max("round")).first()
        earlier = _read(spark, f"{folder}/errors", _ERRORS, batch_id).select("round", "sq_err_active", "sq_err_shadow")
        at_depth = lambda: diagnose.depth_errors(predicted, depth, min(depth + 1, levels), "round")
        errors, promoted = at_depth(), []
        for t, alpha in [] if last is None else [c for c in schedule if first <= c[0] <= last]:
            if depth >= levels or t - since < window:
                continue
            seen = earlier.unionByName(errors).where((F.col("round") <= t) & (F.col("round") > max(t - window, since)))
            both = diagnose.compare_promotion_tests(seen.withColumn("run_id", F.lit(0)), ["run_id"], alpha).first()
            if both and both["n"] >= window and both["promote_freedman" if test == "freedman" else "promote_t"]:
                promoted.append((t, depth, depth + 1))
                depth, since = depth + 1, t
                errors = errors.where(F.col("round") <= t).unionByName(at_depth().where(F.col("round") > t))
        append_checkpoints(errors, f"{folder}/errors", batch_id)
        write_version(fold_counters(table, coded, levels, lam, eta), f"{folder}/counters", batch_id)
        append_checkpoints(spark.createDataFrame(promoted, "t long, old_depth int, new_depth int"), f"{folder}/promotions", batch_id)
        predicted.unpersist()
        coded.unpersist()

    return rewards.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_ERRORS = "round long, sq_err_active double, sq_err_shadow double"


def _read(spark: SparkSession, folder: str, schema: str, before: int) -> DataFrame:
    """Rows that batches below `before` appended."""
    try:
        return spark.read.schema(f"{schema}, batch_id long").parquet(folder).where(F.col("batch_id") < before)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def running_counters(rewards: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """Continuously maintained count, sum and sum of squares of rewards; use with output mode update
    or complete. The state is one row a key."""
    return rewards.groupBy(*by).agg(F.count("reward").alias("n"), F.sum("reward").alias("s"), F.sum(F.col("reward") * F.col("reward")).alias("ss"))


def running_code_counters(encoded: DataFrame) -> DataFrame:
    """The same by (level, code, arm), for rows with codes."""
    return running_counters(encoded.select("arm", "reward", F.posexplode("codes").alias("level", "code")), ("level", "code", "arm"))
