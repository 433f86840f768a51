"""Streams that decide, learn and deepen: hierarchical learners whose active depth grows.

A learner's state is one snapshot: the number of levels that decide, the round of the last promotion
and the statistics tables, all as of one batch. A batch is decided and learnt from with the snapshot at
its start. The levels that decide and one more, the shadow, are trained; deeper ones wait for their
turn. At each check round the squared errors of the last `window` rounds at both depths are tested, and
where the shadow wins it becomes active: later rounds, of the same batch too, are judged and trained one
level deeper, and the next batch is decided by it.

The state is written last, so it names tables that are complete; a batch that is replayed starts from
the state below its own id and overwrites what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbora.functions.vectors import add_intercept, sigmoid_clip
from arbora.operators import diagnose, posterior, quantize, score
from arbora.sources.results import append_checkpoints
from arbora.streaming.ledger import Ledger, versions

#: Statistics of each kind of model: the table's columns, and which of them are keys.
_TABLES = {
    "counter": ("level int, code int, arm int, n long, f double", ("level", "code", "arm")),
    "diag": ("level int, code int, arm int, i int, n long, q double, f double", ("level", "code", "arm", "i")),
    "linear": ("level int, code int, arm int, i int, j int, v double, n long", ("level", "code", "arm", "i", "j")),
}
_EMPTY = {
    "counter": "level int, code int, arm int, n long, f double, theta double",
    "diag": "level int, code int, arm int, n long, prec array<double>, f array<double>",
    "linear": "level int, code int, arm int, n long, a array<double>, f array<double>, cov array<double>, mean array<double>",
}
_SCORES = {"counter": score.score_counter_rq, "diag": score.score_diag_rq, "linear": score.score_linear_rq}
_ERRORS = "round long, sq_err_active double, sq_err_shadow double"
_STATE = "depth int, since long, seen long, promoted array<struct<t:long,old_depth:int,new_depth:int>>"


def level_sums(kind: str, rows: DataFrame, trained: Column) -> DataFrame:
    """What a batch adds to the statistics of the first `trained` levels of each row, in one pass.

    `rows` has codes, arm, reward and `preds` (the prediction of the chosen arm over the first 1, 2, ...
    levels), and for vector models residuals. The target of a level is the reward less the clipped
    prediction of the levels below it, whatever these were when the batch began.
    """
    below = F.when(F.col("level") == 0, F.lit(0.0)).otherwise(F.get("preds", F.col("level") - 1))
    vector = [] if kind == "counter" else [add_intercept(F.get("residuals", F.col("level"))).alias("z")]
    each = rows.select("*", F.posexplode(F.slice("codes", F.lit(1), trained)).alias("level", "code"))
    each = each.select("level", "code", "arm", (F.col("reward") - sigmoid_clip(below)).alias("t"), *vector)
    keys = ["level", "code", "arm"]
    if kind == "counter":
        return each.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("t").alias("f"))
    if kind == "diag":
        return posterior.position_sums(each, keys, "z", F.col("t")).select(*keys, "i", "n", "q", "f")
    return posterior.gram(each, keys, "z", "t")


def models_of(kind: str, sums: DataFrame | None, spark: SparkSession, lam: float = 1.0) -> DataFrame:
    """The model table that `score` and `chosen_predictions` read, from statistics (None: no cell)."""
    if sums is None:
        return spark.createDataFrame([], _EMPTY[kind])
    keys = ["level", "code", "arm"]
    if kind == "counter":
        return sums.withColumn("theta", F.col("f") / (F.col("n") + lam))
    if kind == "diag":
        cells = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "q", "f"))).alias("p"), F.max("n").alias("n"))
        return cells.select(*keys, "n", F.transform("p", lambda p: p["q"] + lam).alias("prec"), F.transform("p", lambda p: p["f"]).alias("f"))
    return posterior.solve(sums, keys, lam * F.pow(F.lit(0.25), F.col("level")))


def predictions(kind: str, rows: DataFrame, models: DataFrame, levels: int, eta: float) -> DataFrame:
    """`rows` with `preds` of the arm that was chosen; other arms are never scored."""
    if kind == "counter":
        return diagnose.counter_predictions(rows, models, levels, eta)
    return diagnose.chosen_predictions(rows, diagnose.weights(kind, models), levels, eta)


@dataclass(frozen=True)
class State:
    """What one batch left: its id (-1: none yet), active depth, round of the last promotion, rounds seen."""

    version: int
    depth: int
    since: int
    seen: int


@dataclass(frozen=True)
class AdaptiveLearner:
    """A learner of `kind` counter, diag or linear over `codebook`, with its tables under `folder`.

    `schedule` lists check rounds with their error probabilities; without one the depth stays
    `min_level`. Levels beyond `max_level`, or beyond the codebook, are never trained.
    """

    kind: str
    codebook: quantize.Codebook
    folder: str
    n_arms: int
    schedule: tuple[tuple[int, float], ...] = ()
    window: int = 1000
    min_level: int = 1
    max_level: int = 8
    lam: float = 1.0
    eta: float = 0.5
    nu: float = 0.1
    seed: int = 0
    test: str = "ttest"
    compact_every: int = 8

    def __post_init__(self) -> None:
        if self.kind not in _TABLES or self.test not in ("ttest", "freedman"):
            raise ValueError(f"unknown kind {self.kind!r} or test {self.test!r}")
        if not 1 <= self.min_level <= min(self.max_level, len(self.codebook)):
            raise ValueError(f"min_level {self.min_level} needs as many levels; there are {min(self.max_level, len(self.codebook))}")

    @property
    def levels(self) -> int:
        return min(self.max_level, len(self.codebook))

    @cached_property
    def ledger(self) -> Ledger:
        schema, keys = _TABLES[self.kind]
        return Ledger(f"{self.folder}/{self.kind}", schema, keys, "sum", self.compact_every)

    def state(self, spark: SparkSession, before: int | None = None) -> State:
        """The newest state, or the newest below a batch id."""
        usable = [v for v in versions(spark, f"{self.folder}/state") if before is None or v < before]
        if not usable:
            return State(-1, self.min_level, 0, 0)
        r = spark.read.schema(_STATE).parquet(f"{self.folder}/state/version={usable[-1]}").first()
        return State(usable[-1], r["depth"], r["since"], r["seen"])

    def models(self, spark: SparkSession, state: State, only: DataFrame | None = None) -> DataFrame:
        """Models as of a state; `only` holds the (level, code) that are needed."""
        return models_of(self.kind, self.ledger.read(spark, state.version + 1, only), spark, self.lam)

    def encode(self, contexts: DataFrame) -> DataFrame:
        return quantize.encode(contexts, self.codebook, residuals=self.kind != "counter")

    def cells(self, coded: DataFrame, levels: int) -> DataFrame:
        """(level, code) of the first levels of a batch."""
        return coded.select(F.posexplode(F.slice("codes", 1, levels)).alias("level", "code")).distinct()

    def decide(self, coded: DataFrame, state: State, models: DataFrame) -> DataFrame:
        """`coded` with the chosen `arm` and the `depth` that chose it."""
        picked = score.choose(_SCORES[self.kind](coded, models, state.depth, self.n_arms, self.eta, self.nu, self.lam, self.seed))
        return coded.drop("arm", "depth").join(picked, "row_id").withColumn("depth", F.lit(state.depth))

    def learn(self, coded: DataFrame, batch_id: int, models: DataFrame | None = None) -> State:
        """Learns a batch of (round, codes[, residuals], arm, reward) and tests at the check rounds in it.
        `models` are those of the state below the batch, if they were read already."""
        spark, old = coded.sparkSession, self.state(coded.sparkSession, batch_id)
        use = self.models(spark, old, self.cells(coded, self.levels)).persist() if models is None else models
        fields = ["round", "codes", "arm", "reward", *([] if self.kind == "counter" else ["residuals"])]
        predicted = predictions(self.kind, coded.select(*fields), use, self.levels, self.eta).persist()
        try:
            first, last, n = predicted.agg(F.min("round"), F.max("round"), F.count("*")).first()
            depths, depth, since = [(0, old.depth)], old.depth, old.since
            for t, alpha in sorted(self.schedule):
                if n and first <= t <= last and depth < self.levels and self._won(predicted, batch_id, depths, t, since, alpha):
                    depth, since = depth + 1, t
                    depths.append((t, depth))
            at = self._depth(depths)
            append_checkpoints(self._errors(predicted, depths), f"{self.folder}/errors", batch_id)
            self.ledger.append(level_sums(self.kind, predicted, F.least(at + 1, F.lit(self.levels))), batch_id)
            promoted = [(t, d - 1, d) for t, d in depths[1:]]
            new = State(batch_id, depth, since, old.seen + n)
            spark.createDataFrame([(new.depth, new.since, new.seen, promoted)], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/version={batch_id}")
            return new
        finally:
            predicted.unpersist()
            if models is None:
                use.unpersist()

    @staticmethod
    def _depth(depths: list[tuple[int, int]]) -> Column:
        """Active depth of a row by its round: that of the last promotion before it."""
        out = F.lit(depths[0][1])
        for t, depth in depths[1:]:
            out = F.when(F.col("round") > t, F.lit(depth)).otherwise(out)
        return out

    def _errors(self, predicted: DataFrame, depths: list[tuple[int, int]]) -> DataFrame:
        at = self._depth(depths)
        error = lambda depth: F.pow(F.col("reward") - sigmoid_clip(F.get("preds", depth - 1)), F.lit(2.0))
        return predicted.select("round", error(at).alias("sq_err_active"), error(F.least(at + 1, F.lit(self.levels))).alias("sq_err_shadow"))

    def _won(self, predicted: DataFrame, batch_id: int, depths: list[tuple[int, int]], t: int, since: int, alpha: float) -> bool:
        """Whether the shadow wins the window that ends at round t; a window with too few rows does not."""
        if t - since < self.window:
            return False
        earlier = read_batches(predicted.sparkSession, f"{self.folder}/errors", _ERRORS, batch_id).drop("batch_id")
        seen = earlier.unionByName(self._errors(predicted, depths)).where((F.col("round") <= t) & (F.col("round") > t - self.window))
        found = diagnose.window_moments(seen, []).first()
        return found["n"] >= self.window and diagnose.wins(self.test, *[found[c] for c in ("n", "mean", "sd", "total", "spread", "top")], alpha)

    def promotions(self, spark: SparkSession) -> DataFrame:
        """(batch_id, t, old_depth, new_depth) of all batches."""
        rows = spark.read.schema(f"{_STATE}, version long").parquet(f"{self.folder}/state")
        return rows.select(F.col("version").alias("batch_id"), F.inline("promoted"))


def read_batches(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows that batches (below `before`) appended to a folder by `append_checkpoints`."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(f"{schema}, batch_id long").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{schema}, batch_id long")
    return rows if before is None else rows.where(F.col("batch_id") < before)


def learn_stream(rewards: DataFrame, learner: AdaptiveLearner, checkpoint: str) -> StreamingQuery:
    """Learns from a stream of (round, x, arm, reward) that were decided elsewhere."""
    return rewards.writeStream.foreachBatch(lambda df, batch_id: learner.learn(learner.encode(df), batch_id) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decide_stream(contexts: DataFrame, learner: AdaptiveLearner, out: str, checkpoint: str) -> StreamingQuery:
    """Decides a stream of (row_id, x) with the newest complete snapshot at each batch's start: what a
    learning stream promotes, this one uses from its next batch on."""

    def batch(df: DataFrame, batch_id: int) -> None:
        state, coded = learner.state(df.sparkSession), learner.encode(df)
        models = learner.models(df.sparkSession, state, learner.cells(coded, state.depth)).persist()
        try:
            decided = learner.decide(coded, state, models).withColumn("version", F.lit(state.version))
            append_checkpoints(decided.select("row_id", "arm", "depth", "version"), out, batch_id)
        finally:
            models.unpersist()

    return contexts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bandit_stream(contexts: DataFrame, learner: AdaptiveLearner, reward: Column, checkpoint: str) -> StreamingQuery:
    """Decides each batch of (row_id, round, x, ...), takes the reward that an expression gives for the
    chosen `arm`, and learns from it; decisions are appended under the learner's folder."""

    def batch(df: DataFrame, batch_id: int) -> None:
        state, coded = learner.state(df.sparkSession, batch_id), learner.encode(df).persist()
        models = learner.models(df.sparkSession, state, learner.cells(coded, learner.levels)).persist()
        decided = learner.decide(coded, state, models).withColumn("reward", reward).persist()
        try:
            append_checkpoints(decided.select("row_id", "round", "arm", "reward", "depth"), f"{learner.folder}/decisions", batch_id)
            learner.learn(decided, batch_id, models)
        finally:
            for held in (decided, models, coded):
                held.unpersist()

    return contexts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(rewards: DataFrame, by: tuple[str, ...], ledger: Ledger, checkpoint: str) -> StreamingQuery:
    """Running counters in update mode: Spark's state store holds one row a key, each batch sends the
    totals of the keys it changed, and the keyed table takes those of the highest batch. A batch that is
    replayed overwrites its own rows, so nothing passes through the driver or is counted twice."""
    from arbora.streaming.micro import running_counters

    return running_counters(rewards, by).writeStream.outputMode("update").foreachBatch(lambda df, batch_id: ledger.append(df, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters_ledger(folder: str, by: str = "level int, code int, arm int", every: int = 8) -> Ledger:
    """The keyed table of `upsert_stream`."""
    keys = tuple(k.split()[0] for k in by.split(","))
    return Ledger(folder, f"{by}, n long, s double, ss double", keys, "last", every)
