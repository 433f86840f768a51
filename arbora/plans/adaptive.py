"""Queries of streams that decide, learn and deepen, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import noise
from arbora.functions.lineage import durable
from arbora.operators import diagnose, posterior, prepare, quantize
from arbora.plans import inputs
from arbora.plans.catalogue import _CODED_LOG, _LINEAR_SUMS, _ORDER_LOG, BATCHES, _batch_files, _coded_log, _diag_sql, _folded_sql, _linear_sql, _order_log, _order_stream, _scratch, _stream, _with_batch, query, r6, s6
from arbora.plans.inputs import EMB, LEVELS, NBITS, book_sql
from arbora.streaming import adaptive

#: Levels, arms and batches of the adaptive runs.
DEEP, FEW, PARTS = 3, 3, 5
_ALPHA, _SEED = 0.9, 6


def _deep_label(codes: Column) -> Column:
    """A class that the second level's code tells in part and the third's in full."""
    at = lambda i: F.get(codes, F.lit(i))
    return F.when(at(2) % 2 == 0, F.lit(2)).otherwise(at(1) % 2)


_LABEL = "CASE WHEN codes[3] % 2 = 0 THEN 2 ELSE codes[2] % 2 END"


def _adaptive_sql() -> str:
    """CTEs x<b> (decisions of batch b), d<b> (depth at its start) and k<b> (counters at its start)."""
    out = [
        f"lab AS (SELECT row_id, codes, {_LABEL} AS lab FROM coded)",
        f"rn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {noise.uniform_sql('row_id', 2)}, row_id) AS round, (SELECT count(*) FROM lab) AS total FROM lab)",
        f"rb AS MATERIALIZED (SELECT *, (SELECT min(b) FROM (SELECT unnest(range({PARTS})) AS b) WHERE round <= (b + 1) * total // {PARTS}) AS batch FROM rn)",
        f"ar AS (SELECT unnest(range({FEW}))::INT AS arm), lv AS (SELECT unnest(range({DEEP}))::INT AS level)",
        "k0 AS (SELECT 0 AS level, 0 AS code, 0 AS arm, 0 AS n, 0.0::DOUBLE AS f, 0.0::DOUBLE AS theta WHERE false)",
        "d0 AS (SELECT 1 AS depth)",
    ]
    for b in range(PARTS):
        draw = f"0.1 * sqrt(1 / (coalesce(k.n, 0) + 1.0)) * {noise.normal_sql('row_id', 'ar.arm', 'l.level', _SEED)}"
        out.append(f"s{b} AS (SELECT row_id, ar.arm, sum(0.5 ** l.level * (coalesce(k.theta, 0) + {draw})) AS score FROM rb CROSS JOIN ar CROSS JOIN (SELECT level FROM lv, d{b} WHERE level < depth) l LEFT JOIN k{b} k ON k.level = l.level AND k.code = codes[l.level + 1] AND k.arm = ar.arm WHERE batch = {b} GROUP BY 1, 2)")
        out.append(f"c{b} AS MATERIALIZED (SELECT row_id, (-(max(struct_pack(s := score, a := -arm)).a))::INT AS arm FROM s{b} GROUP BY row_id)")
        looks = " ".join(f"LEFT JOIN k{b} t{i} ON t{i}.level = {i} AND t{i}.code = codes[{i + 1}] AND t{i}.arm = c.arm" for i in range(DEEP))
        sums = [" + ".join(f"{0.5**i} * coalesce(t{i}.theta, 0)" for i in range(j + 1)) for j in range(DEEP)]
        out.append(f"x{b} AS MATERIALIZED (SELECT r.row_id, round, total, codes, c.arm, (c.arm = lab)::INT::DOUBLE AS reward, depth, [{', '.join(sums)}] AS preds FROM rb r JOIN c{b} c USING (row_id) CROSS JOIN d{b} {looks} WHERE batch = {b})")
        error = lambda at: f"(reward - least(greatest(preds[{at}] + 0.5, 0), 1)) ** 2"
        out.append(f"wd{b} AS MATERIALIZED (SELECT round, {error('depth')} - {error(f'least(depth + 1, {DEEP})')} AS d FROM x{b} WHERE round > (SELECT max(round) FROM x{b}) - total // {PARTS})")
        won = f"coalesce(sum(d) > 0 AND -(sum(d) * sum(d)) / (2 * var_pop(d) * count(*) + 2 * max(abs(d)) * sum(d) / 3) < ln({_ALPHA}), false)"
        out.append(f"d{b + 1} AS MATERIALIZED (SELECT depth + (depth < {DEEP} AND (SELECT {won} FROM wd{b}))::INT AS depth FROM d{b})")
        new = f"SELECT level, codes[level + 1] AS code, arm, count(*) AS n, sum(reward - CASE WHEN level = 0 THEN 0.5 ELSE least(greatest(preds[level] + 0.5, 0), 1) END) AS f FROM x{b}, lv WHERE level < least(depth + 1, {DEEP}) GROUP BY 1, 2, 3"
        out.append(f"k{b + 1} AS MATERIALIZED (SELECT level, code, arm, sum(n) AS n, sum(f) AS f, sum(f) / (sum(n) + 1) AS theta FROM (SELECT level, code, arm, n, f FROM k{b} UNION ALL {new}) GROUP BY 1, 2, 3)")
    return ", ".join(out)


_ADAPTIVE = f"WITH {EMB}, {book_sql(DEEP)}, {_adaptive_sql()}"


def _adaptive_run(spark: SparkSession, sf_dir: str) -> adaptive.AdaptiveLearner:
    """Five batches of all embeddings in keyed order: decided, rewarded where the arm is the class that
    their codes give, learnt from, and tested at the end of each batch."""
    contexts = durable(inputs.embeddings(spark, sf_dir).select("row_id", "x"))
    book = inputs.codebook(contexts, DEEP)
    labelled = quantize.encode(contexts, book).select("row_id", "x", _deep_label(F.col("codes")).alias("label"))
    log = durable(prepare.shuffle_rounds(labelled, 2).select("row_id", "round", "x", "label"))
    n = log.count()
    ends = [(b + 1) * n // PARTS for b in range(PARTS)]
    batch = sum(((F.col("round") > e).cast("int") for e in ends[:-1]), F.lit(0))
    folder = _scratch(spark, "adaptive")
    learner = adaptive.AdaptiveLearner("counter", book, folder, FEW, tuple((e, _ALPHA) for e in ends), n // PARTS, seed=_SEED, test="freedman", compact_every=2)
    adaptive.bandit_stream(_stream(spark, log.withColumn("batch", batch)), learner, (F.col("arm") == F.col("label")).cast("double"), f"{folder}/checkpoint").awaitTermination()
    return learner


@query(f"{_ADAPTIVE} " + " UNION ALL ".join(f"SELECT row_id, {b}::BIGINT AS batch_id, depth, arm FROM x{b}" for b in range(PARTS)))
def r1_adaptive_stream(spark, sf_dir):
    """Decisions of a stream that deepens: each batch is decided at the depth that earlier ones reached."""
    learner = _adaptive_run(spark, sf_dir)
    found = adaptive.read_batches(spark, f"{learner.folder}/decisions", "row_id long, round long, arm int, reward double, depth int")
    return found.select("row_id", "batch_id", "depth", "arm")


@query(f"{_ADAPTIVE} SELECT level, code, arm, n::BIGINT AS n, {s6('f')} AS f FROM k{PARTS}")
def r3_shadow_training(spark, sf_dir):
    """Counters after the run: levels below the shadow are trained from their turn on."""
    return _adaptive_run(spark, sf_dir).ledger.read(spark).select("level", "code", "arm", "n", r6("f").alias("f"))


@query(f"{_ADAPTIVE} " + " UNION ALL ".join(f"SELECT {b}::BIGINT AS batch_id, (SELECT max(round) FROM x{b}) AS t, d{b}.depth AS old_depth, d{b + 1}.depth AS new_depth FROM d{b}, d{b + 1} WHERE d{b}.depth < d{b + 1}.depth" for b in range(PARTS)))
def r3_promotions(spark, sf_dir):
    """The promotions of the run."""
    return _adaptive_run(spark, sf_dir).promotions(spark)


def _errors(predicted: DataFrame) -> DataFrame:
    return diagnose.depth_errors(predicted, 1, LEVELS, "row_id").select("row_id", r6("sq_err_active").alias("sq_err_active"), r6("sq_err_shadow").alias("sq_err_shadow"))


_SQUARED = "SELECT row_id, {} AS sq_err_active, {} AS sq_err_shadow FROM l1 a JOIN (SELECT row_id, p AS p2 FROM l2) b USING (row_id)".format(*(s6(f"(reward - least(greatest({p} + 0.5, 0), 1)) ** 2") for p in ("p", "p2")))


@query(f"{_CODED_LOG}, {_diag_sql()} {_SQUARED}")
def d10_squared_errors_diag(spark, sf_dir):
    """Errors of the chosen arm by diagonal models of 65 weights a cell, at one level and at all."""
    log = _coded_log(spark, sf_dir)
    fitted = durable(posterior.levelwise_diag_fit(log, LEVELS, inputs.ARMS, NBITS))
    return _errors(diagnose.chosen_predictions(log, diagnose.weights("diag", fitted), LEVELS))


@query(f"{_ORDER_LOG}, {_linear_sql()} {_SQUARED}")
def d10_squared_errors_linear(spark, sf_dir):
    """The same by full models, over the orders."""
    log = _order_log(spark, sf_dir)
    fitted = durable(posterior.levelwise_linear_fit(log, LEVELS, 5, NBITS))
    return _errors(diagnose.chosen_predictions(log, diagnose.weights("linear", fitted), LEVELS))


def _ledger_run(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The orders' log learnt in batches at full depth; the table is a ledger, compacted every second batch."""
    contexts = durable(inputs.orders(spark, sf_dir))
    book, folder = inputs.codebook(contexts), _scratch(spark, "ledger")
    learner = adaptive.AdaptiveLearner(kind, book, folder, 5, min_level=LEVELS, compact_every=2)
    log = inputs.logged(contexts, 5).withColumn("round", F.col("row_id")).select("row_id", "round", "x", "arm", "reward")
    adaptive.learn_stream(_stream(spark, _with_batch(log)), learner, f"{folder}/checkpoint").awaitTermination()
    return learner.ledger.read(spark)


@query(f"{_ORDER_LOG}, {_folded_sql('linear')} " + " UNION ALL ".join(f"SELECT level, code, arm, {i} AS i, {j} AS j, round({c}::DOUBLE, 4) + 0.0 AS v, n::BIGINT AS n FROM b{BATCHES}" for c, (i, j) in {**_LINEAR_SUMS, 'n': (2, 2)}.items()))
def r2_ledger_linear(spark, sf_dir):
    return _ledger_run(spark, sf_dir, "linear").select("level", "code", "arm", "i", "j", (F.round("v", 4) + 0.0).alias("v"), "n")


@query(f"{_ORDER_LOG}, {_folded_sql('diag')} " + " UNION ALL ".join(f"SELECT level, code, arm, {i} AS i, n::BIGINT AS n, round({q}::DOUBLE, 4) + 0.0 AS q, round({f}::DOUBLE, 4) + 0.0 AS f FROM b{BATCHES}" for i, q, f in ((0, "a", "g"), (1, "d", "h"), (2, "n", "i"))))
def r2_ledger_diag(spark, sf_dir):
    return _ledger_run(spark, sf_dir, "diag").select("level", "code", "arm", "i", "n", (F.round("q", 4) + 0.0).alias("q"), (F.round("f", 4) + 0.0).alias("f"))


@query(f"{_CODED_LOG} SELECT level, codes[level + 1] AS code, arm, count(*) AS n, {s6('sum(reward)')} AS s, {s6('sum(reward * reward)')} AS ss FROM log, (SELECT unnest(range({LEVELS}))::INT AS level) GROUP BY 1, 2, 3")
def r4_running_code_counters(spark, sf_dir):
    """Counters by (level, code, arm) in update mode; the stream is stopped after its first batch and goes
    on from its checkpoint."""
    log = _with_batch(_coded_log(spark, sf_dir).select("arm", "reward", F.posexplode("codes").alias("level", "code"), "row_id"))
    files = _batch_files(log)[1]
    folder = _scratch(spark, "r4")
    path, ledger = f"{folder}/in", adaptive.counters_ledger(f"{folder}/table", every=2)
    for b in range(BATCHES):
        log.where(F.col("batch") == b).drop("batch", "row_id").repartition(files).write.mode("append").parquet(path)
        rows = spark.readStream.schema(log.drop("batch", "row_id").schema).option("maxFilesPerTrigger", files).parquet(path)
        if b != 1:  # the second batch waits for the third, so that one start has several batches
            adaptive.upsert_stream(rows, ("level", "code", "arm"), ledger, f"{folder}/checkpoint").awaitTermination()
    return ledger.read(spark).select("level", "code", "arm", "n", r6("s").alias("s"), r6("ss").alias("ss"))
