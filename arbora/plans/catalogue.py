"""Registered queries of the bandit operators and their DuckDB twins.

Every query runs over its whole table. Doubles are rounded to six places on both sides, as the
order of summation differs.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import noise, vectors
from arbora.functions.lineage import durable, shared_folder
from arbora.operators import decisions, diagnose, models, posterior, prepare, quantize, score
from arbora.plans import inputs
from arbora.plans.inputs import ARMS, EMB, EVT, ITERATIONS, LEVELS, LIN, NBITS, ORD, additive_sql, book_sql, encode_sql, log_sql
from arbora.sources import results, tables
from arbora.sources.text import read_counted_text
from arbora.streaming import micro

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    """Six places; negative zero counts as zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def _vector(c: Column | str, name: str) -> Column:
    """A vector as text of rounded numbers, which both engines print alike after scaling."""
    v = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(v, lambda x: F.round(x * 1e4).cast("bigint").cast("string")), ",").alias(name)


def _vector_sql(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda q: round(q * 1e4)::BIGINT::VARCHAR), ',')"


# ----------------------------------------------------------------- flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward error of a one-level codebook of 16 codes: read, standardise, train, encode, fit, judge."""
    contexts = durable(prepare.standardize(inputs.embeddings(spark, sf_dir)))
    book = quantize.train_codebook(contexts, 1, 4, 5)
    coded = durable(quantize.encode(contexts, book).select("row_id", "label", "codes"))
    means = models.fit_boosted_centroids(coded, ARMS, 1, 4)
    return diagnose.delta_boosted(coded, means, 1, ARMS).select("depth", r6("mae").alias("mae"), r6("mae_smoothed").alias("mae_smoothed"))


STD = "mom AS MATERIALIZED (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-8 THEN 1.0 ELSE stddev_pop(v) END AS s FROM (SELECT generate_subscripts(x, 1) AS i, unnest(x) AS v FROM {src}) GROUP BY i), {dst} AS MATERIALIZED (SELECT row_id, label, list((v - m) / s ORDER BY i) AS x FROM (SELECT row_id, label, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM {src}) JOIN mom USING (i) GROUP BY row_id, label)"
_EMB0 = EMB.replace("ctx AS", "raw AS")


def _boosted_sql(depth: int, nbits: int, arms: int = ARMS, eta: float = 0.5) -> str:
    """CTEs m<l> (code, arm, mean, smoothed) on `coded`."""
    out = [f"arms AS (SELECT unnest(range({arms}))::INT AS arm)", "p0 AS MATERIALIZED (SELECT row_id, label, codes, arm, 0.0::DOUBLE AS p FROM coded, arms)"]
    for level in range(depth):
        residual = "(label = arm)::INT - least(greatest(p, 0), 1)"
        out.append(f"m{level} AS MATERIALIZED (SELECT codes[{level + 1}] AS code, arm, sum({residual}) / count(*) AS mean, (sum({residual}) + 1.0 / {arms}) / (count(*) + 1) AS smoothed FROM p{level} GROUP BY 1, 2)")
        out.append(f"p{level + 1} AS MATERIALIZED (SELECT row_id, label, codes, t.arm, p + {eta**level} * mean AS p FROM p{level} t JOIN m{level} m ON m.code = codes[{level + 1}] AND m.arm = t.arm)")
    return ", ".join(out)


@query(
    f"WITH {_EMB0}, {STD.format(src='raw', dst='ctx')}, {book_sql(1, 4, 5)}, {_boosted_sql(1, 4)}, q AS (SELECT row_id, label, codes, t.arm, smoothed AS p FROM p0 t JOIN m0 m ON m.code = codes[1] AND m.arm = t.arm) "
    f"SELECT 1 AS depth, (SELECT {s6('avg(abs((label = arm)::INT - least(greatest(p, 0), 1)))')} FROM p1) AS mae, (SELECT {s6('avg(abs((label = arm)::INT - least(greatest(p, 0), 1)))')} FROM q) AS mae_smoothed"
)
def delta_by_depth(spark, sf_dir):
    return flagship(spark, sf_dir)


# ------------------------------------------------------- sources and sinks


def _scratch(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, name)


@query("SELECT vec_id AS row_id, label, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) + 0.0 AS total FROM embeddings")
def s1_read_contexts(spark, sf_dir):
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return inputs.embeddings(spark, sf_dir).select("row_id", "label", F.size("x").alias("width"), (F.round(total, 4) + 0.0).alias("total"))


#: Lines of one part of a counted text, about.
PART_LINES = 1_000_000


@query("SELECT (l_returnflag = 'N')::INT AS label, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def s2_read_counted_text(spark, sf_dir):
    """All of lineitem written as counted text, flag N as the signal, and read back. Rows are parted by
    label and place, so that neither label's are sorted in one task."""
    li = inputs.lineitem(spark, sf_dir).withColumn("label", (F.col("label") == 1).cast("int"))
    n0, n1 = li.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    line = F.array_join(F.transform("x", lambda v: v.cast("string")), " ")
    head = spark.createDataFrame([(2, f" {n1} {n0}")], "label int, value string")
    path = _scratch(spark, "counted")
    lines = head.unionByName(li.select("label", line.alias("value"))).withColumn("place", F.monotonically_increasing_id())
    order = [F.desc("label"), F.col("place")]
    lines.repartitionByRange(1 + (n0 + n1) // PART_LINES, *order).sortWithinPartitions(*order).select("value").write.text(f"{path}/parts")
    return read_counted_text(spark, f"{path}/parts").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.get("x", F.lit(0))), 2).alias("quantity"))


@query("SELECT 'train' AS split, vec_id AS row_id, label FROM embeddings WHERE vec_id % 5 < 3 UNION ALL SELECT 'val', vec_id, NULL FROM embeddings WHERE vec_id % 5 = 3 UNION ALL SELECT 'test', vec_id, label FROM embeddings WHERE vec_id % 5 = 4")
def s3_union_splits(spark, sf_dir):
    e = inputs.embeddings(spark, sf_dir).select("row_id", "label")
    part = F.col("row_id") % 5
    return tables.union_splits({"train": e.where(part < 3), "val": e.where(part == 3).drop("label"), "test": e.where(part == 4), "extra": None}).select("split", "row_id", "label")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def s4_write_results(spark, sf_dir):
    path = _scratch(spark, "results")
    results.write_results(inputs.embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")), path, ["label", "n"], ["label"], "csv")
    return results.read_results(spark, path, "label int, n long", "csv")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT o_orderstatus_rank, n FROM (SELECT 100 + (ascii(o_orderstatus))::INT AS o_orderstatus_rank, count(*) AS n FROM orders GROUP BY 1)")
def s5_append_results(spark, sf_dir):
    first = inputs.embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    path = _scratch(spark, "results")
    results.write_results(first, path, ["label", "n"])
    more = inputs.table(spark, sf_dir, "orders").groupBy((100 + F.ascii("o_orderstatus")).alias("label")).agg(F.count("*").alias("n"))
    return results.append_results(results.read_results(spark, path, "label int, n long"), more)


@query("SELECT (event_id % 3)::BIGINT AS batch_id, count(*) AS n FROM events GROUP BY 1")
def s6_append_checkpoints(spark, sf_dir):
    path = _scratch(spark, "checkpoints")
    e = inputs.table(spark, sf_dir, "events")
    for batch in (0, 1, 2, 1):  # batch 1 is replayed
        results.append_checkpoints(e.where(F.col("event_id") % 3 == batch).select("event_id"), path, batch)
    return spark.read.schema("event_id long, batch_id long").parquet(path).groupBy("batch_id").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n, count(*) AS again FROM embeddings GROUP BY label")
def s7_cached_contexts(spark, sf_dir):
    kept = tables.cached_contexts(inputs.embeddings(spark, sf_dir))
    return kept.groupBy("label").agg(F.count("*").alias("n")).join(kept.groupBy("label").agg(F.count("x").alias("again")), "label")


# ------------------------------------------------------ feature preparation


def _standardized(guard: str) -> str:
    s = "CASE WHEN stddev_pop(v) < 1e-8 THEN 1.0 ELSE stddev_pop(v) END" if guard == "unit" else "stddev_pop(v) + 1e-8"
    return f"WITH {ORD}, mom AS (SELECT i, avg(v) AS m, {s} AS s FROM (SELECT generate_subscripts(x, 1) AS i, unnest(x) AS v FROM ctx) GROUP BY i) SELECT row_id, {s6('max((v - m) / s) FILTER (i = 1)')} AS z0, {s6('max((v - m) / s) FILTER (i = 2)')} AS z1 FROM (SELECT row_id, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM ctx) JOIN mom USING (i) GROUP BY row_id"


def _two(df: DataFrame) -> DataFrame:
    return df.select("row_id", r6(F.get("x", F.lit(0))).alias("z0"), r6(F.get("x", F.lit(1))).alias("z1"))


@query(_standardized("unit"))
def p1_standardize(spark, sf_dir):
    return _two(prepare.standardize(inputs.orders(spark, sf_dir)))


@query(_standardized("eps"))
def p2_standardize_eps(spark, sf_dir):
    return _two(prepare.standardize(inputs.orders(spark, sf_dir), "eps"))


@query("SELECT o_orderkey AS row_id, (CASE o_orderstatus WHEN 'O' THEN '1' ELSE '0' END) || ',' || array_to_string(list_transform(range(5), lambda i: (i = substr(o_orderpriority, 1, 1)::INT - 1)::INT::VARCHAR), ',') AS code FROM orders")
def p3_one_hot(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "O").cast("int").alias("open"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"))
    return prepare.one_hot_categories(o, ["open", "priority"]).select("row_id", F.array_join(F.transform("encoded", lambda v: v.cast("int").cast("string")), ",").alias("code"))


@query("SELECT vec_id AS row_id, len(embedding)::INT + 1 AS width, 1.0::DOUBLE AS last FROM embeddings")
def p4_add_intercept(spark, sf_dir):
    z = vectors.add_intercept(F.col("x"))
    return inputs.embeddings(spark, sf_dir).select("row_id", F.size(z).alias("width"), F.element_at(z, -1).alias("last"))


@query(f"SELECT vec_id AS row_id, array_to_string(list_transform(range({ARMS}), lambda i: (i = label)::INT::VARCHAR), '') AS code FROM embeddings")
def p5_one_hot_label(spark, sf_dir):
    return inputs.embeddings(spark, sf_dir).select("row_id", F.array_join(F.transform(vectors.one_hot(F.col("label"), ARMS), lambda v: v.cast("int").cast("string")), "").alias("code"))


@query(f"WITH {ORD} SELECT row_id, round(x[1] * 1e5, 2) AS first, array_to_string(list_transform(range(5), lambda i: (i = label)::INT::VARCHAR), '') AS tail FROM ctx")
def p6_context_arm_features(spark, sf_dir):
    z = vectors.context_arm_features(F.col("x"), F.col("label"), 5)
    return inputs.orders(spark, sf_dir).select("row_id", F.round(F.get(z, F.lit(0)) * 1e5, 2).alias("first"), F.array_join(F.transform(F.slice(z, 3, 5), lambda v: v.cast("int").cast("string")), "").alias("tail"))


@query(f"SELECT vec_id AS row_id, unnest(range({ARMS}))::INT AS arm, label FROM embeddings")
def p7_expand_arms(spark, sf_dir):
    return prepare.expand_arms(inputs.embeddings(spark, sf_dir).select("row_id", "label"), ARMS).select("row_id", "arm", "label")


@query(f"WITH {ORD}, u AS (SELECT row_id, {noise.uniform_sql('row_id', 3)} AS u FROM ctx) SELECT row_id, row_number() OVER (ORDER BY u, row_id) <= least(1000, (SELECT count(*) // 2 FROM u)) AS holdout FROM u")
def p8_split_holdout(spark, sf_dir):
    return prepare.split_holdout(inputs.orders(spark, sf_dir), 1000, 3).select("row_id", "holdout")


@query(f"WITH {ORD}, u AS (SELECT row_id, {noise.uniform_sql('row_id', 4)} AS u FROM ctx) SELECT row_id, row_number() OVER (ORDER BY u, row_id) AS round FROM u")
def p9_shuffle_rounds(spark, sf_dir):
    return prepare.shuffle_rounds(inputs.orders(spark, sf_dir), 4).select("row_id", "round")


@query(f"WITH {ORD}, u AS (SELECT row_id, {noise.uniform_sql('row_id', 4)} AS u FROM ctx) SELECT row_id, round FROM (SELECT row_id, row_number() OVER (ORDER BY u, row_id) AS round FROM u) WHERE round <= 500")
def p10_cap_rounds(spark, sf_dir):
    return prepare.cap_rounds(prepare.shuffle_rounds(inputs.orders(spark, sf_dir), 4), 500).select("row_id", "round")


def _pca_sql(k: int, holdout: int, seed: int, squarings: int = 14) -> str:
    """Components one after another: the covariance is squared until only its leading direction is left,
    which is then taken out of it."""
    out = [
        f"{EMB}, sp AS MATERIALIZED (SELECT row_id, x, row_number() OVER (ORDER BY {noise.uniform_sql('row_id', seed)}, row_id) <= least({holdout}, (SELECT count(*) FROM ctx) // 2) AS holdout FROM ctx)",
        "e AS MATERIALIZED (SELECT row_id, holdout, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM sp)",
        "m AS MATERIALIZED (SELECT i, avg(v) AS m FROM e WHERE holdout GROUP BY i)",
        "z AS MATERIALIZED (SELECT row_id, holdout, i, v - m AS v FROM e JOIN m USING (i))",
        "q0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / ((SELECT count(*) FROM sp WHERE holdout) - 1) AS v FROM z a JOIN z b USING (row_id) WHERE a.holdout GROUP BY 1, 2)",
    ]
    for c in range(k):
        out.append(f"s{c}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{c} WHERE i = j) AS v FROM q{c})")
        for t in range(squarings):
            out.append(f"y{c}_{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM s{c}_{t} a JOIN s{c}_{t} b ON a.j = b.i GROUP BY 1, 2)")
            out.append(f"s{c}_{t + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM y{c}_{t} WHERE i = j) AS v FROM y{c}_{t})")
        last = f"s{c}_{squarings}"
        out.append(f"d{c} AS MATERIALIZED (SELECT i, v / sqrt((SELECT max(v) FROM {last} WHERE i = j)) AS w FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j))")
        out.append(f"g{c} AS MATERIALIZED (SELECT sum(v * a.w * b.w) AS g FROM q{c} JOIN d{c} a USING (i) JOIN d{c} b ON b.i = q{c}.j)")
        out.append(f"q{c + 1} AS MATERIALIZED (SELECT q{c}.i, q{c}.j, v - (SELECT g FROM g{c}) * a.w * b.w AS v FROM q{c} JOIN d{c} a USING (i) JOIN d{c} b ON b.i = q{c}.j)")
    each = " UNION ALL ".join(f"SELECT row_id, {c} AS c, abs(sum(v * w)) AS p FROM z JOIN d{c} USING (i) GROUP BY row_id" for c in range(k))
    share = " + ".join(f"(SELECT g FROM g{c})" for c in range(k))
    return f"WITH {', '.join(out)} SELECT row_id, string_agg(round(p * 1e3)::BIGINT::VARCHAR, ',' ORDER BY c) AS pc, round(({share}) / (SELECT sum(v) FROM q0 WHERE i = j), 6) AS explained FROM ({each}) GROUP BY row_id"


@query(_pca_sql(8, 200, 5))
def p11_pca(spark, sf_dir):
    """Eight components; their signs are free, so sizes are compared."""
    e = prepare.split_holdout(inputs.embeddings(spark, sf_dir), 200, 5)
    out, share = prepare.pca_fit_transform(e.where("holdout"), e, 8)
    sizes = F.transform("pc", lambda v: F.round(F.abs(v) * 1e3).cast("bigint").cast("string"))
    return out.select("row_id", F.array_join(sizes, ",").alias("pc"), F.lit(round(share, 6)).alias("explained"))


@query(f"WITH {EVT} SELECT row_id, {s6('least(greatest(reward - 0.75 + 0.5, 0), 1)')} AS s, {s6('least(greatest(reward - 0.75, 0), 1)')} AS c FROM evt")
def p12_sigmoid_clip(spark, sf_dir):
    z = F.col("reward") - 0.75
    return inputs.events(spark, sf_dir).select("row_id", r6(vectors.sigmoid_clip(z)).alias("s"), r6(vectors.clip01(z)).alias("c"))


@query(f"WITH {EMB}, {log_sql()} SELECT row_id, arm, reward, 1 - reward AS regret FROM log")
def p13_reward_from_label(spark, sf_dir):
    log = inputs.logged(inputs.embeddings(spark, sf_dir))
    reward = vectors.reward_from_label(F.col("arm"), F.col("label"))
    return log.select("row_id", "arm", reward.alias("reward"), (1 - reward).alias("regret"))


_W = [[0.3, -0.2], [-0.1, 0.25], [0.05, 0.05]]


@query(f"WITH {ORD}, s AS (SELECT row_id, unnest([{', '.join(f'struct_pack(s := {a} * x[1] + {b} * x[2], a := -{i})' for i, (a, b) in enumerate(_W))}]) AS v FROM ctx) SELECT row_id, (-(max(v).a))::INT AS label FROM s GROUP BY row_id")
def p14_label_by_linear_argmax(spark, sf_dir):
    return prepare.label_by_linear_argmax(inputs.orders(spark, sf_dir), _W).select("row_id", "label")


@query(f"WITH {ORD} SELECT row_id, [0, 1, 2, 1, 3, 0, 2, 4][4 * (x[1] > 1.0)::INT + 2 * (x[2] > 0.5)::INT + (x[1] > 2.0)::INT + 1] AS label FROM ctx")
def p15_label_by_tree(spark, sf_dir):
    return prepare.label_by_tree(inputs.orders(spark, sf_dir), [(0, 1.0), (1, 0.5), (0, 2.0)], [0, 1, 2, 1, 3, 0, 2, 4]).select("row_id", "label")


@query(f"WITH {ORD} SELECT row_id, CASE WHEN {noise.uniform_sql('row_id', 6, 3)} < 0.1 THEN floor({noise.uniform_sql('row_id', 6, 7)} * 5)::INT ELSE label END AS label FROM ctx")
def p16_inject_label_noise(spark, sf_dir):
    return prepare.inject_label_noise(inputs.orders(spark, sf_dir), 0.1, 5, 6).select("row_id", "label")


@query(f"WITH {ORD}, r AS (SELECT row_id, (row_id % 5)::INT AS label FROM ctx) SELECT row_id, label, " + ", ".join(s6(f"{noise.normal_sql('row_id', 11, j)} + 3.0 * {noise.normal_sql('label', 12, j)}") + f" AS x{j}" for j in range(3)) + " FROM r")
def p17_synthetic_contexts(spark, sf_dir):
    """Load-test points, one for every order."""
    points = prepare.cluster_points(inputs.orders(spark, sf_dir).select("row_id"), 3, 5, 11)
    return points.select("row_id", "label", *[r6(F.get("x", F.lit(j))).alias(f"x{j}") for j in range(3)])


# ------------------------------------------------------------- quantisation


@query(f"WITH {EMB}, {book_sql()} SELECT level, code, {_vector_sql('c')} AS centroid FROM book")
def q1_train_codebook(spark, sf_dir):
    book = inputs.codebook(durable(inputs.embeddings(spark, sf_dir)))
    return quantize.codebook_table(spark, book).select("level", "code", _vector("centroid", "centroid"))


@query(f"WITH {EMB}, {book_sql()} SELECT row_id, codes[1] AS code0, codes[2] AS code1 FROM coded")
def q2_encode(spark, sf_dir):
    return inputs.encoded(durable(inputs.embeddings(spark, sf_dir)), False).select("row_id", F.get("codes", F.lit(0)).alias("code0"), F.get("codes", F.lit(1)).alias("code1"))


@query("SELECT vec_id AS row_id, (vec_id % 4)::INT AS a, (vec_id // 4 % 4)::INT AS b FROM embeddings")
def q3_unpack_codes(spark, sf_dir):
    packed = vectors.unpack_codes((F.col("row_id") % 16).cast("bigint"), 2, 2)
    return inputs.embeddings(spark, sf_dir).select("row_id", F.get(packed, F.lit(0)).alias("a"), F.get(packed, F.lit(1)).alias("b"))


@query(f"WITH {EMB}, {book_sql()} SELECT row_id, codes[1]::BIGINT + 4 * codes[2] AS packed FROM coded")
def q4_pack_codes(spark, sf_dir):
    return inputs.encoded(durable(inputs.embeddings(spark, sf_dir)), False).select("row_id", vectors.pack_codes(F.col("codes"), NBITS).alias("packed"))


@query(f"WITH {EMB}, {book_sql()} SELECT row_id, unnest([0, 1]) AS level, {_vector_sql('unnest(residuals)')} AS r FROM coded")
def q5_residual_features(spark, sf_dir):
    e = durable(inputs.embeddings(spark, sf_dir))
    book = inputs.codebook(e)
    coded = quantize.encode(e, book)
    return quantize.residual_features(coded, quantize.codebook_table(spark, book)).select("row_id", "level", _vector("r", "r"))


@query(f"WITH {EMB}, {book_sql()} SELECT 0 AS level, codes[1] AS code, label, count(*) AS n FROM coded GROUP BY ALL UNION ALL SELECT 1, codes[2], label, count(*) FROM coded GROUP BY ALL")
def q6_code_histogram(spark, sf_dir):
    return quantize.code_histogram(inputs.encoded(durable(inputs.embeddings(spark, sf_dir)), False), ["label"]).select("level", "code", "label", "n")


@query(f"WITH {ORD}, {book_sql(4, 4, 3)} SELECT row_id, codes[1] + 16 * codes[2] + 256 * codes[3] + 4096 * codes[4] AS packed FROM coded")
def q2_encode_deep(spark, sf_dir):
    """Four levels of 16 codes, packed."""
    contexts = durable(inputs.orders(spark, sf_dir))
    return quantize.encode(contexts, inputs.codebook(contexts, 4, 4, 3)).select("row_id", vectors.pack_codes(F.col("codes"), 4).alias("packed"))


# --------------------------------------------------------------- posteriors


def _nig_sql(rows: str, arms: int = 6) -> str:
    n, s = "coalesce(n, 0)", "coalesce(s, 0)"
    return f"WITH {EVT}, st AS (SELECT arm, count(*)::DOUBLE AS n, sum(reward) AS s, var_pop(reward) * count(*) AS ss FROM {rows} GROUP BY arm), ar AS (SELECT unnest(range({arms}))::INT AS arm) SELECT arm, {s6(f'{s} / (1 + {n})')} AS mu, 1 + {n} AS lam, 1 + {n} / 2 AS alpha, {s6(f'1 + coalesce(ss, 0) / 2 + CASE WHEN {n} > 0 THEN (s / n) ** 2 * n / (1 + n) / 2 ELSE 0 END')} AS beta FROM ar LEFT JOIN st USING (arm)"


def _nig_out(p: DataFrame) -> DataFrame:
    return p.select("arm", r6("mu").alias("mu"), "lam", "alpha", r6("beta").alias("beta"))


@query(_nig_sql("evt"))
def a1_nig_posterior(spark, sf_dir):
    return _nig_out(posterior.nig_posterior(inputs.events(spark, sf_dir), 6))


@query(_nig_sql("evt"))
def a2_nig_merge(spark, sf_dir):
    e = inputs.events(spark, sf_dir)
    p = posterior.nig_posterior(e.where("row_id % 3 = 0"), 6)
    return _nig_out(posterior.nig_merge(posterior.nig_merge(p, e.where("row_id % 3 = 1")), e.where("row_id % 3 = 2")))


@query(f"WITH {EVT} SELECT arm, {s6('sum(reward) / (1 + count(*))')} AS mean, count(*)::DOUBLE AS n_eff FROM evt GROUP BY arm")
def a3_nig_summary(spark, sf_dir):
    return posterior.nig_summary(posterior.nig_posterior(inputs.events(spark, sf_dir), 5)).select("arm", r6("mean").alias("mean"), "n_eff")


@query(f"WITH {EMB}, {log_sql()}, o AS (SELECT row_id, arm, reward, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM log), g AS (SELECT a.arm, a.i, b.i AS j, sum(a.v * b.v) AS v FROM o a JOIN o b ON a.row_id = b.row_id AND a.i <= b.i GROUP BY 1, 2, 3 UNION ALL SELECT arm, i, -1, sum(reward * v) FROM o GROUP BY 1, 2) SELECT arm, i::INT AS i, j::INT AS j, {s6('v')} AS v FROM g")
def a4_linear_posterior(spark, sf_dir):
    return posterior.gram(inputs.logged(inputs.embeddings(spark, sf_dir)), ["arm"]).select("arm", "i", "j", r6("v").alias("v"))


@query(f"WITH {EMB}, {log_sql()}, o AS (SELECT arm, reward, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM log) SELECT arm, i::INT AS i, {s6('1 + sum(v * v)')} AS prec, {s6('sum(reward * v)')} AS f FROM o GROUP BY arm, i")
def a5_diag_posterior(spark, sf_dir):
    p = posterior.diag_posterior(inputs.logged(inputs.embeddings(spark, sf_dir)))
    return p.select("arm", F.posexplode(F.arrays_zip("prec", "f")).alias("i", "z")).select("arm", "i", r6("z.prec").alias("prec"), r6("z.f").alias("f"))


_CODED_LOG = f"WITH {EMB}, {book_sql()}, {log_sql(source='coded')}"


def _coded_log(spark, sf_dir) -> DataFrame:
    return durable(inputs.logged(inputs.encoded(durable(inputs.embeddings(spark, sf_dir)))))


@query(f"{_CODED_LOG} SELECT 0 AS level, codes[1] AS code, arm, count(*) AS n, {s6('sum(reward - 0.5)')} AS f, {s6('sum(reward - 0.5) / (1 + count(*))')} AS theta FROM log GROUP BY codes[1], arm")
def a6_counter_posterior(spark, sf_dir):
    return posterior.counter_posterior(_coded_log(spark, sf_dir)).select("level", "code", "arm", "n", r6("f").alias("f"), r6("theta").alias("theta"))


def _counters_sql(levels: int = LEVELS, eta: float = 0.5) -> str:
    out = ["l0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS p FROM log)"]
    for level in range(levels):
        out.append(f"t{level} AS MATERIALIZED (SELECT {level} AS level, codes[{level + 1}] AS code, arm, count(*) AS n, sum(reward - least(greatest(p + 0.5, 0), 1)) AS f, sum(reward - least(greatest(p + 0.5, 0), 1)) / (count(*) + 1) AS theta FROM l{level} GROUP BY 2, 3)")
        out.append(f"l{level + 1} AS MATERIALIZED (SELECT l{level}.* EXCLUDE (p), p + {eta**level} * theta AS p FROM l{level} JOIN t{level} t ON t.code = codes[{level + 1}] AND t.arm = l{level}.arm)")
    out.append("cnt AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM t{level}" for level in range(levels)) + ")")
    return ", ".join(out)


@query(f"{_CODED_LOG}, {_counters_sql()} SELECT level, code, arm, n, {s6('f')} AS f, {s6('theta')} AS theta FROM cnt")
def a7_levelwise_counter_fit(spark, sf_dir):
    fit = posterior.levelwise_counter_fit(_coded_log(spark, sf_dir), LEVELS, ARMS, NBITS)
    return fit.select("level", "code", "arm", "n", r6("f").alias("f"), r6("theta").alias("theta"))


def _diag_sql(levels: int = LEVELS, eta: float = 0.5) -> str:
    out = ["l0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS p FROM log)"]
    for level in range(levels):
        out.append(f"z{level} AS MATERIALIZED (SELECT row_id, codes[{level + 1}] AS code, arm, reward - least(greatest(p + 0.5, 0), 1) AS t, generate_subscripts(list_append(residuals[{level + 1}], 1.0), 1) - 1 AS i, unnest(list_append(residuals[{level + 1}], 1.0)) AS v FROM l{level})")
        out.append(f"d{level} AS MATERIALIZED (SELECT {level} AS level, code, arm, i, 1 + sum(v * v) AS prec, sum(v * t) AS f FROM z{level} GROUP BY code, arm, i)")
        out.append(f"l{level + 1} AS MATERIALIZED (SELECT l{level}.* EXCLUDE (p), p + {eta**level} * q AS p FROM l{level} JOIN (SELECT row_id, sum(f / prec * v) AS q FROM z{level} JOIN d{level} USING (code, arm, i) GROUP BY row_id) USING (row_id))")
    return ", ".join(out)


@query(f"{_CODED_LOG}, {_diag_sql()} SELECT level, code, arm, i::INT AS i, {s6('prec')} AS prec, {s6('f')} AS f FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1)")
def a8_levelwise_diag_fit(spark, sf_dir):
    fit = posterior.levelwise_diag_fit(_coded_log(spark, sf_dir), LEVELS, ARMS, NBITS)
    return fit.select("level", "code", "arm", F.posexplode(F.arrays_zip("prec", "f")).alias("i", "z")).select("level", "code", "arm", "i", r6("z.prec").alias("prec"), r6("z.f").alias("f"))


_ORDER_LOG = f"WITH {ORD}, {book_sql()}, {log_sql(5, source='coded')}"


def _order_log(spark, sf_dir) -> DataFrame:
    return durable(inputs.logged(inputs.encoded(durable(inputs.orders(spark, sf_dir))), 5))


def _linear_sql(levels: int = LEVELS, eta: float = 0.5) -> str:
    """CTEs s<l> (sums of two features and an intercept) and w<l> (weights and the inverse), level by level."""
    out = ["l0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS p FROM log)"]
    for level in range(levels):
        lam, u, v, t = f"{0.25**level}::DOUBLE", f"residuals[{level + 1}][1]", f"residuals[{level + 1}][2]", "(reward - least(greatest(p + 0.5, 0), 1))"
        out.append(f"s{level} AS MATERIALIZED (SELECT codes[{level + 1}] AS code, arm, count(*) AS n, {lam} + sum({u} * {u}) AS a, sum({u} * {v}) AS b, sum({u}) AS c, {lam} + sum({v} * {v}) AS d, sum({v}) AS e, {lam} + count(*) AS f, sum({t} * {u}) AS g, sum({t} * {v}) AS h, sum({t}) AS i FROM l{level} GROUP BY 1, 2)")
        out.append(f"i{level} AS (SELECT *, d * f - e * e AS va, c * e - b * f AS vb, b * e - c * d AS vc, a * f - c * c AS vd, b * c - a * e AS ve, a * d - b * b AS vf, a * (d * f - e * e) + b * (c * e - b * f) + c * (b * e - c * d) AS det FROM s{level})")
        out.append(f"w{level} AS MATERIALIZED (SELECT *, (va * g + vb * h + vc * i) / det AS m0, (vb * g + vd * h + ve * i) / det AS m1, (vc * g + ve * h + vf * i) / det AS m2 FROM i{level})")
        out.append(f"l{level + 1} AS MATERIALIZED (SELECT l.*, p + {eta**level} * (m0 * {u} + m1 * {v} + m2) AS p FROM (SELECT * EXCLUDE (p) FROM l{level}) l JOIN l{level} o USING (row_id) JOIN w{level} w ON w.code = l.codes[{level + 1}] AND w.arm = l.arm)".replace(f"{u} + m1 * {v}", f"l.{u} + m1 * l.{v}"))
    return ", ".join(out)


_A9 = [f"SELECT {level} AS level, code, arm, n, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in 'abcdefghi')} FROM s{level}" for level in range(LEVELS)]


@query(f"{_ORDER_LOG}, {_linear_sql()} {' UNION ALL '.join(_A9)}")
def a9_levelwise_linear_fit(spark, sf_dir):
    """All levels; every cell of the matrices of two features and an intercept."""
    fit = posterior.levelwise_linear_fit(_order_log(spark, sf_dir), LEVELS, 5, NBITS)
    at = {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 4), "e": ("a", 5), "f": ("a", 8), "g": ("f", 0), "h": ("f", 1), "i": ("f", 2)}
    return fit.select("level", "code", "arm", "n", *[(F.round(F.get(c, F.lit(i)), 4) + 0.0).alias(name) for name, (c, i) in at.items()])


# two features: the inverse has a closed form, so DuckDB can follow
_SOLVED = f"WITH {ORD}, {log_sql(5)}, g AS (SELECT arm, 1 + sum(x[1] * x[1]) AS a, sum(x[1] * x[2]) AS b, 1 + sum(x[2] * x[2]) AS c, sum(reward * x[1]) AS f, sum(reward * x[2]) AS h, count(*) AS n FROM log GROUP BY arm), post AS MATERIALIZED (SELECT arm, n, c / (a * c - b * b) AS v0, -b / (a * c - b * b) AS v1, a / (a * c - b * b) AS v2, (c * f - b * h) / (a * c - b * b) AS m0, (a * h - b * f) / (a * c - b * b) AS m1 FROM g), sc AS MATERIALIZED (SELECT row_id, p.arm, m0 * x[1] + m1 * x[2] AS mean, v0 * x[1] * x[1] + 2 * v1 * x[1] * x[2] + v2 * x[2] * x[2] AS var FROM ctx, post p)"


def _order_posterior(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    contexts = inputs.orders(spark, sf_dir)
    return contexts, durable(posterior.linear_posterior(inputs.logged(contexts, 5)))


@query(f"{_SOLVED} SELECT arm, n, {s6('m0')} AS m0, {s6('m1')} AS m1 FROM post")
def a10_rebuild_from_log(spark, sf_dir):
    contexts = inputs.orders(spark, sf_dir)
    log = inputs.logged(contexts, 5).withColumn("x", F.array(F.lit(0.0)))
    p = posterior.rebuild_from_log(log, contexts.select("row_id", "x"))
    return p.select("arm", "n", r6(F.get("mean", F.lit(0))).alias("m0"), r6(F.get("mean", F.lit(1))).alias("m1"))


# ------------------------------------------------------------------ scoring


@query(f"{_SOLVED} SELECT row_id, arm, {s6('mean')} AS score FROM sc")
def c1_score_mean_linear(spark, sf_dir):
    return score.score_mean_linear(*_order_posterior(spark, sf_dir)).select("row_id", "arm", r6("score").alias("score"))


@query(f"{_SOLVED} SELECT row_id, arm, {s6('mean + 0.1 * sqrt(greatest(var, 0)) * ' + noise.normal_sql('row_id', 'arm', 8))} AS score FROM sc")
def c2_score_ts_linear(spark, sf_dir):
    return score.score_ts_linear(*_order_posterior(spark, sf_dir), 0.1, 8).select("row_id", "arm", r6("score").alias("score"))


@query()
def c2_score_ts_linear_wide(spark, sf_dir):
    """The same on 64 features with an intercept: 65 x 65 matrices, one an arm."""
    e = inputs.embeddings(spark, sf_dir).withColumn("x", vectors.add_intercept(F.col("x")))
    p = durable(posterior.linear_posterior(inputs.logged(e)))
    return score.score_ts_linear(e, p, 0.1, 8).select("row_id", "arm", r6("score").alias("score"))


_DIAG = f"WITH {ORD}, {log_sql(5)}, p AS MATERIALIZED (SELECT arm, 1 + sum(x[1] * x[1]) AS p0, 1 + sum(x[2] * x[2]) AS p1, sum(reward * x[1]) AS f0, sum(reward * x[2]) AS f1 FROM log GROUP BY arm), sc AS (SELECT row_id, p.arm, f0 / p0 * x[1] + f1 / p1 * x[2] AS mean, x[1] * x[1] / p0 + x[2] * x[2] / p1 AS var FROM ctx, p)"


@query(f"{_DIAG} SELECT row_id, arm, {s6('mean')} AS mean, {s6('mean + 0.1 * sqrt(var) * ' + noise.normal_sql('row_id', 'arm', 8))} AS score FROM sc")
def c3_score_diag(spark, sf_dir):
    contexts = inputs.orders(spark, sf_dir)
    p = durable(posterior.diag_posterior(inputs.logged(contexts, 5)))
    return score.thompson(score.score_diag(contexts, p), 0.1, 8).select("row_id", "arm", r6("mean").alias("mean"), r6("score").alias("score"))


def _gamma_sql(shape: str, *keys: str | int) -> str:
    d, tries = f"({shape} - 1.0 / 3)", []
    for t in range(score.GAMMA_TRIES):
        z, u = noise.normal_sql(*keys, 100 + t), noise.uniform_sql(*keys, 200 + t)
        v = f"pow(1 + {z} / sqrt(9 * {d}), 3)"
        tries.append(f"CASE WHEN {v} > 0 AND ln({u}) < {z} * {z} / 2 + {d} - {d} * {v} + {d} * ln(CASE WHEN {v} > 0 THEN {v} ELSE 1 END) THEN {d} * {v} END")
    return f"coalesce({', '.join(tries)}, {d})"


_NIG = _nig_sql("evt", 5).replace(s6("coalesce(s, 0) / (1 + coalesce(n, 0))"), "coalesce(s, 0) / (1 + coalesce(n, 0))").replace("(round(1 + coalesce(ss", "((1 + coalesce(ss").replace("END, 6) + 0.0) AS beta", "END)) AS beta")
_NIG_DRAWS = f"WITH po AS MATERIALIZED ({_NIG}), dr AS (SELECT unnest(range((SELECT count(*) FROM events))) AS draw), v AS MATERIALIZED (SELECT draw, arm, mu, lam, beta / greatest({_gamma_sql('alpha', 'draw', 'arm', 3)}, 1e-10) AS variance FROM dr, po), dn AS (SELECT draw, arm, mu + {noise.normal_sql('draw', 'arm', 3)} * sqrt(variance / lam) AS mean, variance FROM v)"


def _nig_draws(spark, sf_dir) -> tuple[DataFrame, int]:
    e = inputs.events(spark, sf_dir)
    return durable(posterior.nig_posterior(e, 5)), e.count()


@query(f"{_NIG_DRAWS} SELECT draw, arm, {s6('mean')} AS mean, {s6('variance')} AS variance FROM dn")
def c4_sample_nig_means(spark, sf_dir):
    """As many draws as there are events."""
    return score.sample_nig_means(*_nig_draws(spark, sf_dir), 3).select("draw", "arm", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query(f"{_NIG_DRAWS} SELECT draw, (-(max(struct_pack(s := mean, a := -arm)).a))::INT AS arm FROM dn GROUP BY draw")
def c5_select_ts_nig(spark, sf_dir):
    return score.select_ts_nig(*_nig_draws(spark, sf_dir), 3)


def _counter_scores_sql(seed: int) -> str:
    return (
        f"{_CODED_LOG}, {_counters_sql()}, ar AS (SELECT unnest(range({ARMS}))::INT AS arm), rows AS (SELECT row_id, arm, unnest([0, 1]) AS level, unnest(codes) AS code FROM coded, ar), "
        "sc AS (SELECT row_id, r.arm, r.level, coalesce(theta, 0) AS mean, 1 / (coalesce(n, 0) + 1.0) AS var FROM rows r LEFT JOIN cnt t ON t.level = r.level AND t.code = r.code AND t.arm = r.arm), "
        f"fs AS (SELECT row_id, arm, sum(0.5 ** level * mean) AS mean, sum(0.5 ** level * (mean + 0.1 * sqrt(var) * {noise.normal_sql('row_id', 'arm', 'level', seed)})) AS score FROM sc GROUP BY row_id, arm)"
    )


@query(f"{_counter_scores_sql(2)} SELECT row_id, arm, {s6('mean')} AS mean, {s6('score')} AS score FROM fs")
def c6_score_counter_rq(spark, sf_dir):
    log = _coded_log(spark, sf_dir)
    fit = posterior.levelwise_counter_fit(log, LEVELS, ARMS, NBITS)
    return score.score_counter_rq(log, fit, LEVELS, ARMS, nu=0.1, seed=2).select("row_id", "arm", r6("mean").alias("mean"), r6("score").alias("score"))


@query(
    f"{_CODED_LOG}, {_diag_sql()}, ar AS (SELECT unnest(range({ARMS}))::INT AS arm), rows AS (SELECT row_id, arm, level, codes[level + 1] AS code, unnest(list_append(residuals[level + 1], 1.0)) AS v, generate_subscripts(list_append(residuals[level + 1], 1.0), 1) - 1 AS i FROM coded, ar, (SELECT unnest([0, 1]) AS level))"
    f", lv AS (SELECT row_id, r.arm AS arm, r.level AS level, sum(coalesce(f / prec, 0) * v) AS m, sum(v * v / coalesce(prec, 1)) AS q FROM rows r LEFT JOIN (SELECT * FROM d0 UNION ALL SELECT * FROM d1) t ON t.level = r.level AND t.code = r.code AND t.arm = r.arm AND t.i = r.i GROUP BY 1, 2, 3) "
    f"SELECT row_id, arm, {s6('sum(0.5 ** level * m)')} AS mean, {s6('sum(0.5 ** level * (m + 0.1 * sqrt(greatest(q, 0)) * ' + noise.normal_sql('row_id', 'arm', 'level', 2) + '))')} AS score FROM lv GROUP BY row_id, arm"
)
def c7_score_diag_rq(spark, sf_dir):
    log = _coded_log(spark, sf_dir)
    fit = posterior.levelwise_diag_fit(log, LEVELS, ARMS, NBITS)
    return score.score_diag_rq(log, fit, LEVELS, ARMS, nu=0.1, seed=2).select("row_id", "arm", r6("mean").alias("mean"), r6("score").alias("score"))


_LEVEL_ROWS = " UNION ALL ".join(f"SELECT row_id, {level} AS level, codes[{level + 1}] AS code, residuals[{level + 1}][1] AS u, residuals[{level + 1}][2] AS v FROM coded" for level in range(LEVELS))
_LEVEL_MODELS = " UNION ALL ".join(f"SELECT {level} AS level, * FROM w{level}" for level in range(LEVELS))


@query(
    f"{_ORDER_LOG}, {_linear_sql()}, ar AS (SELECT unnest(range(5))::INT AS arm), lr AS ({_LEVEL_ROWS}), lv AS (SELECT row_id, ar.arm AS arm, lr.level AS level, coalesce(m0 * u + m1 * v + m2, 0) AS m, "
    "coalesce((va * u * u + 2 * vb * u * v + 2 * vc * u + vd * v * v + 2 * ve * v + vf) / det, (u * u + v * v + 1) / 0.25 ** lr.level) + 1e-6 * 10.0 ** lr.level * (u * u + v * v + 1) / 0.01 AS q "
    f"FROM lr CROSS JOIN ar LEFT JOIN ({_LEVEL_MODELS}) w ON w.level = lr.level AND w.code = lr.code AND w.arm = ar.arm) "
    f"SELECT row_id, arm, {s6('sum(0.5 ** level * m)')} AS mean, {s6('sum(0.5 ** level * (m + 0.1 * sqrt(greatest(q, 0)) * ' + noise.normal_sql('row_id', 'arm', 'level', 2) + '))')} AS score FROM lv GROUP BY row_id, arm"
)
def c8_score_linear_rq(spark, sf_dir):
    log = _order_log(spark, sf_dir)
    fit = posterior.levelwise_linear_fit(log, LEVELS, 5, NBITS)
    return score.score_linear_rq(log, fit, LEVELS, 5, nu=0.1, seed=2).select("row_id", "arm", r6("mean").alias("mean"), r6("score").alias("score"))


@query(f"{_SOLVED} SELECT row_id, arm, {s6('mean + 1.0 * sqrt(greatest(var, 0))')} AS score FROM sc")
def c9_score_linucb(spark, sf_dir):
    return score.score_linucb(*_order_posterior(spark, sf_dir)).select("row_id", "arm", r6("score").alias("score"))


@query(f"{_SOLVED} SELECT row_id, arm, {s6('arm / 10.0 + 2.0 * sqrt(greatest(var, 0))')} AS score FROM sc")
def c10_score_ucb_on_prediction(spark, sf_dir):
    contexts, p = _order_posterior(spark, sf_dir)
    predictions = prepare.expand_arms(contexts.select("row_id", F.col("x").alias("g")), 5).withColumn("pred", F.col("arm") / 10.0)
    return score.score_ucb_on_prediction(predictions, p, 2.0).select("row_id", "arm", r6("score").alias("score"))


_BEST = "best AS (SELECT row_id, (-(max(struct_pack(s := mean, a := -arm)).a))::INT AS arm FROM sc GROUP BY row_id)"


def _eps_sql(share: str, source: str) -> str:
    return f"SELECT row_id, CASE WHEN {noise.uniform_sql('row_id', 12, 4)} < {share} THEN floor({noise.uniform_sql('row_id', 12, 5)} * 5)::INT ELSE arm END AS arm FROM {source}"


@query(f"{_SOLVED}, {_BEST} {_eps_sql('0.05', 'best')}")
def c11_select_eps_greedy(spark, sf_dir):
    best = score.choose(score.score_mean_linear(*_order_posterior(spark, sf_dir)))
    return score.select_eps_greedy(best, 5, 12, 0.05)


@query(f"{_SOLVED}, {_BEST}, u AS (SELECT row_id, {noise.uniform_sql('row_id', 4)} AS u FROM ctx), rd AS (SELECT row_id, row_number() OVER (ORDER BY u, row_id) AS round FROM u), b AS (SELECT * FROM best JOIN rd USING (row_id)) {_eps_sql('0.1 / ln(round + 1.0)', 'b')}")
def c12_select_eps_decay(spark, sf_dir):
    contexts, p = _order_posterior(spark, sf_dir)
    best = score.choose(score.score_mean_linear(contexts, p)).join(prepare.shuffle_rounds(contexts, 4).select("row_id", "round"), "row_id")
    return score.select_eps_greedy(best, 5, 12, score.decaying_eps()).select("row_id", "arm")


@query(f"WITH {ORD} SELECT row_id, floor({noise.uniform_sql('row_id', 9, 5)} * 5)::INT AS arm FROM ctx")
def c13_select_uniform(spark, sf_dir):
    return score.select_uniform(inputs.orders(spark, sf_dir), 5, 9).select("row_id", "arm")


# ------------------------------------------------------------ reward models


@query()
def m1_fit_reward_gbt(spark, sf_dir):
    """The summed importance of the fitted trees' features."""
    log = durable(inputs.logged(inputs.orders(spark, sf_dir), 5))
    model = models.fit_reward_gbt(log, 5)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(model.model.featureImportances.toArray())], "feature int, importance double")


@query()
def m2_predict_reward(spark, sf_dir):
    contexts = durable(inputs.logged(inputs.orders(spark, sf_dir), 5))
    model = models.fit_reward_gbt(contexts, 5)
    return models.choose_reward(model, contexts.select("row_id", "x"), 5).select("row_id", "arm")


@query()
def m3_refit_every(spark, sf_dir):
    log = durable(prepare.shuffle_rounds(inputs.logged(inputs.orders(spark, sf_dir), 5), 4))
    every = max(1, log.count() // 3)
    return models.refit_every(log, log, 5, every).select("row_id", "round", "arm")


_STRETCHES = (
    f"WITH {ORD}, {log_sql(5)}, rd AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {noise.uniform_sql('row_id', 4)}, row_id) AS round, greatest(1, (SELECT count(*) FROM log) // 3) AS every FROM log), st AS MATERIALIZED (SELECT DISTINCT (round - 1) // every AS s FROM rd), "
    "g AS (SELECT s, arm, 1 + sum(x[1] * x[1]) AS a, sum(x[1] * x[2]) AS b, 1 + sum(x[2] * x[2]) AS c, sum(reward * x[1]) AS f, sum(reward * x[2]) AS h FROM st JOIN rd ON round <= s * every GROUP BY 1, 2), "
    "w AS MATERIALIZED (SELECT s, arm, (c * f - b * h) / (a * c - b * b) AS m0, (a * h - b * f) / (a * c - b * b) AS m1 FROM g)"
)


@query(f"{_STRETCHES} SELECT row_id, round, (-(max(struct_pack(s := m0 * x[1] + m1 * x[2], a := -w.arm)).a))::INT AS arm FROM rd JOIN w ON w.s = (round - 1) // every GROUP BY row_id, round UNION ALL SELECT row_id, round, NULL FROM rd WHERE round <= every")
def m3_refit_every_linear(spark, sf_dir):
    """The same schedule with linear posteriors in place of trees."""
    log = durable(prepare.shuffle_rounds(inputs.logged(inputs.orders(spark, sf_dir), 5), 4))
    every = max(1, log.count() // 3)
    return models.refit_every(log, log.drop("arm"), 5, every, lambda rows: durable(posterior.linear_posterior(rows)), lambda model, rows: score.score_mean_linear(rows, model)).select("row_id", "round", "arm")


@query(f"WITH {ORD}, u AS (SELECT row_id, {noise.uniform_sql('row_id', 4)} AS u FROM ctx), rd AS (SELECT row_number() OVER (ORDER BY u, row_id) AS round FROM u) SELECT (length(bin((round - 1) // 500 + 1)) - 1)::INT AS phase, min(round) AS first, max(round) AS last FROM rd GROUP BY 1")
def m4_doubling_schedule(spark, sf_dir):
    rounds = prepare.shuffle_rounds(inputs.orders(spark, sf_dir), 4)
    return rounds.groupBy(models.doubling_phase("round", 500).alias("phase")).agg(F.min("round").alias("first"), F.max("round").alias("last"))


_RIDGE = f"WITH {ORD}, ar AS (SELECT unnest(range(5))::INT AS arm), m AS (SELECT avg(x[1]) AS m0, avg(x[2]) AS m1 FROM ctx), g AS (SELECT 1 + sum((x[1] - m0) ** 2) AS a, sum((x[1] - m0) * (x[2] - m1)) AS b, 1 + sum((x[2] - m1) ** 2) AS c FROM ctx, m), h AS (SELECT arm, avg((label = arm)::INT) AS y, sum((x[1] - m0) * (label = arm)::INT) AS f, sum((x[2] - m1) * (label = arm)::INT) AS h FROM ctx, m, ar GROUP BY arm), w AS MATERIALIZED (SELECT arm, (c * f - b * h) / (a * c - b * b) AS w0, (a * h - b * f) / (a * c - b * b) AS w1, y - ((c * f - b * h) * m0 + (a * h - b * f) * m1) / (a * c - b * b) AS b0 FROM h, g, m)"


@query(f"{_RIDGE} SELECT arm, {s6('w0')} AS w0, {s6('w1')} AS w1, {s6('b0')} AS intercept FROM w")
def m5_fit_ridge(spark, sf_dir):
    w, b = models.fit_ridge_multi(inputs.orders(spark, sf_dir), 5)
    return spark.createDataFrame([(a, *(float(v) for v in w[a]), float(b[a])) for a in range(5)], "arm int, w0 double, w1 double, intercept double").select("arm", r6("w0").alias("w0"), r6("w1").alias("w1"), r6("intercept").alias("intercept"))


@query(f"WITH {EMB}, {book_sql()}, {additive_sql()} SELECT codes[1] AS code0, codes[2] AS code1, t0.arm AS arm, {s6('t0.t + t1.t')} AS prediction, count(*) AS n FROM coded JOIN t0 ON t0.code = codes[1] JOIN t1 ON t1.code = codes[2] AND t1.arm = t0.arm GROUP BY 1, 2, 3, t0.t, t1.t")
def m6_fit_additive_ols(spark, sf_dir):
    """Predictions for all arms of all pairs of codes that occur; the weights themselves are not unique."""
    coded = durable(inputs.encoded(durable(inputs.embeddings(spark, sf_dir)), False))
    theta = models.theta_table(spark, models.fit_additive_ols(coded, ARMS, LEVELS, NBITS))
    rows = coded.groupBy(F.get("codes", F.lit(0)).alias("code0"), F.get("codes", F.lit(1)).alias("code1")).agg(F.count("*").alias("n"))
    for level in range(LEVELS):
        rows = rows.join(theta.where(F.col("level") == level).select(F.col("code").alias(f"code{level}"), F.col("theta").alias(f"t{level}")), f"code{level}")
    each = rows.select("code0", "code1", "n", F.posexplode(vectors.weighted_sum("t0", "t1", 1.0)).alias("arm", "prediction"))
    return each.select("code0", "code1", "arm", r6("prediction").alias("prediction"), "n")


@query(f"WITH {EMB}, {book_sql()}, {_boosted_sql(LEVELS, NBITS)} SELECT level, code, arm, {s6('mean')} AS mean, {s6('smoothed')} AS smoothed FROM (SELECT 0 AS level, * FROM m0 UNION ALL SELECT 1, * FROM m1)")
def m7_fit_boosted_centroids(spark, sf_dir):
    coded = durable(inputs.encoded(durable(inputs.embeddings(spark, sf_dir)), False))
    fit = models.fit_boosted_centroids(coded, ARMS, LEVELS, NBITS)
    return fit.select("level", "code", F.posexplode(F.arrays_zip("mean", "smoothed")).alias("arm", "z")).select("level", "code", "arm", r6("z.mean").alias("mean"), r6("z.smoothed").alias("smoothed"))


# -------------------------------------------------------------- diagnostics


def _delta_sql(rows: str, depth: int) -> str:
    second = "JOIN t1 ON t1.code = codes[2] AND t1.arm = t0.arm" if depth > 1 else "JOIN (SELECT DISTINCT arm, 0.0::DOUBLE AS t FROM t1) t1 ON t1.arm = t0.arm"
    return f"SELECT {depth} AS depth, avg(e) AS delta, count(*) AS n FROM (SELECT row_id, max(abs((label = t0.arm)::INT - t0.t - t1.t)) AS e FROM {rows} JOIN t0 ON t0.code = codes[1] {second} GROUP BY row_id)"


@query(f"WITH {EMB}, {book_sql()}, {additive_sql()} SELECT depth, {s6('delta')} AS delta, n FROM ({_delta_sql('coded', 2)})")
def d1_delta_additive(spark, sf_dir):
    coded = durable(inputs.encoded(durable(inputs.embeddings(spark, sf_dir)), False))
    theta = models.theta_table(spark, models.fit_additive_ols(coded, ARMS, LEVELS, NBITS))
    return diagnose.delta_additive(coded, theta, LEVELS, ARMS).select("depth", r6("delta").alias("delta"), "n")


def _sweep_sql(depth: int, seed: int) -> str:
    """Error at one depth of a model that was fitted to a holdout of 200 rows."""
    split = f"sp AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {noise.uniform_sql('row_id', seed)}, row_id) <= least(200, (SELECT count(*) FROM embeddings) // 2) AS holdout FROM al), ctx AS MATERIALIZED (SELECT row_id, x, label FROM sp WHERE holdout), ot AS (SELECT row_id, x, label FROM sp WHERE NOT holdout)"
    return f"(WITH {EMB.replace('ctx AS', 'al AS')}, {split}, {book_sql()}, {encode_sql('ot')}, {additive_sql(depth=depth)} {_delta_sql('judged', depth)})"


_SWEEP = " UNION ALL ".join(f"SELECT * FROM {_sweep_sql(depth, seed)}" for depth in (1, 2) for seed in (0, 1))


@query(f"SELECT depth, {s6('avg(delta)')} AS delta, {s6('2 * avg(delta)')} AS twice, {s6('stddev_pop(delta)')} AS sd FROM ({_SWEEP}) GROUP BY depth")
def d2_delta_sweep(spark, sf_dir):
    sweep = diagnose.delta_additive_sweep(durable(inputs.embeddings(spark, sf_dir)), (1, 2), (0, 1), 200, ARMS, NBITS, ITERATIONS)
    return diagnose.summarize_sweep(sweep).select("depth", r6("delta").alias("delta"), r6("twice").alias("twice"), r6("sd").alias("sd"))


@query(
    f"WITH {EMB}, {book_sql()}, {_boosted_sql(LEVELS, NBITS)}, q AS (SELECT row_id, label, t.arm, a.smoothed + 0.5 * b.smoothed AS p FROM p0 t JOIN m0 a ON a.code = codes[1] AND a.arm = t.arm JOIN m1 b ON b.code = codes[2] AND b.arm = t.arm) "
    f"SELECT 2 AS depth, (SELECT {s6('avg(abs((label = arm)::INT - least(greatest(p, 0), 1)))')} FROM p2) AS mae, (SELECT {s6('avg(abs((label = arm)::INT - least(greatest(p, 0), 1)))')} FROM q) AS mae_smoothed"
)
def d3_delta_boosted(spark, sf_dir):
    coded = durable(inputs.encoded(durable(inputs.embeddings(spark, sf_dir)), False))
    fit = durable(models.fit_boosted_centroids(coded, ARMS, LEVELS, NBITS))
    return diagnose.delta_boosted(coded, fit, LEVELS, ARMS).select("depth", r6("mae").alias("mae"), r6("mae_smoothed").alias("mae_smoothed"))


@query(f"{_RIDGE}, p AS (SELECT row_id, label, arm, least(greatest(w0 * x[1] + w1 * x[2] + b0, 0), 1) AS p FROM ctx, w), s AS (SELECT row_id, label, arm, p / greatest(sum(p) OVER (PARTITION BY row_id), 1e-10) AS p FROM p) SELECT {s6('avg(abs((label = arm)::INT - p))')} AS mae FROM s")
def d4_delta_linear(spark, sf_dir):
    contexts = inputs.orders(spark, sf_dir)
    return diagnose.delta_linear(contexts, *models.fit_ridge_multi(contexts, 5)).select(r6("mae").alias("mae"))


_MAE = "avg(abs((label = arm)::INT - least(greatest(p, 0), 1)))"
_REPORT = (
    f"{_RIDGE}, {book_sql()}, {_boosted_sql(LEVELS, NBITS, 5)}, q1 AS (SELECT row_id, label, t.arm, a.smoothed AS p FROM p0 t JOIN m0 a ON a.code = codes[1] AND a.arm = t.arm), "
    "q2 AS (SELECT row_id, label, t.arm, a.smoothed + 0.5 * b.smoothed AS p FROM p0 t JOIN m0 a ON a.code = codes[1] AND a.arm = t.arm JOIN m1 b ON b.code = codes[2] AND b.arm = t.arm), "
    "lp AS (SELECT row_id, label, arm, least(greatest(w0 * x[1] + w1 * x[2] + b0, 0), 1) AS p FROM ctx, w), ls AS (SELECT label, arm, p / greatest(sum(p) OVER (PARTITION BY row_id), 1e-10) AS p FROM lp), li AS MATERIALIZED (SELECT avg(abs((label = arm)::INT - p)) AS mae FROM ls), "
    "xo AS MATERIALIZED (SELECT label, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM ctx), xg AS (SELECT i, avg(v) AS m FROM xo GROUP BY i), xk AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM xo GROUP BY 1, 2), "
    "rh AS MATERIALIZED (SELECT sqrt((SELECT sum(n * (xk.m - xg.m) ** 2) FROM xk JOIN xg USING (i)) / (SELECT sum((v - m) ** 2) FROM xo JOIN xg USING (i))) AS rho), "
    f"rq AS MATERIALIZED (SELECT 1 AS depth, (SELECT {_MAE} FROM p1) AS mae, (SELECT {_MAE} FROM q1) AS smooth UNION ALL SELECT 2, (SELECT {_MAE} FROM p2), (SELECT {_MAE} FROM q2)) "
)
_REPORT_COLUMNS = {"delta_rq_mae": "rq.mae", "delta_rq_mae_smoothed": "smooth", "delta_lin_mae": "li.mae", "delta_gap": "li.mae - rq.mae", "delta_gap_smoothed": "li.mae - smooth", "rho": "rho"}


@query(f"{_REPORT} SELECT 'orders' AS dataset, (SELECT count(*) FROM ctx) AS N, 2 AS d, 5 AS C, depth, {', '.join(f'{s6(v)} AS {k}' for k, v in _REPORT_COLUMNS.items())} FROM rq, li, rh")
def d5_delta_report(spark, sf_dir):
    report = diagnose.delta_report("orders", durable(inputs.orders(spark, sf_dir)), (1, 2), 5, NBITS, ITERATIONS)
    return report.select("dataset", "N", "d", "C", "depth", *[r6(c).alias(c) for c in _REPORT_COLUMNS])


@query(f"WITH {ORD}, c AS (SELECT label, count(*) AS c FROM ctx GROUP BY label) SELECT 'orders' AS dataset, 2 AS d, count(label) AS a, sum(c)::BIGINT AS n, 4 * count(label) AS d2a, round(max(c) / sum(c), 4) AS p_max FROM c")
def d6_dataset_stats(spark, sf_dir):
    return diagnose.dataset_stats(inputs.orders(spark, sf_dir), "orders")


@query(f"WITH {LIN}, c AS (SELECT label, count(*) AS c FROM ctx GROUP BY label) SELECT (-(max(struct_pack(c := c, l := -label)).l))::INT AS arm, {s6('max(c) / sum(c)')} AS share FROM c")
def d7_best_fixed_arm(spark, sf_dir):
    return diagnose.best_fixed_arm(inputs.lineitem(spark, sf_dir)).select("arm", r6("share").alias("share"))


@query(f"WITH {EMB}, o AS (SELECT label, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM ctx), g AS (SELECT i, avg(v) AS m FROM o GROUP BY i), k AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM o GROUP BY 1, 2) SELECT {s6('sqrt((SELECT sum(n * (k.m - g.m) ** 2) FROM k JOIN g USING (i)) / (SELECT sum((v - m) ** 2) FROM o JOIN g USING (i)))')} AS rho")
def d8_correlation_ratio(spark, sf_dir):
    return diagnose.correlation_ratio(inputs.embeddings(spark, sf_dir)).select(r6("rho").alias("rho"))


@query("SELECT d, k, round((SELECT count(*) FROM orders) / (16.0 * k * d * d), 6) AS ratio FROM (SELECT unnest([4, 8, 16]) AS d), (SELECT unnest([2, 5]) AS k)")
def d9_sufficiency_ratio(spark, sf_dir):
    n = inputs.table(spark, sf_dir, "orders").count()
    return decisions.sweep_grid(spark, d=[4, 8, 16], k=[2, 5]).select("d", "k", F.round(diagnose.sufficiency_ratio(F.lit(n), 16, F.col("k"), F.col("d")), 6).alias("ratio"))


_ERRORS = f"{_CODED_LOG}, {_counters_sql()}, er AS MATERIALIZED (SELECT l.row_id, (l.reward - least(greatest(a.theta + 0.5, 0), 1)) ** 2 AS sq_err_active, (l.reward - least(greatest(a.theta + 0.5 * b.theta + 0.5, 0), 1)) ** 2 AS sq_err_shadow FROM log l JOIN t0 a ON a.code = l.codes[1] AND a.arm = l.arm JOIN t1 b ON b.code = l.codes[2] AND b.arm = l.arm)"


def _errors(spark, sf_dir) -> DataFrame:
    log = _coded_log(spark, sf_dir)
    fit = durable(posterior.levelwise_counter_fit(log, LEVELS, ARMS, NBITS))
    return diagnose.depth_errors(diagnose.counter_predictions(log, fit, LEVELS), 1, 2, "row_id")


@query(f"{_ERRORS} SELECT row_id, {s6('sq_err_active')} AS sq_err_active, {s6('sq_err_shadow')} AS sq_err_shadow FROM er")
def d10_squared_errors(spark, sf_dir):
    return _errors(spark, sf_dir).select("row_id", r6("sq_err_active").alias("sq_err_active"), r6("sq_err_shadow").alias("sq_err_shadow"))


# errors of two constant predictions of the events' rewards, by user; run 1 predicts the same at both depths
_EVENT_ERRORS = f"WITH RECURSIVE {EVT}, er AS MATERIALIZED (SELECT user_id % 7 AS run_id, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, row_id) AS round, (reward - (0.45::DOUBLE + 0.05::DOUBLE * (user_id % 7))) ** 2 AS sq_err_active, (reward - 0.5) ** 2 AS sq_err_shadow FROM evt), mo AS MATERIALIZED (SELECT run_id, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, sum(d) AS total, var_pop(d) * count(*) AS spread, max(abs(d)) AS top FROM (SELECT run_id, sq_err_active - sq_err_shadow AS d FROM er) GROUP BY run_id)"
# Student's tail by Simpson's rule between 0 and t
_TESTED = (
    f"{_EVENT_ERRORS}, st AS (SELECT *, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END AS t, (n - 1)::DOUBLE AS df, CASE WHEN total > 0 THEN -(total * total) / (2 * spread + 2 * top * total / 3) END AS log_p FROM mo), "
    "ig AS (SELECT run_id, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * (1 + (t * i / 4000) ** 2 / df) ** (-(df + 1) / 2)) * t / 12000 AS area FROM st, (SELECT unnest(range(4001)) AS i) GROUP BY run_id, t), "
    "tt AS MATERIALIZED (SELECT st.*, 0.5 - area * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS p FROM st JOIN ig USING (run_id))"
)
_T_PROMOTES, _F_PROMOTES = "CASE WHEN sd > 0 THEN mean > 0 AND p < 0.05 ELSE mean > 0 END", "coalesce(log_p < ln(0.05), false)"


def _event_errors(spark, sf_dir, rounds: bool = False) -> DataFrame:
    e = inputs.events(spark, sf_dir).withColumn("run_id", F.col("user_id") % 7)
    if rounds:
        e = prepare.number_rounds(e, ["run_id"], ["ts", "row_id"], F.date_trunc("hour", "ts"))
    error = lambda c: F.pow(F.col("reward") - c, F.lit(2.0))
    return e.select("run_id", *(["round"] if rounds else []), error(F.lit(0.45) + F.lit(0.05) * F.col("run_id")).alias("sq_err_active"), error(F.lit(0.5)).alias("sq_err_shadow"))


@query(f"{_TESTED} SELECT run_id, n, round(t, 4) AS t, {s6('p')} AS p, {_T_PROMOTES} AS promote FROM tt")
def d11_paired_t(spark, sf_dir):
    tested = diagnose.paired_t_promotion(diagnose.window_moments(_event_errors(spark, sf_dir), ["run_id"]), 0.05)
    return tested.select("run_id", "n", F.round("t", 4).alias("t"), r6("p").alias("p"), F.col("promote_t").alias("promote"))


@query(f"{_TESTED} SELECT run_id, round(log_p, 4) AS log_p, {_F_PROMOTES} AS promote FROM tt")
def d12_freedman(spark, sf_dir):
    m = diagnose.freedman_promotion(diagnose.window_moments(_event_errors(spark, sf_dir), ["run_id"]), 0.05)
    return m.select("run_id", F.round("log_p", 4).alias("log_p"), F.col("promote_freedman").alias("promote"))


@query("SELECT k::INT AS k, (1600 * 2 ** k)::BIGINT AS t, round(0.05 / 12, 9) AS alpha, (SELECT count(*) FROM events) >= 1600 * 2 ** k AS reached FROM (SELECT unnest(range(12)) AS k)")
def d13_check_schedule(spark, sf_dir):
    n = inputs.table(spark, sf_dir, "events").count()
    return diagnose.check_schedule(spark, 50, 16, 2, 4).select("k", "t", F.round("alpha", 9).alias("alpha"), (F.lit(n) >= F.col("t")).alias("reached"))


_WALK = (
    f"{_EVENT_ERRORS}, ck AS (SELECT k::INT AS k, (40 * 2 ** k)::BIGINT AS t FROM (SELECT unnest(range(12)) AS k)), la AS (SELECT run_id, max(round) AS last FROM er GROUP BY run_id), "
    "wm AS MATERIALIZED (SELECT run_id, k, t, count(*) AS n, sum(d) AS total, var_pop(d) * count(*) AS spread, max(abs(d)) AS top FROM (SELECT er.run_id, k, t, sq_err_active - sq_err_shadow AS d FROM er JOIN la USING (run_id) JOIN ck ON t <= last AND round <= t AND round > t - 100) GROUP BY 1, 2, 3), "
    "wk AS (SELECT run_id, -1 AS k, 1 AS depth, 0::BIGINT AS since, NULL::BIGINT AS t FROM la UNION ALL SELECT run_id, k, CASE WHEN won THEN depth + 1 ELSE depth END, CASE WHEN won THEN t ELSE since END, CASE WHEN won THEN t END FROM "
    "(SELECT w.run_id, m.k, w.depth, w.since, m.t, w.depth < 8 AND m.n >= 100 AND m.t - w.since >= 100 AND m.total > 0 AND -(m.total * m.total) / (2 * m.spread + 2 * m.top * m.total / 3) < ln(0.05 / 12) AS won FROM wk w JOIN wm m ON m.run_id = w.run_id AND m.k = w.k + 1))"
)


@query(f"{_WALK} SELECT run_id, t, (depth - 1)::INT AS old_depth, depth::INT AS new_depth FROM wk WHERE t IS NOT NULL")
def d14_promotion_log(spark, sf_dir):
    return diagnose.promotion_log(_event_errors(spark, sf_dir, True), diagnose.check_schedule(spark, 5, 4, 2, 4), 100, "freedman")


# ------------------------------------------------------- decision analytics


@query(f"WITH {EMB}, {log_sql()} SELECT row_id, arm FROM (SELECT row_id, unnest(range({ARMS}))::INT AS arm, label FROM ctx) WHERE arm = label")
def t1_argmax_arm(spark, sf_dir):
    """Indicator scores with a NaN in place of the worst: the label wins."""
    long = prepare.expand_arms(inputs.embeddings(spark, sf_dir), ARMS)
    s = F.when(F.col("arm") == (F.col("label") + 1) % ARMS, F.lit(float("nan"))).otherwise((F.col("arm") == F.col("label")).cast("double"))
    return score.choose(long.withColumn("score", s)).select("row_id", "arm")


_RUNS = f"WITH {EVT}, lg AS MATERIALIZED (SELECT 'm' || (user_id % 3) AS method, user_id % 2 AS seed, row_number() OVER (PARTITION BY user_id % 3, user_id % 2 ORDER BY ts, row_id) AS round, reward FROM evt)"


def _runs(spark, sf_dir, rounds: bool = False) -> DataFrame:
    e = inputs.events(spark, sf_dir).select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("method"), (F.col("user_id") % 2).alias("seed"), "ts", "row_id", "reward")
    return prepare.number_rounds(e, ["method", "seed"], ["ts", "row_id"], F.date_trunc("hour", "ts")) if rounds else e


@query(f"{_RUNS}, s AS (SELECT method, seed, (round - 1) // 100 AS b, sum(1 - reward) AS r, max(round) AS round FROM lg GROUP BY 1, 2, 3) SELECT method, seed, round, {s6('sum(r) OVER (PARTITION BY method, seed ORDER BY b)')} AS regret FROM s")
def t2_regret_curve(spark, sf_dir):
    return decisions.regret_curve(_runs(spark, sf_dir, True), 100).select("method", "seed", "round", r6("regret").alias("regret"))


_FINAL = f"{_RUNS}, fin AS MATERIALIZED (SELECT method, seed, sum(1 - reward) AS final_regret, avg(1 - reward) AS regret_rate, count(*) AS rounds FROM lg GROUP BY 1, 2)"


@query(f"{_FINAL} SELECT method, seed, {s6('final_regret')} AS final_regret, {s6('regret_rate')} AS regret_rate, rounds FROM fin")
def t3_final_regret(spark, sf_dir):
    return decisions.final_regret(_runs(spark, sf_dir)).select("method", "seed", r6("final_regret").alias("final_regret"), r6("regret_rate").alias("regret_rate"), "rounds")


@query(f"{_FINAL} SELECT method, {s6('avg(final_regret)')} AS mean, {s6('stddev_pop(final_regret)')} AS sd, count(*) AS runs FROM fin GROUP BY method")
def t4_method_summary(spark, sf_dir):
    return decisions.method_summary(decisions.final_regret(_runs(spark, sf_dir))).select("method", r6("mean").alias("mean"), r6("sd").alias("sd"), "runs")


@query(f"{_FINAL}, su AS (SELECT method, avg(final_regret) AS mean FROM fin GROUP BY method), b AS (SELECT mean AS b FROM su WHERE method = 'm0') SELECT method, {s6('mean')} AS mean, CASE WHEN method <> 'm0' THEN {s6('(mean - b) / b * 100')} END AS relative FROM su, b")
def t5_relative_to_baseline(spark, sf_dir):
    s = decisions.method_summary(decisions.final_regret(_runs(spark, sf_dir)))
    return decisions.relative_to_baseline(s, "m0").select("method", r6("mean").alias("mean"), r6("relative").alias("relative"))


@query(f"{_FINAL} SELECT method, seed, {s6('final_regret')} AS final_regret FROM fin ORDER BY 1, 2")
def t6_ordered_results(spark, sf_dir):
    return decisions.ordered_results(decisions.final_regret(_runs(spark, sf_dir)).select("method", "seed", r6("final_regret").alias("final_regret")), "method", "seed")


@query("SELECT event_id AS row_id, c_name AS name FROM events LEFT JOIN customer ON c_custkey = user_id")
def t7_keyed_gather(spark, sf_dir):
    look = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return decisions.keyed_gather(inputs.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "user_id"), look, ["user_id"]).select("row_id", "name")


@query(f"{_TESTED} SELECT run_id, round(t, 4) AS t, {s6('p')} AS p, round(log_p, 4) AS log_p, {_T_PROMOTES} AS promote_t, {_F_PROMOTES} AS promote_freedman FROM tt")
def t8_compare_promotion_tests(spark, sf_dir):
    both = diagnose.compare_promotion_tests(_event_errors(spark, sf_dir), ["run_id"], 0.05)
    return both.select("run_id", F.round("t", 4).alias("t"), r6("p").alias("p"), F.round("log_p", 4).alias("log_p"), "promote_t", "promote_freedman")


@query(f"WITH {EVT} SELECT user_id % 7 AS run_id, '1->2 at ' || min(row_id) || ', 2->3 at ' || (max(row_id) + 1) AS report FROM evt GROUP BY 1")
def t9_promotion_report(spark, sf_dir):
    runs = inputs.events(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("run_id")).agg(F.min("row_id").alias("a"), (F.max("row_id") + 1).alias("b"))
    steps = F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("old_depth"), F.lit(2).alias("new_depth")), F.struct(F.col("b").alias("t"), F.lit(2).alias("old_depth"), F.lit(3).alias("new_depth")))
    return decisions.promotion_report(runs.select("run_id", F.explode(steps).alias("s")).select("run_id", "s.*"))


@query("SELECT d, k, label, n FROM (SELECT unnest([8, 16]) AS d), (SELECT unnest([1, 2, 3]) AS k), (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def t10_sweep_grid(spark, sf_dir):
    grid = F.array(*[F.struct(F.lit(r["d"]).alias("d"), F.lit(r["k"]).alias("k")) for r in decisions.sweep_grid(spark, d=[8, 16], k=[1, 2, 3]).collect()])
    counts = inputs.embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("g", F.explode(grid)).select("g.d", "g.k", "label", "n")


# ---------------------------------------------------------------- streaming

#: Rows of one file of a written stream, about.
FILE_ROWS = 250_000
BATCHES = 3
_BATCH = f"floor({noise.uniform_sql('row_id', 1)} * {BATCHES})::INT"


def _with_batch(df: DataFrame) -> DataFrame:
    return df.withColumn("batch", F.floor(noise.uniform("row_id", 1) * BATCHES).cast("int"))


def _batch_files(df: DataFrame) -> tuple[list[int], int]:
    """The batches that there are, and the number of files for each."""
    sizes = {r["batch"]: r["count"] for r in df.groupBy("batch").count().collect()}
    return sorted(sizes), max(1, -(-max(sizes.values(), default=1) // FILE_ROWS))


def _stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows with `batch` 0, 1, ... as a stream of these batches: each is written as the same number of
    files, and so many files make a batch."""
    path, (batches, files) = _scratch(spark, "stream"), _batch_files(df)
    for b in batches:
        df.where(F.col("batch") == b).drop("batch").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", files).parquet(path)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, _with_batch(inputs.events(spark, sf_dir).select("row_id", "arm", "reward")))


@query(f"{_counter_scores_sql(0)} SELECT row_id, (-(max(struct_pack(s := score, a := -arm)).a))::INT AS arm FROM fs GROUP BY row_id")
def r1_decide_stream(spark, sf_dir):
    e = durable(inputs.embeddings(spark, sf_dir))
    book = inputs.codebook(e)
    folder = _scratch(spark, "r1")
    micro.write_version(posterior.levelwise_counter_fit(durable(inputs.logged(quantize.encode(e, book))), LEVELS, ARMS, NBITS), f"{folder}/counters", 0)
    decide = lambda batch, table: micro.decide_batch(batch, book, table, LEVELS, ARMS)
    micro.decide_stream(_stream(spark, _with_batch(e)), decide, f"{folder}/counters", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("row_id", "arm")


@query(f"{_SOLVED}, ts AS (SELECT row_id, arm, mean + 0.1 * sqrt(greatest(var, 0)) * {noise.normal_sql('row_id', 'arm', 8)} AS score FROM sc) SELECT row_id, (-(max(struct_pack(s := score, a := -arm)).a))::INT AS arm FROM ts GROUP BY row_id")
def r1_decide_stream_flat(spark, sf_dir):
    """Decisions of a stream of orders by a flat linear model."""
    contexts, fitted = _order_posterior(spark, sf_dir)
    folder = _scratch(spark, "r1")
    micro.write_version(fitted, f"{folder}/linear", 0)
    decide = lambda batch, table: micro.decide_flat_batch(batch, table, "linear", 0.1, 8)
    micro.decide_stream(_stream(spark, _with_batch(contexts.select("row_id", "x"))), decide, f"{folder}/linear", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("row_id", "arm")


@query(_nig_sql("evt", 5))
def r2_learn_stream(spark, sf_dir):
    folder = _scratch(spark, "r2")
    fold = lambda table, batch: posterior.nig_posterior(batch, 5) if table is None else posterior.nig_merge(table, batch)
    micro.learn_stream(_event_stream(spark, sf_dir), f"{folder}/nig", f"{folder}/checkpoint", fold).awaitTermination()
    return _nig_out(micro.read_version(spark, f"{folder}/nig"))


_SUMS = {"a": "u * u", "b": "u * v", "c": "u", "d": "v * v", "e": "v", "g": "t * u", "h": "t * v", "i": "t"}


def _folded_sql(kind: str) -> str:
    """CTEs b0, b1, ...: sums (level, code, arm, n, a .. i) of two-level models of two features and an
    intercept as they are before each batch; targets use the models at the batch's start."""
    total = ", ".join(f"sum({c}) AS {c}" for c in ["n", *_SUMS])
    out = [f"rb AS MATERIALIZED (SELECT *, {_BATCH} AS batch FROM log)", "b0 AS (SELECT 0 AS level, 0 AS code, 0 AS arm, 0 AS n, " + ", ".join(f"0.0::DOUBLE AS {c}" for c in _SUMS) + " WHERE false)"]
    for b in range(BATCHES):
        if kind == "diag":
            w = "SELECT code, arm, g / (1 + a) AS m0, h / (1 + d) AS m1, i / (1 + n) AS m2"
            model = f"{w} FROM b{b} WHERE level = 0"
        else:
            p = "(SELECT code, arm, 1 + a AS a, b, c, 1 + d AS d, e, 1 + n AS f, g, h, i FROM b{} WHERE level = 0)".format(b)
            det = "(a * (d * f - e * e) + b * (c * e - b * f) + c * (b * e - c * d))"
            model = f"SELECT code, arm, ((d * f - e * e) * g + (c * e - b * f) * h + (b * e - c * d) * i) / {det} AS m0, ((c * e - b * f) * g + (a * f - c * c) * h + (b * c - a * e) * i) / {det} AS m1, ((b * e - c * d) * g + (b * c - a * e) * h + (a * d - b * b) * i) / {det} AS m2 FROM {p}"
        out.append(f"p{b} AS MATERIALIZED (SELECT l.arm, l.codes, l.residuals, l.reward, coalesce(m0 * l.residuals[1][1] + m1 * l.residuals[1][2] + m2, 0) AS m FROM rb l LEFT JOIN ({model}) w ON w.code = l.codes[1] AND w.arm = l.arm WHERE l.batch = {b})")
        rows = f"SELECT 0 AS level, codes[1] AS code, arm, residuals[1][1] AS u, residuals[1][2] AS v, reward - 0.5 AS t FROM p{b} UNION ALL SELECT 1, codes[2], arm, residuals[2][1], residuals[2][2], reward - least(greatest(m + 0.5, 0), 1) FROM p{b}"
        new = f"SELECT level, code, arm, count(*) AS n, {', '.join(f'sum({e}) AS {c}' for c, e in _SUMS.items())} FROM ({rows}) GROUP BY level, code, arm"
        out.append(f"b{b + 1} AS MATERIALIZED (SELECT level, code, arm, {total} FROM (SELECT * FROM b{b} UNION ALL {new}) GROUP BY level, code, arm)")
    return ", ".join(out)


def _order_stream(spark, sf_dir) -> DataFrame:
    return _stream(spark, _with_batch(_order_log(spark, sf_dir).select("row_id", "codes", "residuals", "arm", "reward")))


@query(f"{_ORDER_LOG}, {_folded_sql('diag')} SELECT level, code, arm, n::BIGINT AS n, {', '.join(f'round({e}, 4) + 0.0 AS {c}' for c, e in (('p0', '1 + a'), ('p1', '1 + d'), ('p2', '1.0::DOUBLE + n'), ('f0', 'g'), ('f1', 'h'), ('f2', 'i')))} FROM b{BATCHES}")
def r2_learn_stream_diag(spark, sf_dir):
    folder = _scratch(spark, "r2")
    fold = lambda table, batch: micro.fold_diag(table, batch, LEVELS)
    micro.learn_stream(_order_stream(spark, sf_dir), f"{folder}/diag", f"{folder}/checkpoint", fold).awaitTermination()
    found = micro.read_version(spark, f"{folder}/diag")
    return found.select("level", "code", "arm", "n", *[(F.round(F.get(c, F.lit(j)), 4) + 0.0).alias(f"{name}{j}") for name, c in (("p", "prec"), ("f", "f")) for j in range(3)])


_LINEAR_SUMS = {"a": (0, 0), "b": (0, 1), "c": (0, 2), "d": (1, 1), "e": (1, 2), "g": (0, -1), "h": (1, -1), "i": (2, -1)}


@query(f"{_ORDER_LOG}, {_folded_sql('linear')} " + " UNION ALL ".join(f"SELECT level, code, arm, {i} AS i, {j} AS j, round({c}::DOUBLE, 4) + 0.0 AS v, n::BIGINT AS n FROM b{BATCHES}" for c, (i, j) in {**_LINEAR_SUMS, "n": (2, 2)}.items()))
def r2_learn_stream_linear(spark, sf_dir):
    folder = _scratch(spark, "r2")
    fold = lambda table, batch: micro.fold_linear(table, batch, LEVELS)
    micro.learn_stream(_order_stream(spark, sf_dir), f"{folder}/linear", f"{folder}/checkpoint", fold).awaitTermination()
    return micro.read_version(spark, f"{folder}/linear").select("level", "code", "arm", "i", "j", (F.round("v", 4) + 0.0).alias("v"), "n")


def _promoted_sql() -> str:
    """CTE pe (batch, active, shadow, promoted): errors and promotions of three batches of rounds."""
    out = [
        f"rn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {noise.uniform_sql('row_id', 2)}, row_id) AS round, (SELECT count(*) FROM log) AS total FROM log)",
        f"rb AS MATERIALIZED (SELECT *, (SELECT min(b) FROM (SELECT unnest(range({BATCHES})) AS b) WHERE round <= (b + 1) * total // {BATCHES}) AS batch FROM rn)",
        "k0 AS (SELECT 0 AS level, 0 AS code, 0 AS arm, 0 AS n, 0.0::DOUBLE AS f, 0.0::DOUBLE AS theta WHERE false)",
    ]
    for b in range(BATCHES):
        out.append(f"x{b} AS MATERIALIZED (SELECT l.*, coalesce(t0.theta, 0) AS h0, coalesce(t1.theta, 0) AS h1 FROM rb l LEFT JOIN k{b} t0 ON t0.level = 0 AND t0.code = l.codes[1] AND t0.arm = l.arm LEFT JOIN k{b} t1 ON t1.level = 1 AND t1.code = l.codes[2] AND t1.arm = l.arm WHERE batch = {b})")
        new = f"SELECT 0 AS level, codes[1] AS code, arm, count(*) AS n, sum(reward - 0.5) AS f FROM x{b} GROUP BY 2, 3 UNION ALL SELECT 1, codes[2], arm, count(*), sum(reward - least(greatest(h0 + 0.5, 0), 1)) FROM x{b} GROUP BY 2, 3"
        out.append(f"k{b + 1} AS MATERIALIZED (SELECT level, code, arm, sum(n) AS n, sum(f) AS f, sum(f) / (sum(n) + 1) AS theta FROM (SELECT level, code, arm, n, f FROM k{b} UNION ALL {new}) GROUP BY 1, 2, 3)")
    rows = " UNION ALL ".join(f"SELECT * FROM x{b}" for b in range(BATCHES))
    out.append(f"xs AS MATERIALIZED (SELECT batch, round, total, (reward - least(greatest(h0 + 0.5, 0), 1)) ** 2 AS e1, (reward - least(greatest(h0 + 0.5 * h1 + 0.5, 0), 1)) ** 2 AS e2 FROM ({rows}))")
    test = "SELECT coalesce(sum(e1 - e2) > 0 AND -(sum(e1 - e2) * sum(e1 - e2)) / (2 * var_pop(e1 - e2) * count(*) + 2 * max(abs(e1 - e2)) * sum(e1 - e2) / 3) < ln({}), false) AS won FROM xs WHERE round <= {} AND round > {} - total // 4"
    out += [f"w1 AS ({test.format(0.9, 'total // 2', 'total // 2')})", f"w2 AS ({test.format(0.9, 'total', 'total')})"]
    out.append("pe AS (SELECT batch, CASE WHEN w1.won AND round > total // 2 THEN e2 ELSE e1 END AS active, e2 AS shadow, CASE WHEN w1.won AND round = total // 2 THEN round WHEN NOT w1.won AND w2.won AND round = total THEN round END AS promoted FROM xs, w1, w2)")
    return ", ".join(out)


@query(f"{_CODED_LOG}, {_promoted_sql()} SELECT batch::BIGINT AS batch_id, count(*) AS n, {s6('sum(active)')} AS active, {s6('sum(shadow)')} AS shadow, max(promoted) AS promoted FROM pe GROUP BY batch")
def r3_promote_stream(spark, sf_dir):
    """Errors of every batch, and the round of its promotion if there is one."""
    e = durable(inputs.embeddings(spark, sf_dir))
    book = inputs.codebook(e)
    folder = _scratch(spark, "r3")
    log = durable(prepare.shuffle_rounds(inputs.logged(e), 2).select("row_id", "round", "x", "arm", "reward"))
    n = log.count()
    batch = sum(((F.col("round") > (b + 1) * n // BATCHES).cast("int") for b in range(BATCHES - 1)), F.lit(0))
    micro.promote_stream(_stream(spark, log.withColumn("batch", batch)), book, folder, f"{folder}/checkpoint", [(n // 2, 0.9), (n, 0.9)], n // 4, LEVELS, ARMS).awaitTermination()
    errors = spark.read.schema("round long, sq_err_active double, sq_err_shadow double, batch_id long").parquet(f"{folder}/errors")
    promoted = spark.read.schema("t long, old_depth int, new_depth int, batch_id long").parquet(f"{folder}/promotions")
    sums = errors.groupBy("batch_id").agg(F.count("*").alias("n"), r6(F.sum("sq_err_active")).alias("active"), r6(F.sum("sq_err_shadow")).alias("shadow"))
    return sums.join(promoted.groupBy("batch_id").agg(F.max("t").alias("promoted")), "batch_id", "left")


@query(f"WITH {EVT} SELECT arm, count(*) AS n, {s6('sum(reward)')} AS s, {s6('sum(reward * reward)')} AS ss FROM evt GROUP BY arm")
def r4_running_counters(spark, sf_dir):
    name = f"arbora_r4_{uuid4().hex}"
    running = micro.running_counters(_event_stream(spark, sf_dir))
    running.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("arm", "n", r6("s").alias("s"), r6("ss").alias("ss"))


__all__ = ["ORACLE", "QUERIES", "flagship"]
