"""Tables that the registered queries start from, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import noise
from arbora.operators import quantize
from arbora.sources.tables import read_contexts

ARMS = 10
LEVELS, NBITS, ITERATIONS = 2, 2, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, x of 64, label 0..9)."""
    return read_contexts(spark, f"{sf_dir}/embeddings.parquet", "embedding", "label", "vec_id")


EMB = "ctx AS MATERIALIZED (SELECT vec_id AS row_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label FROM embeddings)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, x of 2, label 0..4): price and day of the year; the label is the priority."""
    o = table(spark, sf_dir, "orders")
    x = F.array(F.col("o_totalprice") / 1e5, F.dayofyear("o_orderdate") / F.lit(366.0))
    return o.select(F.col("o_orderkey").alias("row_id"), x.alias("x"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"))


ORD = "ctx AS MATERIALIZED (SELECT o_orderkey AS row_id, [o_totalprice / 1e5, dayofyear(o_orderdate) / 366.0::DOUBLE] AS x, substr(o_orderpriority, 1, 1)::INT - 1 AS label FROM orders)"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x of 4, label): quantities and prices; the label is the rank of the return flag."""
    li = table(spark, sf_dir, "lineitem")
    x = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.select(x.alias("x"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"))


LIN = "ctx AS MATERIALIZED (SELECT [l_quantity, l_extendedprice, l_discount, l_tax] AS x, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, round, user_id, arm, reward): logged decisions in order of time."""
    e = table(spark, sf_dir, "events")
    arm = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    return e.select(F.col("event_id").alias("row_id"), "user_id", "ts", arm.alias("arm"), F.least(F.col("value") / 100, F.lit(1.0)).alias("reward"))


EVT = "evt AS MATERIALIZED (SELECT event_id AS row_id, user_id, ts, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS arm, least(value / 100, 1.0::DOUBLE) AS reward FROM events)"


def logged(contexts: DataFrame, n_arms: int = ARMS, seed: int = 42) -> DataFrame:
    """Contexts with a uniform arm and the reward that the label gives it."""
    return contexts.withColumn("arm", F.floor(noise.uniform("row_id", seed) * n_arms).cast("int")).withColumn("reward", (F.col("arm") == F.col("label")).cast("double"))


def log_sql(n_arms: int = ARMS, seed: int = 42, source: str = "ctx", name: str = "log") -> str:
    u = noise.uniform_sql("row_id", seed)
    return f"{name} AS MATERIALIZED (SELECT *, (arm = label)::INT::DOUBLE AS reward FROM (SELECT *, floor({u} * {n_arms})::INT AS arm FROM {source}))"


def codebook(contexts: DataFrame, levels: int = LEVELS, nbits: int = NBITS, iterations: int = ITERATIONS) -> quantize.Codebook:
    return quantize.train_codebook(contexts, levels, nbits, iterations)


def encoded(contexts: DataFrame, residuals: bool = True) -> DataFrame:
    return quantize.encode(contexts, codebook(contexts), residuals=residuals)


def book_sql(levels: int = LEVELS, nbits: int = NBITS, iterations: int = ITERATIONS) -> str:
    """CTEs that train the same codebook on ctx: book (level, code, c) and coded (row_id, label, codes,
    residuals)."""
    b = 1 << nbits
    out = ["r0 AS MATERIALIZED (SELECT row_id, label, x AS r FROM ctx)"]

    def assign(level: int, book: str) -> str:
        return f"SELECT row_id, min(struct_pack(d := round(list_distance(r, c) ** 2, 9), c := code)).c AS code FROM r{level}, {book} GROUP BY row_id"

    for level in range(levels):
        # the first level's lowest ids give the starting rows, at every level
        out.append(f"c{level}_0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY row_id) - 1)::INT AS code, r AS c FROM (SELECT row_id, r FROM r{level} ORDER BY row_id LIMIT {b}))")
        for t in range(iterations):
            out.append(f"a{level}_{t} AS MATERIALIZED ({assign(level, f'c{level}_{t}')})")
            out.append(
                f"c{level}_{t + 1} AS MATERIALIZED (SELECT o.code, coalesce(n.c, o.c) AS c FROM c{level}_{t} o LEFT JOIN (SELECT code, list(m ORDER BY i) AS c FROM "
                f"(SELECT code, i, avg(v) AS m FROM (SELECT a.code, generate_subscripts(r, 1) AS i, unnest(r) AS v FROM r{level} JOIN a{level}_{t} a USING (row_id)) GROUP BY code, i) GROUP BY code) n USING (code))"
            )
        out.append(f"e{level} AS MATERIALIZED ({assign(level, f'c{level}_{iterations}')})")
        out.append(f"r{level + 1} AS MATERIALIZED (SELECT row_id, label, list_transform(list_zip(r, c), lambda z: z[1] - z[2]) AS r FROM r{level} JOIN e{level} USING (row_id) JOIN c{level}_{iterations} USING (code))")
    out.append("book AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {level} AS level, code, c FROM c{level}_{iterations}" for level in range(levels)) + ")")
    joins = " ".join(f"JOIN e{level} USING (row_id)" for level in range(levels)) + " " + " ".join(f"JOIN r{level} USING (row_id)" for level in range(1, levels))
    codes = ", ".join(f"e{level}.code" for level in range(levels))
    rest = ", ".join(f"r{level}.r" for level in range(levels))
    out.append(f"coded AS MATERIALIZED (SELECT row_id, r0.label, r0.r AS x, [{codes}] AS codes, [{rest}] AS residuals FROM r0 {joins})")
    return ",\n".join(out)


def encode_sql(source: str, levels: int = LEVELS) -> str:
    """CTE `judged` (row_id, label, codes): rows of `source` by the codebook that `book_sql` trained."""
    out = [f"j0 AS MATERIALIZED (SELECT row_id, label, x AS r, [] AS codes FROM {source})"]
    for level in range(levels):
        near = f"SELECT row_id, min(struct_pack(d := round(list_distance(r, c) ** 2, 9), c := code)).c AS code FROM j{level}, (SELECT * FROM book WHERE level = {level}) GROUP BY row_id"
        out.append(f"j{level + 1} AS MATERIALIZED (SELECT row_id, label, list_transform(list_zip(r, c), lambda z: z[1] - z[2]) AS r, list_append(codes, code) AS codes FROM j{level} JOIN ({near}) USING (row_id) JOIN (SELECT code, c FROM book WHERE level = {level}) USING (code))")
    return ", ".join([*out, f"judged AS MATERIALIZED (SELECT row_id, label, codes FROM j{levels})"])


def additive_sql(arms: int = ARMS, rounds: int = 60, depth: int = 2) -> str:
    """CTEs t0 (code, arm, t) and t1: the additive least-squares model of the arm indicators on the codes
    of `coded`, by fitting the levels in turn until nothing moves."""
    out = [
        f"cells AS MATERIALIZED (SELECT codes[1] AS c0, {'codes[2]' if depth > 1 else '0'} AS c1, arm, count(*) AS n, sum((label = arm)::INT) AS y FROM coded, (SELECT unnest(range({arms}))::INT AS arm) GROUP BY 1, 2, 3)",
        "v0 AS (SELECT DISTINCT c1, arm, 0.0::DOUBLE AS t FROM cells)",
    ]
    for k in range(rounds if depth > 1 else 1):
        out.append(f"u{k} AS MATERIALIZED (SELECT c0, cells.arm, sum(y - n * t) / sum(n) AS t FROM cells JOIN v{k} v ON v.c1 = cells.c1 AND v.arm = cells.arm GROUP BY 1, 2)")
        step = f"sum(y - n * t) / sum(n) AS t FROM cells JOIN u{k} u ON u.c0 = cells.c0 AND u.arm = cells.arm" if depth > 1 else "0.0::DOUBLE AS t FROM cells"
        out.append(f"v{k + 1} AS MATERIALIZED (SELECT c1, cells.arm, {step} GROUP BY 1, 2)")
    last = rounds if depth > 1 else 1
    return ", ".join([*out, f"t0 AS (SELECT c0 AS code, arm, t FROM u{last - 1})", f"t1 AS (SELECT c1 AS code, arm, t FROM v{last})"])
