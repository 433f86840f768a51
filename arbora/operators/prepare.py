"""Feature preparation, splits, label rules and load-test contexts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions import noise
from arbora.functions.arrow import matrix
from arbora.functions.vectors import doubles, one_hot


def column_moments(df: DataFrame, x_col: str = "x") -> DataFrame:
    """(i, n, mean, sd) of every position of the vector, population standard deviation."""
    each = df.select(F.posexplode(x_col).alias("i", "v"))
    return each.groupBy("i").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def standardize(df: DataFrame, guard: str = "unit", x_col: str = "x") -> DataFrame:
    """(x - mean) / std at every position. `unit`: a deviation below 1e-8 counts as 1; `eps`: 1e-8 is
    added. The moments (two numbers a position) come back to the driver and go into the plan."""
    rows = sorted(tuple(r) for r in column_moments(df, x_col).collect())
    mean = F.array(*[F.lit(r[2]) for r in rows]) if rows else F.expr("cast(array() as array<double>)")
    scale = [(1.0 if r[3] < 1e-8 else r[3]) if guard == "unit" else r[3] + 1e-8 for r in rows]
    over = F.array(*[F.lit(s) for s in scale]) if rows else mean
    return df.withColumn(x_col, F.zip_with(F.zip_with(doubles(x_col), mean, lambda v, m: v - m), over, lambda v, s: v / s))


def one_hot_categories(df: DataFrame, columns: Sequence[str], out_col: str = "encoded") -> DataFrame:
    """Integer categories as indicators, one after another; one with at most two values stays one number."""
    top = df.agg(*[F.max(c).alias(c) for c in columns]).first()
    parts = []
    for c in columns:
        k = (top[c] if top[c] is not None else 0) + 1
        if k <= 2:
            parts.append(F.array(F.col(c).cast("double")))
        else:
            parts.append(one_hot(F.col(c), k))
    return df.withColumn(out_col, F.concat(*parts))


def expand_arms(df: DataFrame, n_arms: int) -> DataFrame:
    """One row per context and arm."""
    return df.withColumn("arm", F.explode(F.sequence(F.lit(0), F.lit(n_arms - 1))))


def split_holdout(df: DataFrame, n: int, seed: int, id_col: str = "row_id") -> DataFrame:
    """`df` with a column `holdout`: exactly min(n, half) rows, those of the least keyed hash.

    The hash of the last row in is found by a top-n over ids only; the rows themselves are compared
    with that bound and never sorted.
    """
    u = noise.uniform(id_col, seed)
    total = df.count()
    n = min(n, total // 2)
    if n <= 0:
        return df.withColumn("holdout", F.lit(False))
    last = df.select(u.alias("u"), F.col(id_col).alias("r")).orderBy("u", "r").limit(n).agg(F.max(F.struct("u", "r")).alias("m")).first()["m"]
    return df.withColumn("holdout", (u < F.lit(last["u"])) | ((u == F.lit(last["u"])) & (F.col(id_col) <= F.lit(last["r"]))))


def split_holdout_share(df: DataFrame, share: float, seed: int, id_col: str = "row_id") -> DataFrame:
    """Holdout of about a share of the rows without any shuffle, for tables too large to rank."""
    return df.withColumn("holdout", noise.uniform(id_col, seed) < share)


def shuffle_rounds(df: DataFrame, seed: int, run_cols: Sequence[str] = (), id_col: str = "row_id", buckets: int = 64) -> DataFrame:
    """`df` with `round` 1 .. T within each run, in the order of a keyed hash.

    A run's rows are cut into `buckets` ranges of the hash; each is numbered on its own and shifted
    by the number of rows in the ranges before it, so a long run is not sorted in one task.
    """
    runs = [F.col(c) for c in run_cols]
    keyed = df.withColumn("_u", noise.uniform(*runs, id_col, seed)).withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    sizes = keyed.groupBy(*run_cols, "_b").count()
    before = Window.partitionBy(*run_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if run_cols else Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(*run_cols, "_b").orderBy("_u", id_col)
    return keyed.join(offsets, [*run_cols, "_b"]).withColumn("round", (F.row_number().over(inside) + F.col("_off")).cast("bigint")).drop("_u", "_b", "_off")


def number_rounds(df: DataFrame, run_cols: Sequence[str], order_cols: Sequence[str], slice_col: Column, round_col: str = "round") -> DataFrame:
    """`df` with the round of each row, 1 .. T within its run in the order of `order_cols`.

    `slice_col` is a coarse part of that order, such as the hour of a time stamp: a run's rows are
    numbered slice by slice and shifted by the rows of earlier slices, so a long run is not sorted in
    one task.
    """
    keyed = df.withColumn("_slice", slice_col)
    before = Window.partitionBy(*run_cols).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(*run_cols, "_slice").count().withColumn("_off", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(*run_cols, "_slice").orderBy(*order_cols)
    return keyed.join(offsets, [*run_cols, "_slice"]).withColumn(round_col, (F.row_number().over(inside) + F.col("_off")).cast("bigint")).drop("_slice", "_off")


def cap_rounds(df: DataFrame, max_rounds: int) -> DataFrame:
    """The first `max_rounds` rounds; 0 keeps all."""
    return df.where(F.col("round") <= max_rounds) if max_rounds else df


def pca_fit_transform(holdout: DataFrame, rows: DataFrame, k: int, x_col: str = "x", out_col: str = "pc") -> tuple[DataFrame, float]:
    """Principal components of the holdout, all rows projected after subtracting the holdout's mean,
    and the share of variance that the components explain."""
    means = [r["mean"] for r in sorted(column_moments(holdout, x_col).collect())]
    centre = F.array(*[F.lit(m) for m in means])
    centred = lambda df: df.withColumn("_v", array_to_vector(F.zip_with(doubles(x_col), centre, lambda v, m: v - m)))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(centred(holdout))
    out = model.transform(centred(rows)).withColumn(out_col, vector_to_array("_pc")).drop("_v", "_pc")
    return out, float(sum(model.explainedVariance.toArray()))


def label_by_linear_argmax(df: DataFrame, weights: Sequence[Sequence[float]], x_col: str = "x", out_col: str = "label") -> DataFrame:
    """Label = arm of the greatest x . w; the lowest arm of equal ones. A null vector has no label."""
    w = np.asarray(weights, dtype=float)

    @F.arrow_udf("int")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            v, there = matrix(x)
            label = np.zeros(len(v), dtype=np.int32)
            if there.any():
                label[there] = np.argmax(v[there] @ w.T, axis=1)
            yield pa.array(label, mask=~there)

    return df.withColumn(out_col, best(doubles(x_col)))


def label_by_tree(df: DataFrame, splits: Sequence[tuple[int, float]], leaf_to_class: Sequence[int], x_col: str = "x", out_col: str = "label") -> DataFrame:
    """Leaf = bits of x[feature] > threshold, the first split highest; class by lookup."""
    leaf: Column = F.lit(0)
    for feature, threshold in splits:
        leaf = leaf * 2 + (F.get(F.col(x_col), F.lit(feature)) > threshold).cast("int")
    return df.withColumn(out_col, F.element_at(F.array(*[F.lit(int(c)) for c in leaf_to_class]), (leaf + 1).cast("int")))


def inject_label_noise(df: DataFrame, rate: float, n_arms: int, seed: int, id_col: str = "row_id", label_col: str = "label") -> DataFrame:
    """A share of labels replaced by uniform arms, which may be the same again."""
    redrawn = F.floor(noise.uniform(id_col, seed, 7) * n_arms).cast("int")
    return df.withColumn(label_col, F.when(noise.uniform(id_col, seed, 3) < rate, redrawn).otherwise(F.col(label_col)))


def cluster_points(rows: DataFrame, d: int, k: int, seed: int, spread: float = 3.0) -> DataFrame:
    """(row_id, x, label) for rows with a row_id: standard normal points around k standard normal centres
    times `spread`; the class is the row_id modulo k."""
    labelled = rows.withColumn("label", F.pmod("row_id", F.lit(k)).cast("int"))
    point = [noise.normal("row_id", seed, j) + spread * noise.normal("label", seed + 1, j) for j in range(d)]
    return labelled.select("row_id", F.array(*point).alias("x"), "label")


def gaussian_clusters(spark: SparkSession, n: int, d: int, k: int, seed: int, spread: float = 3.0) -> DataFrame:
    """n // k rows of each of k classes (see `cluster_points`)."""
    return cluster_points(spark.range(n // k * k).withColumnRenamed("id", "row_id"), d, k, seed, spread)


def linear_weights(d: int, k: int, seed: int) -> np.ndarray:
    """Keyed normal weights (k, d) times 0.3."""
    return np.array([[0.3 * noise.normal_value(seed + 1, a, j) for j in range(d)] for a in range(k)])


def linear_points(rows: DataFrame, d: int, k: int, seed: int) -> DataFrame:
    """(row_id, x, label) for rows with a row_id: standardised normal features, labelled by the arm of
    the greatest score under `linear_weights`."""
    drawn = rows.select("row_id", F.array(*[noise.normal("row_id", seed, j) for j in range(d)]).alias("x"))
    return label_by_linear_argmax(standardize(drawn, "eps"), linear_weights(d, k, seed))


def linear_contexts(spark: SparkSession, n: int, d: int, k: int, seed: int) -> DataFrame:
    """n rows of `linear_points`."""
    return linear_points(spark.range(n).withColumnRenamed("id", "row_id"), d, k, seed)


class TabularRule:
    """What a tabular table is drawn by, all of it keyed by `seed`.

    Of d features half are continuous, in groups of 3 to 5 that share a factor, and the rest binary.
    Labels follow a tree of 3 splits (4 beyond ten features) whose leaves are dealt to the classes in
    turn, in a keyed order.
    """

    def __init__(self, d: int, k: int, seed: int):
        u = lambda *keys: noise.uniform_value(seed, *keys)
        self.seed, self.continuous, self.binary = seed, d // 2, d - d // 2
        self.group: list[int] = []
        while len(self.group) < self.continuous:
            g = self.group[-1] + 1 if self.group else 0
            self.group += [g] * min(3 + int(3 * u("size", g)), self.continuous - len(self.group))
        self.weight = [0.5 + u("weight", j) for j in range(self.continuous)]
        self.frequency = [0.1 + 0.8 * u("frequency", j) for j in range(self.binary)]
        depth = 4 if d > 10 else 3
        order = sorted(range(d), key=lambda j: u("split", j))
        features = [order[i % d] for i in range(depth)]
        self.splits = [(f, u("threshold", i) - 0.5 if f < self.continuous else 0.5) for i, f in enumerate(features)]
        ranked = sorted(range(1 << depth), key=lambda leaf: u("leaf", leaf))
        self.leaf_class = [ranked.index(leaf) % k for leaf in range(1 << depth)]

    def features(self) -> Column:
        """Continuous features before they are standardised, then the binary ones."""
        factor = lambda g: noise.normal("row_id", self.seed, F.lit("factor"), g)
        own = [factor(g) * w + 0.5 * noise.normal("row_id", self.seed, F.lit("own"), j) for j, (g, w) in enumerate(zip(self.group, self.weight, strict=True))]
        flags = [(noise.uniform("row_id", self.seed, F.lit("flag"), j) < f).cast("double") for j, f in enumerate(self.frequency)]
        return F.array(*own, *flags)


def tabular_points(rows: DataFrame, d: int, k: int, seed: int, noise_rate: float = 0.1) -> DataFrame:
    """(row_id, x, label) for rows with a row_id, by a `TabularRule` and a share of label noise. The
    continuous features are standardised."""
    rule = TabularRule(d, k, seed)
    drawn = rows.select("row_id", rule.features().alias("x"))
    moments = {r["i"]: (r["mean"], r["sd"] + 1e-8) for r in column_moments(drawn).collect()}  # d rows
    scaled = [(F.get("x", F.lit(j)) - m) / s for j in range(rule.continuous) for m, s in [moments.get(j, (0.0, 1.0))]]
    x = F.concat(F.array(*scaled).cast("array<double>"), F.slice("x", rule.continuous + 1, d))
    return inject_label_noise(label_by_tree(drawn.withColumn("x", x), rule.splits, rule.leaf_class), noise_rate, k, seed)


def tabular_contexts(spark: SparkSession, n: int, d: int, k: int, seed: int, noise_rate: float = 0.1) -> DataFrame:
    """n rows of `tabular_points`."""
    return tabular_points(spark.range(n).withColumnRenamed("id", "row_id"), d, k, seed, noise_rate)


def synthetic_contexts(spark: SparkSession, kind: str, n: int, d: int, k: int, seed: int) -> DataFrame:
    """Contexts for load tests: 'clusters', 'linear' or 'tabular'."""
    return {"clusters": gaussian_clusters, "linear": linear_contexts, "tabular": tabular_contexts}[kind](spark, n, d, k, seed)

