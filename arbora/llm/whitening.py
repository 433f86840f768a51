"""Embedding whitening by polarisation: covariances from variances of dimensions and of pair sums.

1. Each entry c becomes the whole number floor(64 * c) + OFFSET. The fit list is each distinct vector
   of them once, made by one exchange and kept as a table.
2. Tasks add up the fit list's entries: the number n of vectors and the sum S of each dimension.
3. Tasks add up the squares of the centred numbers n * x - S for every dimension, and of their sums for
   every pair of dimensions, in whole numbers. As (a + b)**2 = a**2 + b**2 + 2ab, half the difference of
   the variances of a sum and of its parts is the covariance: d * (d + 1) / 2 numbers reach the driver,
   however many vectors there are.
4. The covariance matrix is exact before it is turned to doubles; its eigenvectors are the components.
   A last pass over the fit list measures how far the whitened vectors are from uncorrelated.

Squares are added in 64 bits by two limbs where a bound of the data proves that they fit, and in
numbers of any length beyond; both are exact.

Defined results: a vector that is null or empty, or holds a null or non-finite entry, gives no row; nor
does one of another length than the fit list's commonest (the shorter, of equally common ones), or with
an entry of LARGEST or more. A component without variance (fewer distinct vectors than components) has
null `whitened` and is left out of `identity_error`. A deviation beyond 64 bits is null. Repeated rows
are fitted once and written as often as they come; other columns are kept by `transform`, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.arrow import matrix

from .common import Scratch, column, free_name, prepare

#: Steps of one unit, and what is added so that usual entries are positive.
STEPS, OFFSET = 64, 1_000_000
#: Entries of a vector are below this in absolute value.
LARGEST = 2.0**40
#: Components that are made, at most.
COMPONENTS = 16
#: Numbers of one block of pair sums.
BLOCK = 1 << 20
_LIMB = 20
_MANY = pa.decimal128(38, 0)


def whole(vector: Column) -> Column:
    """The vector in whole numbers; null where it takes no part."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    return F.when(usable, F.transform(vector, lambda v: F.floor(v.cast("double") * STEPS) + OFFSET))


def _rows(b: pa.RecordBatch, at: int = 0) -> np.ndarray:
    """Vectors of a batch without nulls as whole numbers."""
    x = b.column(at)
    return x.flatten().to_numpy().reshape(len(x), -1)


def _adds(fit: DataFrame, each: Callable[[np.ndarray], list], names: list[str]) -> list[dict[str, int]]:
    """Totals over the fit list of `each`, which gives lists of whole numbers for a block of vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[int]] = []
        for b in batches:
            if b.num_rows:
                new = each(_rows(b))
                held = [[p + q for p, q in zip(a, c, strict=True)] for a, c in zip(held, new, strict=True)] if held else new
        if held:
            n = len(held[0])
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), *[pa.array([Decimal(v) for v in a], _MANY) for a in held]], names=["i", *names])

    parts = fit.mapInArrow(partial, ", ".join(["i int", *(f"{c} decimal(38,0)" for c in names)]))
    rows = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()
    return [{c: int(r[c]) for c in names} for r in rows]


def _exact_sums(z: np.ndarray, largest: int) -> list[int]:
    """Sums of squares of each column, exactly; `largest` bounds the entries."""
    if largest < 1 << 26:  # squares of up to 2**11 rows fit
        return [sum(int(v) for v in c) for c in zip(*[(z[i : i + 2048] ** 2).sum(axis=0) for i in range(0, len(z), 2048)], strict=True)]
    if largest < 1 << 45:
        out = [0] * z.shape[1]
        for i in range(0, len(z), 2048):
            high, low = z[i : i + 2048] >> _LIMB, z[i : i + 2048] & ((1 << _LIMB) - 1)
            parts = [(high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0)]
            out = [o + (int(a) << 2 * _LIMB) + (int(b) << _LIMB + 1) + int(c) for o, a, b, c in zip(out, *parts, strict=True)]
        return out
    return [sum(int(v) ** 2 for v in c) for c in z.T]


def _centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - sums as 64-bit numbers where they fit, else as Python's."""
    if largest < 1 << 62:
        # n * (x - a) - (sums - n * a) keeps every step small
        a = np.array([s // n for s in sums], dtype=np.int64)
        return n * (x - a) - np.array([s - n * (s // n) for s in sums], dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


@dataclass
class Whitener:
    """A fitted whitening: n vectors with sums of dimensions, components as rows by falling eigenvalue."""

    n: int
    sums: list[int]
    largest: int
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace if self.trace > 0 else 0.0 for e in self.eigenvalues]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates of n * x - S; a component without variance gives NaN."""
        # a component of rounding noise has no variance
        real = self.eigenvalues > 1e-12 * max(self.trace, 0.0)
        scale = np.where(real, 1 / np.sqrt(np.where(real, self.eigenvalues, 1.0)), np.nan)
        return (centred.astype(np.float64) / self.n) @ (self.components * scale[:, None]).T


def covariance(n: int, d: int, squares: list[int]) -> np.ndarray:
    """The covariance matrix by polarisation from the squares of n * x - S: of the dimensions, then of
    the sums of every pair in the order of `numpy.triu_indices(d, 1)`."""
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = squares[i] / n**3
    for i, j, both in zip(*np.triu_indices(d, 1), squares[d:], strict=True):
        out[i, j] = out[j, i] = (both - squares[i] - squares[j]) / (2 * n**3)
    return out


def fit(vectors: DataFrame, x_col: str, components: int = COMPONENTS) -> Whitener | None:
    """The whitening of all distinct vectors of a column, or None if there is none."""
    spark = vectors.sparkSession
    prepare(spark)
    with Scratch(spark, "whitening") as keep:
        read = vectors.select(whole(column(x_col)).alias("x")).where("x is not null")
        kept = keep(read.distinct())
        sizes = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        if not sizes:
            return None
        d, n = sizes[0]
        fit_list = kept.where(F.size("x") == d)
        sums = [r["s"] for r in _adds(fit_list, lambda x: [x.sum(axis=0).tolist()], ["s"])]
        low, high = fit_list.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
        largest = n * (high - low)
        first, second = np.triu_indices(d, 1)
        width = max(1, BLOCK // max(d, 1))

        def squares(x: np.ndarray) -> list[list[int]]:
            y = _centred(x, n, sums, largest)
            out = _exact_sums(y, largest)
            for i in range(0, len(first), width):
                pairs = [0] * len(first[i : i + width])
                for r in range(0, len(y), 512):
                    z = y[r : r + 512, first[i : i + width]] + y[r : r + 512, second[i : i + width]]
                    pairs = [p + q for p, q in zip(pairs, _exact_sums(z, 2 * largest), strict=True)]
                out += pairs
            return [out]

        v = covariance(n, d, [r["q"] for r in _adds(fit_list, squares, ["q"])])
        values, vectors_ = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        model = Whitener(n, sums, largest, np.maximum(values[order], 0.0), vectors_.T[order], float(np.trace(v)))
        model.identity_error = _identity_error(fit_list, model)
        return model


def _identity_error(fit_list: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(model.eigenvalues)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, outer = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = model.project(_centred(_rows(b), model.n, model.sums, model.largest))
                total, outer = total + w.sum(axis=0), outer + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * (k + 1)), pa.int32()), pa.array(np.concatenate([total, outer.ravel()]))], names=["i", "v"])

    sums = np.array([r["v"] for r in fit_list.mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
    mean = sums[:k] / model.n
    off = np.abs(sums[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k))
    return float(np.nanmax(off)) if np.isfinite(off).any() else 0.0


def transform(rows: DataFrame, model: Whitener | None, x_col: str, out_col: str) -> DataFrame:
    """`rows` whose vector takes part, with a struct (deviation, whitened): the whole sum of squares of
    n * x - S, and the coordinates on the components, null for one without variance."""
    prepare(rows.sparkSession)
    kind = "struct<deviation:bigint,whitened:array<double>>"
    if model is None:
        return rows.where("false").withColumn(out_col, F.lit(None).cast(kind))
    d = len(model.sums)

    @F.arrow_udf(kind)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = _rows(pa.RecordBatch.from_arrays([b], names=["x"])) if len(b) else np.zeros((0, d), dtype=np.int64)
            y = _centred(x, model.n, model.sums, max(model.largest, model.n * int(max([0, *(abs(x - np.array([s // model.n for s in model.sums])).max(axis=1))]))))
            largest = int(abs(y).max()) if y.size else 0
            far = (y * y).sum(axis=1).tolist() if d * largest * largest < 1 << 63 else [int(v) if v < 1 << 63 else None for v in (y.astype(object) ** 2).sum(axis=1)]
            w = model.project(y)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(1, w.shape[1]), dtype=np.int32)), pa.array(w.ravel(), mask=np.isnan(w.ravel())))
            yield pa.StructArray.from_arrays([pa.array(far, pa.int64()), lists], names=["deviation", "whitened"])

    x = free_name(rows, "x_whole")
    usable = rows.withColumn(x, whole(column(x_col))).where(F.size(column(x)) == d)
    return usable.withColumn(out_col, apply(column(x))).drop(x)
