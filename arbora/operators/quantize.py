"""Residual quantisation: codebooks, codes and residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.arrow import matrix, rows_of
from arbora.functions.vectors import doubles

#: A level's centroids, by code.
Codebook = list[np.ndarray]


def codebook_table(spark: SparkSession, codebook: Codebook) -> DataFrame:
    """(level, code, centroid): levels times 2**nbits rows."""
    rows = [(level, code, c.tolist()) for level, book in enumerate(codebook) for code, c in enumerate(book)]
    return spark.createDataFrame(rows, "level int, code int, centroid array<double>")


def codebook_from_table(table: DataFrame) -> Codebook:
    books: dict[int, list[list[float]]] = {}
    for r in table.orderBy("level", "code").collect():
        books.setdefault(r["level"], []).append(r["centroid"])
    return [np.array(books[level]) for level in sorted(books)]


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Code of the nearest centroid by squared distance at nine places; the lowest of equal ones."""
    d2 = (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)[None]
    return np.argmin(np.round(d2, 9), axis=1)


def _stack(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float)


def _walk(x: np.ndarray, codebook: Codebook) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codes, and the residual before every level."""
    codes, residuals, r = [], [], x
    for book in codebook:
        residuals.append(r)
        codes.append(nearest(r, book))
        r = r - book[codes[-1]]
    return codes, [*residuals, r]


def train_codebook(df: DataFrame, levels: int = 4, nbits: int = 4, iterations: int = 10, x_col: str = "x", id_col: str = "row_id") -> Codebook:
    """Greedy level-by-level k-means on the residuals that earlier levels leave.

    Starts from the 2**nbits rows of the lowest ids. An empty code keeps its centroid. Each iteration
    is one pass: tasks add up sums and counts of their rows by code, and 2**nbits sums come back. Rows
    are neither shuffled nor gathered; `df` is worth caching. Null vectors are left out.
    """
    b = 1 << nbits
    first = df.select(F.col(id_col), doubles(x_col).alias("x")).where("x is not null").orderBy(id_col).limit(b).collect()
    if not first:
        raise ValueError("no rows to train on")
    start = np.array([r["x"] for r in first])
    start = np.concatenate([start, np.tile(start[-1:], (b - len(start), 1))])
    done: Codebook = []
    for _ in range(levels):
        book = _walk(start, done)[1][-1].copy()
        for _ in range(iterations):
            sums, counts = _sums(df, x_col, [*done, book])
            seen = counts > 0
            book = book.copy()
            book[seen] = sums[seen] / counts[seen, None]
        done.append(book)
    return done


def _sums(df: DataFrame, x_col: str, codebook: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the last level's residuals by code."""
    *before, book = codebook
    b, d = book.shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((b, d)), np.zeros(b, dtype=np.int64)
        for pdf in batches:
            if len(pdf):
                r = _walk(_stack(pdf["x"]), before)[1][-1]
                code = nearest(r, book)
                np.add.at(total, code, r)
                n += np.bincount(code, minlength=b)
        seen = np.flatnonzero(n)
        yield pd.DataFrame({"code": seen.astype("int32"), "n": n[seen], "s": pd.Series(total[seen].tolist(), dtype=object)})

    parts = df.select(doubles(x_col).alias("x")).where("x is not null").mapInPandas(add, "code int, n long, s array<double>")
    each = parts.select("code", "n", F.posexplode("s").alias("i", "v")).groupBy("code", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    sums, counts = np.zeros((b, d)), np.zeros(b, dtype=np.int64)
    for r in each.collect():
        sums[r["code"], r["i"]] = r["v"]
        counts[r["code"]] = r["n"]
    return sums, counts


def encode(df: DataFrame, codebook: Codebook, x_col: str = "x", residuals: bool = False) -> DataFrame:
    """`df` with `codes`, and with `residuals` (the vector before every level) if asked: one matrix
    product a level and batch, no shuffle. The codebook goes along with the function. A null vector has
    null codes and residuals."""
    levels, d = len(codebook), codebook[0].shape[1] if codebook else 0

    def walked(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, there = matrix(x)
        codes, left = np.zeros((len(v), levels), dtype=np.int32), np.zeros((len(v), levels, d if residuals else 0))
        if there.any():
            found, rest = _walk(v[there], codebook)
            codes[there] = np.stack(found, axis=1)
            if residuals:
                left[there] = np.stack(rest[:-1], axis=1)
        return codes, left, there

    if not residuals:

        @F.arrow_udf("array<int>")
        def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for x in batches:
                codes, _, there = walked(x)
                yield rows_of(codes, there)

        return df.withColumn("codes", look(doubles(x_col)))

    @F.arrow_udf("struct<codes:array<int>,residuals:array<array<double>>>")
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            codes, left, there = walked(x)
            ends = pa.array(np.arange(0, len(left) * levels + 1, levels, dtype=np.int32))
            lists = pa.ListArray.from_arrays(ends, rows_of(left.reshape(-1, d)), mask=None if there.all() else pa.array(~there))
            yield pa.StructArray.from_arrays([rows_of(codes, there), lists], names=["codes", "residuals"])

    return df.withColumn("_rq", walk(doubles(x_col))).withColumns({"codes": F.col("_rq.codes"), "residuals": F.col("_rq.residuals")}).drop("_rq")


def residual_features(df: DataFrame, table: DataFrame, id_col: str = "row_id", x_col: str = "x") -> DataFrame:
    """(id, level, r): x minus the centroids of all lower levels, from codes and a codebook table.

    Long form, by a join on (level, code); `encode(..., residuals=True)` gives the same in one pass.
    """
    long = df.select(id_col, doubles(x_col).alias("x"), F.posexplode("codes").alias("level", "code"))
    joined = long.join(table, ["level", "code"]).groupBy(id_col).agg(F.first("x").alias("x"), F.sort_array(F.collect_list(F.struct("level", "centroid"))).alias("path"))
    levels = F.sequence(F.lit(0), F.size("path") - 1)
    at = joined.select(id_col, "x", "path", F.explode(levels).alias("level"))
    minus = F.aggregate(F.slice("path", F.lit(1), F.col("level")), F.col("x"), lambda r, p: F.zip_with(r, p["centroid"], lambda a, c: a - c))
    return at.select(id_col, "level", minus.alias("r"))


def code_histogram(encoded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(level, code[, by], n): how many rows have each code."""
    by = by or []
    return encoded.select(*by, F.posexplode("codes").alias("level", "code")).groupBy("level", "code", *by).agg(F.count("*").alias("n"))
