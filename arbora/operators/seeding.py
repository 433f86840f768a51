"""Codebooks from oversampled seeds: fewer passes than from arbitrary rows, and no empty cells.

Level by level, on a table of the residuals that the level before left:

1. Seeds are oversampled as in k-means||: starting from the residuals' centre, each round keeps a row
   with probability OVERSAMPLE * 2**nbits * d2 / cost, by a keyed draw (d2: to the nearest candidate so
   far; cost: the sum of d2 to the centre). About as many rows as that come back, however many there are.
2. One pass counts and averages the rows nearest to each candidate; the weighted candidates are then
   clustered on their own, started from the heaviest and the ones that add most cost.
3. A few passes of k-means follow. A code that loses all rows takes the farthest row of the cell of
   greatest cost.

Sums by code are all that tasks exchange. Draws depend on ids, so partitions change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions import noise
from arbora.functions.arrow import matrix, rows_of
from arbora.functions.lineage import Scratch
from arbora.functions.vectors import doubles
from arbora.operators.quantize import Codebook

#: Rows that a round keeps for each code, about, and rounds.
OVERSAMPLE, ROUNDS = 8, 2
#: Passes over the candidates alone, and starts that are tried.
CANDIDATE_PASSES, TRIES = 30, 8


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances at nine places."""
    return np.round(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0), 9)


def _moments(rows: DataFrame) -> tuple[np.ndarray, float]:
    """The rows' mean and their cost around it."""
    each = rows.select(F.posexplode("r").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("c"))
    found = sorted((r["i"], r["m"], r["c"]) for r in each.collect())  # one a position
    return np.array([m for _, m, _ in found]), float(sum(c for _, _, c in found))


def _sampled(rows: DataFrame, centres: np.ndarray, cost: float, wanted: float, keys: tuple[int, ...]) -> np.ndarray:
    """Rows that the draw keeps, by id."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("double")
    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array(distances(matrix(x)[0], shared.value).min(axis=1) if len(x) else np.zeros(0))

    kept = rows.withColumn("d2", near("r")).where(noise.uniform("id", *keys) < F.col("d2") * (wanted / cost))
    found = sorted(((r["id"], r["r"]) for r in kept.select("id", "r").collect()), key=lambda p: p[0])  # `wanted`, about
    return np.array([r for _, r in found]).reshape(len(found), centres.shape[1])


def _pass(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """By nearest centre: numbers of rows, sums, costs, and the farthest row (the least id of equally far)."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    k, d = centres.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, best = np.zeros((k, d + 2)), {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))[0]
            far = distances(x, shared.value)
            code = far.argmin(axis=1)
            far = far[np.arange(len(x)), code]
            np.add.at(total, code, np.column_stack([x, np.ones(len(x)), far]))
            order = np.lexsort((ids, -far, code))
            for at in order[np.unique(code[order], return_index=True)[1]]:
                key = (float(far[at]), -int(ids[at]), x[at])
                if int(code[at]) not in best or key[:2] > best[int(code[at])][:2]:
                    best[int(code[at])] = key
        seen = sorted(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), rows_of(total[seen]) if seen else pa.array([], pa.list_(pa.float64())), pa.array([best[c][0] for c in seen], pa.float64()), pa.array([best[c][1] for c in seen], pa.int64()), pa.array([best[c][2].tolist() for c in seen], pa.list_(pa.float64()))],
            names=["code", "s", "far", "id", "x"],
        )

    parts = rows.mapInArrow(partial, "code int, s array<double>, far double, id long, x array<double>")
    each = parts.select("code", F.struct("far", "id", "x").alias("row"), F.posexplode("s").alias("i", "v"))
    # the farthest row travels with one of the sums only
    each = each.select("code", "i", "v", F.when(F.col("i") == 0, F.col("row")).alias("row"))
    total, farthest = np.zeros((k, d + 2)), {}
    for r in each.groupBy("code", "i").agg(F.sum("v").alias("v"), F.max("row").alias("row")).collect():  # one a code and position
        total[r["code"], r["i"]] = r["v"]
        if r["row"] is not None:
            farthest[r["code"]] = np.array(r["row"]["x"])
    return total[:, d], total[:, :d], total[:, d + 1], farthest


def cluster_candidates(points: np.ndarray, weights: np.ndarray, k: int, passes: int = CANDIDATE_PASSES, tries: int = TRIES, keys: tuple[int, ...] = (0, 0)) -> np.ndarray:
    """k centres of weighted points: weighted k-means from the heaviest point and others that are drawn
    with probability weight * d2, of `tries` keyed draws the one of least cost; the first of equal ones."""
    best, least = points[:1].repeat(k, axis=0), np.inf
    for t in range(tries):
        chosen = [int(np.argmax(weights))]
        while len(chosen) < k:
            share = np.cumsum(weights * distances(points, points[chosen]).min(axis=1))
            chosen.append(min(int(np.searchsorted(share, noise.uniform_value(*keys, t, len(chosen)) * share[-1])), len(points) - 1))
        centres = points[chosen].copy()
        for _ in range(passes):
            code = distances(points, centres).argmin(axis=1)
            for c in range(k):
                own = code == c
                if weights[own].sum() > 0:
                    centres[c] = (weights[own, None] * points[own]).sum(axis=0) / weights[own].sum()
        cost = float((weights * distances(points, centres).min(axis=1)).sum())
        if cost < least:
            best, least = centres, cost
    return best


def train(df: DataFrame, levels: int = 4, nbits: int = 4, iterations: int = 5, seed: int = 0, rounds: int = ROUNDS, candidate_passes: int = CANDIDATE_PASSES, x_col: str = "x", id_col: str = "row_id") -> tuple[Codebook, float]:
    """The codebook and its cost, the sum of squared residuals at the last pass. Null vectors are left
    out; ids are whole numbers."""
    k, books, spark = 1 << nbits, [], df.sparkSession
    with Scratch(spark, "seeding") as keep:
        rows = keep(df.select(F.col(id_col).cast("long").alias("id"), doubles(x_col).alias("r")).where("r is not null"))
        centre, cost = _moments(rows)
        if not len(centre):
            raise ValueError("no rows to train on")
        for level in range(levels):
            found = (centre if not level else np.zeros_like(centre))[None]
            for t in range(rounds if cost > 0 else 0):
                found = np.concatenate([found, _sampled(rows, found, cost, OVERSAMPLE * k, (seed, level, t))])
            # the centre itself would draw all rows that are far from every other candidate
            n, sums, _, _ = _pass(rows, found[1:] if len(found) > 1 else found)
            seen = n > 0
            book = cluster_candidates(sums[seen] / n[seen, None], n[seen], k, candidate_passes, keys=(seed, level))
            for _ in range(iterations):
                n, sums, costs, farthest = _pass(rows, book)
                seen, book = n > 0, book.copy()
                book[seen] = sums[seen] / n[seen, None]
                worst = [c for c in np.lexsort((np.arange(k), -np.round(costs, 9))).tolist() if seen[c]]
                for code, cell in zip(np.flatnonzero(~seen).tolist(), worst, strict=False):
                    book[code] = farthest[cell]
                cost = float(costs.sum())
            books.append(book)
            if level + 1 < levels:
                rows = keep(_residuals(rows, book))
                keep.drop(1)
    return books, cost


def _residuals(rows: DataFrame, book: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(book)

    @F.arrow_udf("array<double>")
    def rest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            v = matrix(x)[0]
            yield rows_of(v - shared.value[distances(v, shared.value).argmin(axis=1)]) if len(v) else pa.array([], pa.list_(pa.float64()))

    return rows.select("id", rest("r").alias("r"))
