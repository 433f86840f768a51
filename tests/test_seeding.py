"""Seeded codebooks: the same for any partitioning, no worse than from arbitrary rows, no empty cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions.lineage import durable
from arbora.operators import quantize, seeding


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 3)) * 10
    x = centres[np.r_[np.zeros(200, dtype=int), rng.integers(0, 8, size=200)]] + rng.normal(size=(400, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return x, durable(spark.createDataFrame([*rows, (400, None)], "row_id long, x array<double>").repartition(3))


def cost(x, books):
    return float((quantize._walk(x, books)[1][-1] ** 2).sum())


def test_against_arbitrary_starts_and_partitions(spark, blobs):
    x, df = blobs
    books, last = seeding.train(df, 2, 3, 4)
    plain = quantize.train_codebook(df.where("x is not null"), 2, 3, 10)
    assert cost(x, books) < cost(x, plain) and cost(x, books) <= last * (1 + 1e-9)
    # eight clusters, eight codes: within them only the noise is left
    assert cost(x, books[:1]) < 1.3 * 3 * 400
    again, _ = seeding.train(df.repartition(7), 2, 3, 4)
    assert all(np.allclose(a, b) for a, b in zip(books, again, strict=True))
    other, _ = seeding.train(df, 2, 3, 4, seed=1)
    assert not all(np.allclose(a, b) for a, b in zip(books, other, strict=True))


def test_pass_against_plain(spark, blobs):
    x, df = blobs
    rows = df.where("x is not null").select(F.col("row_id").alias("id"), F.col("x").alias("r"))
    centres = np.concatenate([x[:5], [[1e6] * 3]])
    n, sums, costs, farthest = seeding._pass(rows, centres)
    d = ((x[:, None] - centres) ** 2).sum(axis=2)
    code = d.argmin(axis=1)
    for c in range(6):
        own = code == c
        assert n[c] == own.sum() and np.allclose(sums[c], x[own].sum(axis=0)) and costs[c] == pytest.approx(d[own, c].sum())
        assert (c in farthest) == own.any() and (not own.any() or np.allclose(farthest[c], x[own][d[own, c].argmax()]))


def test_empty_codes_take_the_worst_cells(spark):
    """More codes than the draws can tell apart: no code stays empty while cells have a cost."""
    x = [[float(i % 6) * 100 + (i // 6) * 0.1] for i in range(60)]
    df = durable(spark.createDataFrame(list(enumerate(x)), "row_id long, x array<double>"))
    books, _ = seeding.train(df, 1, 3, 8, rounds=0)
    codes = {tuple(r["codes"]) for r in quantize.encode(df, books).collect()}
    assert len(codes) == 8 and cost(np.array(x), books) < 60


def test_few_and_equal_rows(spark):
    one = spark.createDataFrame([(i, [2.0, 3.0]) for i in range(5)], "row_id long, x array<double>")
    books, last = seeding.train(one, 2, 2, 2)
    assert last == 0 and books[0].shape == (4, 2) and cost(np.array([[2.0, 3.0]]), books) < 1e-18
    with pytest.raises(ValueError):
        seeding.train(one.limit(0), 1, 1, 1)


def test_candidates():
    points = np.array([[0.0], [0.1], [10.0], [10.2], [50.0]])
    found = seeding.cluster_candidates(points, np.array([5.0, 5, 3, 1, 2]), 3)
    assert np.allclose(sorted(found.ravel()), [0.05, 10.05, 50])
    assert seeding.cluster_candidates(points[:1], np.array([1.0]), 2).tolist() == [[0.0], [0.0]]
