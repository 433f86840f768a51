"""Whitening against plain exact arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import whitening
from arbora.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def exact(x):
    """n, sums and the covariance of distinct whole vectors, in Python's numbers."""
    u = sorted({tuple(int(v) for v in r) for r in x})
    n, d = len(u), len(u[0])
    s = [sum(r[i] for r in u) for i in range(d)]
    y = [[n * r[i] - s[i] for i in range(d)] for r in u]
    return n, s, np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])


def whole(x):
    return np.floor(64 * np.asarray(x, dtype=np.float64)).astype(np.int64) + 1_000_000


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    x = whole([v for _, v in rows])
    n, s, v = exact(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    got = QUERIES["op13_whitening"](spark, path).toPandas()
    assert len(got) == 16 * len(rows) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    want = (x - np.array(s) / n) @ u[:, :16] / np.sqrt(e[:16])
    sign = np.sign((table * want).sum(axis=0))
    assert np.abs(table * sign - want).max() < 1e-6
    assert np.allclose(got.groupby("component")["explained"].first(), e[:16] / np.trace(v), rtol=1e-9)
    deviation = got.groupby("vec_id")["deviation"].first()
    assert all(deviation[i] == sum((n * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for (i, _), r in zip(rows, x, strict=True))


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e7, 1e10])
def test_covariance_is_exact_at_any_size(spark, scale):
    """In 64 bits, in two limbs, and in Python's numbers."""
    rng = np.random.default_rng(1)
    x = (scale * rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*x, *x[:40]])], SCHEMA).repartition(5)
    model = whitening.fit(df, "embedding")
    n, s, v = exact(whole(x))
    assert model.n == n == 300 and model.sums == s
    e, u = np.linalg.eigh(v)
    assert np.allclose(model.eigenvalues, e[::-1], rtol=1e-12) and np.allclose(np.abs((model.components @ u[:, ::-1]).diagonal()), 1)
    assert model.identity_error < 1e-8
    y = [[n * int(a) - b for a, b in zip(r, s, strict=True)] for r in whole(x)]
    far = {r["vec_id"]: r["f"]["deviation"] for r in whitening.transform(df, model, "embedding", "f").collect()}
    want = [sum(v * v for v in r) for r in y]
    assert all(far[i] == (w if w < 1 << 63 else None) for i, w in enumerate(want))


def test_squares_match():
    rng = np.random.default_rng(3)
    for top in (1 << 25, 1 << 40):
        z = rng.integers(-top, top, size=(5000, 3))
        assert whitening._exact_sums(z, top + 1) == [sum(int(v) ** 2 for v in c) for c in z.T]
    squares = [9, 16, 49]  # of a, b and a + b where ab = 12
    assert whitening.covariance(1, 2, squares).tolist() == [[9, 12], [12, 16]]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [0.0, 1.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [2.0, 0.0])]
    gone = [(4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, [2.0**41, 0.0])]
    df = spark.createDataFrame([*good, *gone], SCHEMA).withColumns({c: F.lit(7) for c in ("x", "x_whole", "whitened", "a.b", "deviation")})
    model = whitening.fit(df, "embedding")
    assert model.n == 3
    out = whitening.transform(df, model, "embedding", "found")
    assert out.columns == [*df.columns, "found"] and out.count() == 5
    assert out.where("vec_id = 3").select("found").distinct().count() == 1 and out.where("x <> 7 or `a.b` <> 7").count() == 0
    # one distinct vector: no variance, so nothing to whiten
    one = df.where("vec_id in (1, 3)")
    flat = whitening.fit(one, "embedding")
    assert flat.n == 1 and flat.identity_error == 0 and flat.explained == [0.0, 0.0]
    assert {tuple(r["found"]["whitened"]) for r in whitening.transform(one, flat, "embedding", "found").collect()} == {(None, None)}
    # two distinct vectors lie on a line
    line = whitening.fit(df.where("vec_id in (1, 2)"), "embedding")
    rows = [r["found"]["whitened"] for r in whitening.transform(df.where("vec_id in (1, 2)"), line, "embedding", "found").collect()]
    assert sorted(round(r[0], 9) for r in rows) == [-1, 1] and {r[1] for r in rows} == {None} and line.identity_error < 1e-9
    assert whitening.fit(df.where("vec_id = 4"), "embedding") is None
    assert whitening.transform(df, None, "embedding", "found").count() == 0
