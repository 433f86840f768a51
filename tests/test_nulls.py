"""Null vectors: null codes, labels and errors, and no part in training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import diagnose, prepare, quantize


@pytest.fixture(scope="module", params=["some", "whole batches"])
def rows(spark, request):
    rng = np.random.default_rng(1)
    own = [(i, rng.normal(size=3).tolist(), i % 2) for i in range(40)]
    df = spark.createDataFrame(own, "row_id long, x array<double>, label int")
    gone = spark.createDataFrame([(100 + i, None, None if i else 1) for i in range(3)], df.schema)
    both = df.unionByName(gone)
    return own, (both.coalesce(1) if request.param == "some" else both).checkpoint()


def test_codes(spark, rows):
    own, df = rows
    book = quantize.train_codebook(df, 2, 2, 3)
    only = quantize.train_codebook(df.where("x is not null"), 2, 2, 3)
    assert all(np.allclose(a, b) for a, b in zip(book, only, strict=True))
    for residuals in (False, True):
        found = {r["row_id"]: r for r in quantize.encode(df, book, residuals=residuals).collect()}
        assert len(found) == 43 and all(found[100 + i]["codes"] is None for i in range(3))
        for i, x, _ in own:
            codes, left = quantize._walk(np.array([x]), book)
            assert found[i]["codes"] == [int(c[0]) for c in codes]
            if residuals:
                assert np.allclose(found[i]["residuals"], [r[0] for r in left[:-1]])
        if residuals:
            assert all(found[100 + i]["residuals"] is None for i in range(3))
    assert quantize.encode(df.where("x is null"), book).where("codes is not null").count() == 0


def test_labels_and_linear_error(spark, rows):
    own, df = rows
    w = np.array([[1.0, 0, 0], [0, 1.0, 0]])
    found = {r["row_id"]: r["l"] for r in prepare.label_by_linear_argmax(df, w, out_col="l").collect()}
    assert all(found[i] == int(x[1] > x[0]) for i, x, _ in own) and all(found[100 + i] is None for i in range(3))
    want = np.mean([np.abs((p := np.clip(w @ x + 0.1, 0, 1)) / max(p.sum(), 1e-10) - (np.arange(2) == label)).mean() for _, x, label in own])
    assert abs(diagnose.delta_linear(df, w, np.array([0.1, 0.1])).first()["mae"] - want) < 1e-12
    assert diagnose.delta_linear(df.where(F.col("x").isNull()), w, np.array([0.1, 0.1])).first()["mae"] is None
