"""Vector expressions, packing, keyed noise."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbora.functions import noise, vectors


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_pack_golden(spark):
    codes = F.array(*[F.lit(c) for c in (3, 10, 0, 15)])
    packed = vectors.pack_codes(codes, 4)
    assert one(spark, packed) == 61603 == 0xF0A3
    assert one(spark, vectors.unpack_codes(packed, 4, 4)) == [3, 10, 0, 15]


def test_pack_round_trip(spark):
    rows = [([(i * 7 + l) % 256 for l in range(7)],) for i in range(200)]
    df = spark.createDataFrame(rows, "codes array<int>")
    back = df.select("codes", vectors.unpack_codes(vectors.pack_codes(F.col("codes"), 8), 7, 8).alias("b"))
    assert back.where("codes <> b").count() == 0


@given(st.floats(-5, 5))
def test_clip_rule(z):
    assert min(max(z + 0.5, 0), 1) == pytest.approx(max(0.0, min(1.0, z + 0.5)))


def test_clip(spark):
    got = [one(spark, vectors.sigmoid_clip(F.lit(z))) for z in (-1.0, -0.2, 0.0, 0.5, 3.0)]
    assert got == pytest.approx([0, 0.3, 0.5, 1, 1])


def test_argmax_ties_and_nan(spark):
    rows = [(1, 0, 0.5), (1, 1, 0.9), (1, 3, 0.9), (2, 0, float("nan")), (2, 1, -1.0), (3, 0, float("nan")), (3, 1, None)]
    df = spark.createDataFrame(rows, "r int, arm int, s double")
    got = {r["r"]: r["a"] for r in df.groupBy("r").agg(vectors.argmax_arm(F.col("arm"), F.col("s")).alias("a")).collect()}
    assert got == {1: 1, 2: 1, 3: None}


def test_noise_moments_and_partitions(spark):
    for seed in (1, 2, 3):
        df = spark.range(20_000).select("id", noise.normal("id", seed).alias("z"), noise.uniform("id", seed).alias("u"))
        m, s, u = df.agg(F.avg("z"), F.stddev("z"), F.avg("u")).first()
        assert abs(m) < 4 / math.sqrt(20_000) and abs(s - 1) < 0.03 and abs(u - 0.5) < 0.01
    a = {r["id"]: r["z"] for r in df.where("id < 50").collect()}
    b = {r["id"]: r["z"] for r in df.repartition(7).where("id < 50").collect()}
    assert a == b


def test_one_hot(spark):
    assert one(spark, vectors.one_hot(F.lit(2), 4)) == [0, 0, 1, 0]
    assert one(spark, vectors.one_hot(F.lit(None).cast("int"), 3)) == [0, 0, 0]
    assert one(spark, vectors.context_arm_features(F.array(F.lit(5.0)), F.lit(0), 2)) == [5, 1, 0]
