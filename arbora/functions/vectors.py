"""Column expressions over ARRAY<DOUBLE> vectors and arm scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def weighted_sum(a: Column | str, b: Column | str, weight: float) -> Column:
    """a + weight * b, element by element."""
    return F.zip_with(a, b, lambda x, y: x + weight * y)


def add_intercept(x: Column) -> Column:
    """The vector with the constant 1 appended."""
    return F.array_append(x, F.lit(1.0))


def one_hot(label: Column, k: int) -> Column:
    """Indicator vector of length k; an out-of-range or null label gives zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce((i == label).cast("double"), F.lit(0.0)))


def context_arm_features(x: Column, arm: Column, k: int) -> Column:
    """The context followed by the arm's indicator vector."""
    return F.concat(x, one_hot(arm, k))


def clip01(z: Column) -> Column:
    return F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0))


def sigmoid_clip(z: Column) -> Column:
    """Linear stand-in for a sigmoid: z + 1/2 within 0 and 1."""
    return clip01(z + 0.5)


def reward_from_label(arm: Column, label: Column) -> Column:
    return (arm == label).cast("double")


def pack_codes(codes: Column, nbits: int) -> Column:
    """Codes of all levels in one BIGINT, level 0 in the lowest bits; levels * nbits must be below 64."""
    shifted = F.transform(codes, lambda c, l: c.cast("bigint") * F.pow(F.lit(2.0), (l * nbits)).cast("bigint"))
    return F.aggregate(shifted, F.lit(0).cast("bigint"), lambda s, v: s.bitwiseOR(v))


def unpack_codes(packed: Column, levels: int, nbits: int) -> Column:
    mask = F.lit((1 << nbits) - 1).cast("bigint")
    return F.array(*[F.shiftright(packed, l * nbits).bitwiseAND(mask).cast("int") for l in range(levels)])


def argmax_arm(arm: Column, score: Column) -> Column:
    """Aggregate: the arm of the greatest score, the lowest arm of equal ones; NaN never wins."""
    usable = F.when(~F.isnan(score), score)
    return F.max_by(arm, F.when(usable.isNotNull(), F.struct(usable, -arm)))
