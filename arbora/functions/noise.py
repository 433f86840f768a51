"""Random numbers that depend on keys only, so that no partitioning or retry changes them."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 2.0**52


def _digits(*keys: Column | str | int) -> Column:
    parts = [F.lit(str(k)) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _number(digits: Column, at: int) -> Column:
    return (F.conv(F.substring(digits, at, 13), 16, 10).cast("double") + 0.5) / _STEPS


def uniform(*keys: Column | str | int) -> Column:
    """A number in (0, 1) from the first 13 hex digits of the MD5 of the keys joined by ':'."""
    return _number(_digits(*keys), 1)


def normal(*keys: Column | str | int) -> Column:
    """A standard normal number by the Box-Muller transform of two uniforms, from the first 26 hex digits
    of one MD5 of the keys."""
    digits = _digits(*keys, 1)
    return F.sqrt(-2 * F.log(_number(digits, 1))) * F.cos(2 * math.pi * _number(digits, 14))


def _value(keys: tuple[str | int, ...], at: int = 1) -> float:
    return (int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[at - 1 : at + 12], 16) + 0.5) / _STEPS


def uniform_value(*keys: str | int) -> float:
    """The same number for given keys, on the driver: for parameters that go into a plan."""
    return _value(keys)


def normal_value(*keys: str | int) -> float:
    return math.sqrt(-2 * math.log(_value((*keys, 1)))) * math.cos(2 * math.pi * _value((*keys, 1), 14))


def _text_sql(keys: tuple[str | int, ...]) -> str:
    return " || ':' || ".join(f"'{k}'" if isinstance(k, int) else f"({k})::VARCHAR" for k in keys)


def _number_sql(keys: tuple[str | int, ...], at: int) -> str:
    return f"((('0x' || substr(md5({_text_sql(keys)}), {at}, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


def uniform_sql(*keys: str | int) -> str:
    """The same number in DuckDB SQL."""
    return _number_sql(keys, 1)


def normal_sql(*keys: str | int) -> str:
    return f"(sqrt(-2 * ln({_number_sql((*keys, 1), 1)})) * cos(2 * pi() * {_number_sql((*keys, 1), 14)}))"
