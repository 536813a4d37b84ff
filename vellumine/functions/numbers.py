"""Arithmetic, rounding and bit functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def divide(a: Column, b: Column) -> Column:
    """Float division; by zero it is infinite or NaN, as IEEE has it."""
    x, y = a.cast("double"), b.cast("double")
    at_zero = F.when(x.isNull() | F.isnan(x) | (x == 0), F.when(x.isNotNull(), F.lit(float("nan")))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, at_zero).otherwise(F.try_divide(x, y))


def integer_divide(a: Column, b: Column) -> Column:
    """``//``: towards zero; null on zero."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def to_integer(x: Column, kind: str = "bigint") -> Column:
    """Casts that round: halves to even for doubles."""
    return F.rint(x).cast(kind)


def trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def even(x: Column) -> Column:
    """To the next even number away from zero."""
    return F.signum(x) * F.ceil(F.abs(x) / 2) * 2


def fdiv(x: Column, y: Column) -> Column:
    return F.floor(x / y).cast("double")


def fmod(x: Column, y: Column) -> Column:
    return (x - y * F.floor(x / y)).cast("double")


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps in an array fold: 92 steps do for any pair of longs."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.coalesce(F.try_mod(s["a"], s["b"]), F.lit(0).cast("long")).alias("b")))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"])


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a.cast("long") * F.call_function("div", b.cast("long"), gcd(a, F.when(b != 0, b)))))


def binom(n: Column, k: Column) -> Column:
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1)))
    value = F.aggregate(steps, F.lit(1).cast("long"), lambda acc, i: F.call_function("div", acc * (n.cast("long") - k.cast("long") + i), i))
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).when(k == 0, F.lit(1).cast("long")).otherwise(value)


def signbit(x: Column) -> Column:
    return (x < 0) | (x.cast("string") == "-0.0")


def isinf(x: Column) -> Column:
    return F.abs(x) == float("inf")


def isfinite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


@F.pandas_udf(T.DoubleType())
def gamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.gamma(v) if v is not None and v == v else None)


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.lgamma(v) if v is not None and v == v else None)


@F.pandas_udf(T.DoubleType())
def nextafter(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.to_numpy(float), y.to_numpy(float)))


def power(x: Column, y: Column) -> Column:
    """``^`` and ``**`` of the dialect."""
    return F.pow(x, y)


def to_base(x: Column, base: int, width: int = 0) -> Column:
    text = F.conv(x.cast("string"), 10, base)
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text) if width else text


def width_bucket_floor(x: Column, width: float) -> Column:
    return F.floor(x / width) * width


def equi_width_bins(low: Column, high: Column, count: int) -> Column:
    """Upper ends of ``count`` bins of equal width."""
    step = (high - low) / count
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: low + step * i)
