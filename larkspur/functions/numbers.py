"""PostgreSQL arithmetic: rounding, integer division, number theory, buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_float(x: Column) -> Column:
    """Half to even, as floats round."""
    return F.rint(x)


def round_numeric(x: Column, digits: int = 0, precision: int = 38, scale: int = 10) -> Column:
    """Half away from zero, as exact numbers round."""
    return F.round(x.cast(f"decimal({precision},{scale})"), digits)


def float_to_int(x: Column) -> Column:
    return F.rint(x).cast("int")


def trunc(x: Column, digits: int = 0) -> Column:
    """Toward zero."""
    unit = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * unit) / unit


def div(a: Column, b: Column) -> Column:
    """Integer quotient, truncated; division by zero is an error."""
    return F.call_function("div", a, b)


@F.arrow_udf(T.LongType())
def _gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    none = np.asarray(pc.or_(a.is_null(), b.is_null()))
    return pa.array(np.gcd(a.fill_null(0).to_numpy(), b.fill_null(0).to_numpy()), pa.int64(), mask=none)


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor, by Arrow batch; of two zeros it is 0."""
    return _gcd(a.cast("long"), b.cast("long"))


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a.cast("long") / F.when(g == 0, 1).otherwise(g) * b.cast("long")).cast("long"))


def log10_(x: Column) -> Column:
    """One-argument ``log`` is to base 10; zero and less are errors."""
    return F.when(x <= 0, F.raise_error(F.lit("cannot take logarithm of a number that is not positive")).cast("double")).otherwise(F.log10(x))


def width_bucket(x: Column, thresholds: Column) -> Column:
    """How many of the sorted thresholds are at most ``x``."""
    return F.size(F.filter(thresholds, lambda t: t <= x))


def width_bucket_range(x: Column, low: float, high: float, n: int) -> Column:
    return F.width_bucket(x, F.lit(low), F.lit(high), F.lit(n))


def factorial(n: Column) -> Column:
    """Up to 20 in a long; larger numbers as decimal up to 33, beyond which it is an error."""
    small = F.factorial(n).cast("decimal(38,0)")
    step = lambda a, x: (a * x.cast("decimal(2,0)")).cast("decimal(38,0)")
    large = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1).cast("decimal(38,0)"), step)
    return F.when(n <= 20, small).otherwise(large)


def num_nulls(*xs: Column) -> Column:
    return sum((x.isNull().cast("int") for x in xs), F.lit(0))


def num_nonnulls(*xs: Column) -> Column:
    return sum((x.isNotNull().cast("int") for x in xs), F.lit(0))


def min_scale(x: Column) -> Column:
    """Digits after the point that a numeric needs."""
    return F.length(F.regexp_extract(x.cast("string"), r"\.(\d*?)0*$", 1))


def trim_scale(x: Column) -> Column:
    """A numeric's text without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
