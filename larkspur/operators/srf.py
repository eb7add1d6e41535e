"""Set-returning functions: rows from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series(low: Column | int, high: Column | int, step: Column | int = 1) -> Column:
    """The array of a series; empty where the step points away from the end, null if any part is."""
    low, high, step = (x if isinstance(x, Column) else F.lit(x) for x in (low, high, step))
    bad = F.raise_error(F.lit("step size cannot equal zero")).cast("array<bigint>")
    away = ((step > 0) & (low > high)) | ((step < 0) & (low < high))
    safe = F.sequence(low.cast("long"), F.when(away, low).otherwise(high).cast("long"), step.cast("long"))
    return F.when(step == 0, bad).when(away, F.array().cast("array<bigint>")).otherwise(safe)


def generate_series(df: DataFrame, name: str, low: Column | int, high: Column | int, step: Column | int = 1) -> DataFrame:
    return df.withColumn(name, F.explode(series(low, high, step)))


def unnest(df: DataFrame, array: Column, name: str, ordinality: str | None = None) -> DataFrame:
    """A row for each element; none for null or empty arrays; ``ordinality`` counts from 1."""
    if ordinality is None:
        return df.select("*", F.explode(array).alias(name))
    return df.select("*", F.posexplode(array).alias(ordinality, name)).withColumn(ordinality, (F.col(ordinality) + 1).cast("long"))


def lockstep(df: DataFrame, **arrays: Column) -> DataFrame:
    """Several set-returning functions side by side; the shorter are padded with nulls."""
    zipped = F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])
    out = df.select("*", F.explode(zipped).alias("__z"))
    return out.select(*df.columns, *[F.col("__z")[n if n in _names(out) else str(i)].alias(n) for i, n in enumerate(arrays)])


def _names(df: DataFrame) -> list[str]:
    return df.schema["__z"].dataType.names


def subscripts(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array)))
