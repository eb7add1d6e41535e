"""Joins that Spark would run as nested loops, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float) -> DataFrame:
    """Pairs whose half-open spans ``[low, high)`` of numbers overlap.

    Each span is listed in the bins of ``width`` that it touches and bins are
    joined; a pair counts in the bin where the later of its spans begins, so it
    comes once.  Choose ``width`` near the usual span.
    """

    def binned(df: DataFrame, span: tuple[Column, Column], side: str) -> DataFrame:
        low, high = span
        df = df.withColumn(f"__low_{side}", low).withColumn(f"__high_{side}", high)
        df = df.where(F.col(f"__low_{side}") < F.col(f"__high_{side}"))
        first = F.floor(F.col(f"__low_{side}") / width)
        last = F.ceil(F.col(f"__high_{side}") / width) - 1
        return df.withColumn("__bin", F.explode(F.sequence(first, F.greatest(first, last))))

    a, b = binned(left, left_span, "a"), binned(right, right_span, "b")
    start = F.greatest("__low_a", "__low_b")
    out = a.join(b, "__bin").where((start < F.least("__high_a", "__high_b")) & (F.floor(start / width) == F.col("__bin")))
    return out.drop("__bin", "__low_a", "__high_a", "__low_b", "__high_b")


def overlap_counts(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float, name: str = "n") -> DataFrame:
    """Adds to each row of ``left`` that overlaps any how many spans of ``right`` it overlaps.

    Distinct spans are joined, each with its number of rows, so rows that share
    a span never expand into pairs.
    """
    low, high = left_span
    left = left.withColumn("__low", low).withColumn("__high", high)
    spans = left.select("__low", "__high").distinct()
    many = right.select(right_span[0].alias("__from"), right_span[1].alias("__to")).groupBy("__from", "__to").agg(F.count("*").alias("__many"))
    pairs = overlap_join(spans, many, (F.col("__low"), F.col("__high")), (F.col("__from"), F.col("__to")), width)
    counts = pairs.groupBy("__low", "__high").agg(F.sum("__many").alias(name))
    return left.join(counts, ["__low", "__high"]).drop("__low", "__high")


def greater_than_all(df: DataFrame, x: str, values: DataFrame, y: str) -> DataFrame:
    """``x > ALL (SELECT y ...)``: true of an empty list, never true if the list has a null."""
    edge = values.agg(F.max(y).alias("__max"), F.count("*").alias("__n"), F.count(y).alias("__some"))
    out = df.join(F.broadcast(edge))
    return out.where((F.col("__n") == 0) | ((F.col("__n") == F.col("__some")) & (F.col(x) > F.col("__max")))).select(*df.columns)


def less_than_any(df: DataFrame, x: str, values: DataFrame, y: str) -> DataFrame:
    """``x < ANY (SELECT y ...)``: some value is greater."""
    edge = values.agg(F.max(y).alias("__max"))
    return df.join(F.broadcast(edge)).where(F.col(x) < F.col("__max")).select(*df.columns)


def row_less(a: list[Column], b: list[Column]) -> Column:
    """``(a1, a2, ...) < (b1, b2, ...)`` with three-valued logic."""
    less = a[-1] < b[-1]
    for x, y in zip(reversed(a[:-1]), reversed(b[:-1]), strict=True):
        less = (x < y) | ((x == y) & less)
    return less
