"""Sorting with PostgreSQL's null order, DISTINCT ON, and limits with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")


def _edge(df: DataFrame, by: str, n: int, descending: bool) -> DataFrame:
    """One row: the key of row ``n`` (``__edge``) and how many of the first ``n`` rows have it."""
    keys = df.select(F.col(by).alias("__k")).orderBy(desc("__k") if descending else asc("__k")).limit(n)
    # nulls come first in descending order and last in ascending order
    last = F.min("__k") if descending else F.when(F.count("__k") == F.count("*"), F.max("__k"))
    edge = keys.agg(last.alias("__edge"), F.count("*").alias("__rows"))
    same = keys.join(F.broadcast(edge), keys["__k"].eqNullSafe(F.col("__edge"))).agg(F.count("*").alias("__times"))
    return edge.crossJoin(same)  # one row each


def _not_after(key: Column, edge: Column, descending: bool) -> Column:
    """Whether ``key`` comes before or with ``edge``, nulls included."""
    if descending:
        return key.isNull() | F.coalesce(key >= edge, F.lit(False))
    return edge.isNull() | F.coalesce(key <= edge, F.lit(False))


def top_with_ties(df: DataFrame, by: str, n: int, descending: bool = True, offset: int = 0) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + n`` in the order of ``by``, and those that tie with the last of them.

    Boundary keys come from a top-k over the key alone; then the rows are filtered.
    Of the rows that tie at the offset as many as it takes are left out.
    """
    key = F.col(by)
    kept = df.join(F.broadcast(_edge(df, by, n + offset, descending)), _not_after(key, F.col("__edge"), descending)).select(df.columns)
    if offset:
        kept = kept.crossJoin(F.broadcast(_edge(df, by, offset, descending)))
        tied = key.eqNullSafe(F.col("__edge"))
        kept = kept.where(tied | ~_not_after(key, F.col("__edge"), descending))
        number = F.row_number().over(Window.partitionBy(by).orderBy(*df.columns))
        again = kept.where(tied).withColumn("__rn", number).where("__rn > __times")  # the ties alone
        kept = kept.where(~tied).select(df.columns).unionByName(again.select(df.columns))
    return kept


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
