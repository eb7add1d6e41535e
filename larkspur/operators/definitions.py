"""Named objects over data: tables made from queries, views, functions, partitions and pages of a cursor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.checkpoints import scratch
from larkspur.operators.ordering import asc


def create_table_as(df: DataFrame, path: str | None = None, if_not_exists: bool = False) -> DataFrame:
    """``CREATE TABLE AS``: the rows written as Parquet, read back from there.  With ``if_not_exists``
    a table that is there stays as it is."""
    spark, schema = df.sparkSession, df.schema
    path = path or scratch(spark)
    df.write.mode("ignore" if if_not_exists else "errorifexists").parquet(path)
    return spark.read.schema(schema).parquet(path)


def truncated(df: DataFrame) -> DataFrame:
    """The table after ``TRUNCATE``: its columns without rows."""
    return df.limit(0)


def add_column(df: DataFrame, name: str, kind: str, default: Column | None = None) -> DataFrame:
    """``ALTER TABLE ADD COLUMN``: rows that are there get the default."""
    if name in df.columns:
        raise ValueError(f'column "{name}" already exists')
    return df.withColumn(name, (default if default is not None else F.lit(None)).cast(kind))


def drop_column(df: DataFrame, name: str, if_exists: bool = False) -> DataFrame:
    if name not in df.columns and not if_exists:
        raise ValueError(f'column "{name}" does not exist')
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns or new in df.columns:
        raise ValueError(f'column "{old}" does not exist' if old not in df.columns else f'column "{new}" already exists')
    return df.withColumnRenamed(old, new)


def create_view(spark: SparkSession, name: str, query: str) -> None:
    """A view expands to its query each time it is read; nothing is stored."""
    spark.sql(query).createOrReplaceTempView(name)


def define(spark: SparkSession, signature: str, body: str) -> None:
    """``CREATE FUNCTION ... LANGUAGE sql``: ``signature`` with its ``RETURNS``, and an expression or a query.
    Spark inlines the body where it is called."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def by_range(key: Column, bounds: dict[str, tuple], default: str | None = None) -> Column:
    """The partition of ``key``: its name by half-open bounds, a null bound is open; a null key or one of
    no partition goes to the default, and without one it is an error."""
    inside = lambda lo, hi: (F.lit(True) if lo is None else key >= lo) & (F.lit(True) if hi is None else key < hi)
    return _partition(key, {name: inside(lo, hi) for name, (lo, hi) in bounds.items()}, default)


def by_list(key: Column, values: dict[str, list], default: str | None = None) -> Column:
    """The partition whose list holds the key; a null in a list takes null keys."""
    holds = lambda xs: reduce(Column.__or__, [key.eqNullSafe(F.lit(x)) for x in xs])
    return _partition(key, {name: holds(xs) for name, xs in values.items()}, default)


def by_hash(key: Column, modulus: int) -> Column:
    """The partition's number; rows of one key share it."""
    return F.pmod(F.xxhash64(key), F.lit(modulus)).cast("int")


def _partition(key: Column, tests: dict[str, Column], default: str | None) -> Column:
    none = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("no partition of relation found for row "), F.coalesce(key.cast("string"), F.lit("null")))).cast("string")
    out = none
    for name, test in reversed(tests.items()):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def write_partitions(df: DataFrame, partition: Column, path: str) -> DataFrame:
    """The table laid out by partition, so a filter on ``__partition`` reads only its files."""
    df.withColumn("__partition", partition).write.partitionBy("__partition").mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def fetch(df: DataFrame, order: list[str], n: int, after: tuple | None = None) -> DataFrame:
    """``FETCH FORWARD n`` of a cursor over unique ascending keys: the rows after the last one fetched.

    The place is a key rather than a count, so each page is a filter and a top-k.
    """
    if after is not None:
        later, same = F.lit(False), F.lit(True)
        for name, value in zip(order, after, strict=True):
            later = later | (same & (F.col(name) > F.lit(value)))
            same = same & (F.col(name) == F.lit(value))
        df = df.where(later)
    return df.orderBy(*map(asc, order)).limit(n)
