"""Registered queries, one module for each section of the operator inventory.

A module lists :class:`Query` objects; each reads the given tables through
Spark and carries the SQL that another engine runs for the same rows.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "relational", "joins", "aggregates", "windows", "sets", "scalars_text", "scalars_number", "scalars_time",
    "scalars_nested", "rows", "changes", "streams", "definitions",
)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def sql(name: str, tables: str, text: str, oracle: str | None = None) -> Query:
    """A query in SQL over the tables named; the oracle is the same text unless given."""
    from larkspur.session import views

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables.split())
        return spark.sql(text)

    return Query(name, run, oracle or text)


def frame(name: str, table_names: str, build: Callable[..., DataFrame], oracle: str | None) -> Query:
    """A query built from DataFrames of the tables named."""
    from larkspur.session import table

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*[table(spark, sf_dir, t) for t in table_names.split()])

    return Query(name, run, oracle)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for query in importlib.import_module(f"larkspur.plans.{module}").QUERIES:
            if query.name in found:
                raise ValueError(f"two queries are named {query.name}")
            found[query.name] = query
    return found
