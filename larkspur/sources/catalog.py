"""``information_schema`` relations of a set of tables, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: SQL names of Spark's types.
TYPE_NAMES = {
    "boolean": "boolean", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision", "string": "text", "binary": "bytea",
    "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone",
}


def sql_type(kind: T.DataType) -> str:
    name = kind.simpleString()
    if isinstance(kind, T.ArrayType):
        return f"{sql_type(kind.elementType)}[]"
    return TYPE_NAMES.get(name, "numeric" + name.removeprefix("decimal") if name.startswith("decimal") else name)


def columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(t, f.name, i, sql_type(f.dataType), "YES" if f.nullable else "NO") for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


def tables(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([(t, "BASE TABLE") for t in frames], "table_name string, table_type string")
