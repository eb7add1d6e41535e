"""Types and their texts: type names, UUIDs, byte strings, MAC addresses, arrays by dimension, options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources.catalog import sql_type


def typeof(df: DataFrame, column: str) -> Column:
    """The SQL name of a column's type."""
    return F.lit(sql_type(df.select(column).schema[0].dataType))


def uuid(text: Column) -> Column:
    """A UUID's canonical text: braces and hyphens may stand anywhere between groups of four digits."""
    digits = F.lower(F.regexp_replace(text, r"^\{|\}$|-", ""))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    bad = F.raise_error(F.concat(F.lit('invalid input syntax for type uuid: "'), text, F.lit('"'))).cast("string")
    return F.when(text.isNull() | digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts)).otherwise(bad)


def bytea(text: Column) -> Column:
    """Bytes from ``\\x`` and hexadecimal digits."""
    return F.unhex(F.regexp_replace(F.substring(text, F.lit(3), F.length(text)), r"\s", ""))


def convert_to(text: Column, encoding: str) -> Column:
    return F.encode(text, encoding)


def convert_from(data: Column, encoding: str) -> Column:
    return F.decode(data, encoding)


def decode(text: Column, form: str) -> Column:
    """Bytes from base64 or hexadecimal text; white space doesn't count."""
    clean = F.regexp_replace(text, r"\s", "")
    if form not in ("base64", "hex"):
        raise ValueError(f"unrecognized encoding: {form!r}")
    return F.unbase64(clean) if form == "base64" else F.unhex(clean)


def set_byte(data: Column, at: int, value: Column) -> Column:
    """The byte at a place from 0, replaced."""
    text = F.hex(data)
    return F.unhex(F.concat(F.substring(text, 1, 2 * at), F.lpad(F.hex(value.cast("long")), 2, "0"), F.substring(text, F.lit(2 * at + 3), F.length(text))))


def get_bit(data: Column, at: int) -> Column:
    """A bit, counted from the lowest of the first byte."""
    byte = F.conv(F.substring(F.hex(data), at // 8 * 2 + 1, 2), 16, 10).cast("int")
    return F.shiftright(byte, at % 8).bitwiseAND(1)


def mac_trunc(mac: Column) -> Column:
    """The maker's part, the rest zero."""
    return F.concat(F.substring(mac, 1, 8), F.lit(":00:00:00"))


def mac8_set7bit(mac: Column) -> Column:
    """The local bit of the first byte set."""
    first = F.conv(F.substring(mac, 1, 2), 16, 10).cast("int").bitwiseOR(2)
    return F.concat(F.lower(F.lpad(F.hex(first.cast("long")), 2, "0")), F.substring(mac, F.lit(3), F.length(mac)))


def ndims(kind: T.DataType) -> int:
    return 1 + ndims(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def array_dims(a: Column, depth: int) -> Column:
    """``[1:n][1:m]`` of an array of ``depth`` dimensions; null if it is empty."""
    parts, at = [], a
    for _ in range(depth):
        parts.append(F.concat(F.lit("[1:"), F.size(at).cast("string"), F.lit("]")))
        at = F.get(at, 0)
    return F.when(F.size(a) > 0, F.concat(*parts))


def array_upper(a: Column, dimension: int = 1) -> Column:
    at = a
    for _ in range(dimension - 1):
        at = F.get(at, 0)
    return F.when(F.size(at) > 0, F.size(at))


def array_lower(a: Column, dimension: int = 1) -> Column:
    return F.when(array_upper(a, dimension).isNotNull(), F.lit(1))


def rectangular(a: Column) -> Column:
    """The array, if its rows are of one length; else an error."""
    bad = F.raise_error(F.lit("multidimensional arrays must have array expressions with matching dimensions")).cast("boolean")
    return F.when(F.when(F.size(F.array_distinct(F.transform(a, F.size))) > 1, bad).otherwise(F.lit(True)), a)


def subscript(a: Column, *at: int) -> Column:
    """``a[i][j]``: null beyond the bounds."""
    for i in at:
        a = F.get(a, i - 1) if i > 0 else F.lit(None)
    return a


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: element by element with nulls last, then the shorter first."""
    sign = lambda x, y: F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, -1).when(x > y, 1).otherwise(0)
    n = F.least(F.size(a), F.size(b))
    first = F.get(F.filter(F.transform(F.arrays_zip(F.slice(a, 1, n).alias("x"), F.slice(b, 1, n).alias("y")), lambda p: sign(p["x"], p["y"])), lambda s: s != 0), 0)
    return F.coalesce(first, F.when(F.size(a) < F.size(b), -1).when(F.size(a) > F.size(b), 1).otherwise(0))


def options(entries: Column) -> Column:
    """``name=value`` texts as rows ``(option_name, option_value)``; without ``=`` the value is null."""
    return F.transform(entries, lambda e: F.struct(F.substring_index(e, "=", 1).alias("option_name"), F.when(F.contains(e, F.lit("=")), F.regexp_extract(e, "=(.*)$", 1)).alias("option_value")))
