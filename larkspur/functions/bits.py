"""Bit strings as texts of 0 and 1, and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_int(x: Column, width: int) -> Column:
    """The low ``width`` bits."""
    return F.right(F.lpad(F.bin(x.cast("long")), 64, "0"), F.lit(width))


def to_int(b: Column) -> Column:
    return F.conv(b, 2, 10).cast("long")


def from_hex(h: Column) -> Column:
    """``X'1F'``: four bits a digit."""
    digits = F.regexp_extract_all(h, F.lit("([0-9A-Fa-f])"), F.lit(1))
    return F.array_join(F.transform(digits, lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def _zip(a: Column, b: Column, op) -> Column:
    bad = F.raise_error(F.lit("cannot combine bit strings of different sizes")).cast("string")
    chars = lambda x: F.split(x, "")
    return F.when(F.length(a) == F.length(b), F.array_join(F.zip_with(chars(a), chars(b), op), "")).otherwise(bad)


def and_(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"))


def or_(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"))


def xor(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.when(x != y, "1").otherwise("0"))


def not_(a: Column) -> Column:
    return F.translate(a, "01", "10")


def shift_left(a: Column, n: int) -> Column:
    return F.rpad(F.substring(a, F.lit(n + 1), F.length(a)), F.length(a), F.lit("0"))


def shift_right(a: Column, n: int) -> Column:
    return F.lpad(F.substring(a, F.lit(1), F.greatest(F.length(a) - n, F.lit(0))), F.length(a), F.lit("0"))


def bit_count(a: Column) -> Column:
    return F.length(F.translate(a, "0", "")).cast("long")


def get_bit(a: Column, n: int) -> Column:
    return F.substring(a, n + 1, 1).cast("int")


def set_bit(a: Column, n: int, value: int) -> Column:
    return F.overlay(a, F.lit(str(value)), F.lit(n + 1), F.lit(1))


def get_byte(data: Column, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, n + 1, 1)), 16, 10).cast("int")


def set_byte(data: Column, n: int, value: int) -> Column:
    return F.unhex(F.overlay(F.hex(data), F.lit(f"{value:02X}"), F.lit(2 * n + 1), F.lit(2)))


def sha(data: Column, bits: int) -> Column:
    return F.unhex(F.sha2(data, bits))


def encode_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def encode_base64(data: Column) -> Column:
    return F.base64(data)


def encode_escape(data: Column) -> Column:
    """Zero and high bytes as octal, a backslash doubled."""
    octets = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))

    def one(h: Column) -> Column:
        n = F.conv(h, 16, 10).cast("int")
        octal = F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0"))
        return F.when((n == 0) | (n > 127), octal).when(n == 92, F.lit("\\\\")).otherwise(F.char(n))

    return F.array_join(F.transform(octets, one), "")
