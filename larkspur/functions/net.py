"""IPv4 addresses as ``struct<addr long, bits int>``; other families are refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = (1 << 32) - 1


def inet(text: Column) -> Column:
    """``a.b.c.d`` or ``a.b.c.d/n``."""
    parts = F.split(F.substring_index(text, "/", 1), r"\.")
    value = sum((F.shiftleft(F.get(parts, i).cast("long"), 24 - 8 * i) for i in range(4)), F.lit(0).cast("long"))
    bits = F.when(F.contains(text, F.lit("/")), F.substring_index(text, "/", -1).cast("int")).otherwise(32)
    good = text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:/(?:3[0-2]|[12]?\d))?$")
    bad = F.raise_error(F.concat(F.lit("invalid input syntax for type inet: "), text)).cast("long")
    return F.struct(F.when(good, value).otherwise(bad).alias("addr"), bits.alias("bits"))


def _mask(bits: Column) -> Column:
    return F.lit(ALL).cast("long") - (F.expr("bigint(1)") * F.pow(F.lit(2.0), 32 - bits).cast("long") - 1)


def dotted(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, 24 - 8 * i).bitwiseAND(255).cast("string") for i in range(4)])


def host(a: Column) -> Column:
    return dotted(a["addr"])


def masklen(a: Column) -> Column:
    return a["bits"]


def set_masklen(a: Column, bits: int) -> Column:
    return F.struct(a["addr"].alias("addr"), F.lit(bits).alias("bits"))


def network(a: Column) -> Column:
    return F.struct(a["addr"].bitwiseAND(_mask(a["bits"])).alias("addr"), a["bits"].alias("bits"))


def netmask(a: Column) -> Column:
    return dotted(_mask(a["bits"]))


def hostmask(a: Column) -> Column:
    return dotted(F.lit(ALL).cast("long") - _mask(a["bits"]))


def broadcast(a: Column) -> Column:
    return F.struct(a["addr"].bitwiseOR(F.lit(ALL).cast("long") - _mask(a["bits"])).alias("addr"), a["bits"].alias("bits"))


def text(a: Column) -> Column:
    """A full-length mask isn't shown."""
    return F.concat(dotted(a["addr"]), F.when(a["bits"] == 32, F.lit("")).otherwise(F.concat(F.lit("/"), a["bits"].cast("string"))))


def within(a: Column, b: Column) -> Column:
    """``a <<= b``."""
    return (a["bits"] >= b["bits"]) & (a["addr"].bitwiseAND(_mask(b["bits"])) == b["addr"].bitwiseAND(_mask(b["bits"])))


def strictly_within(a: Column, b: Column) -> Column:
    return within(a, b) & (a["bits"] > b["bits"])


def overlaps(a: Column, b: Column) -> Column:
    return within(a, b) | within(b, a)


def merge(a: Column, b: Column) -> Column:
    """The least network that holds both."""
    differ = a["addr"].bitwiseXOR(b["addr"])
    common = F.when(differ == 0, 32).otherwise(32 - F.length(F.bin(differ)))
    return network(F.struct(a["addr"].alias("addr"), F.least(a["bits"], b["bits"], common).cast("int").alias("bits")))


def plus(a: Column, n: Column | int) -> Column:
    return F.struct((a["addr"] + n).alias("addr"), a["bits"].alias("bits"))
