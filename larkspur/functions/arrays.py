"""PostgreSQL arrays: one-based, null-safe matching, null arrays as empty in concatenation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(a: Column, i: Column | int) -> Column:
    """Element ``i`` from 1; null out of range."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.when(i > 0, F.get(a, i - 1))


def slice_(a: Column, low: int, high: int) -> Column:
    low = max(low, 1)
    return F.slice(a, low, max(high - low + 1, 0))


def length(a: Column) -> Column:
    """Null for an empty array."""
    return F.nullif(F.size(a), F.lit(0))


def cardinality(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def position(a: Column, x: Column) -> Column:
    """Place of the first equal element, null if there is none; a null is found too."""
    return F.get(positions(a, x), 0)


def positions(a: Column, x: Column) -> Column:
    tagged = F.transform(a, lambda e, i: F.when(e.eqNullSafe(x), i + 1))
    return F.filter(tagged, lambda i: i.isNotNull())


def append(a: Column, x: Column) -> Column:
    return F.when(a.isNull(), F.array(x)).otherwise(F.concat(a, F.array(x)))


def prepend(x: Column, a: Column) -> Column:
    return F.when(a.isNull(), F.array(x)).otherwise(F.concat(F.array(x), a))


def cat(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def remove(a: Column, x: Column) -> Column:
    return F.filter(a, lambda e: ~e.eqNullSafe(x))


def replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda e: F.when(e.eqNullSafe(old), new).otherwise(e))


def trim(a: Column, n: int) -> Column:
    bad = F.raise_error(F.lit("number of elements to trim must be between 0 and the array's length")).cast("int")
    return F.slice(a, F.lit(1), F.when(F.size(a) >= n, F.size(a) - n).otherwise(bad))


def to_string(a: Column, delimiter: str, null: str | None = None) -> Column:
    return F.array_join(a, delimiter) if null is None else F.array_join(a, delimiter, null)


def from_string(s: Column, delimiter: str | None, null: str | None = None) -> Column:
    """Fields of a text; no delimiter gives its characters, and the empty text an empty array."""
    if delimiter is None:
        fields = F.regexp_extract_all(s, F.lit("(?s)(.)"), F.lit(1))
    elif delimiter == "":
        fields = F.array(s)
    else:
        fields = F.split(s, "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    fields = F.when(s == "", F.array().cast("array<string>")).otherwise(fields)
    return fields if null is None else F.transform(fields, lambda x: F.nullif(x, F.lit(null)))


def fill(x: Column, n: int) -> Column:
    return F.array_repeat(x, n)


def contains(a: Column, b: Column) -> Column:
    """``a @> b``: each element of ``b`` equals one of ``a``; nulls equal nothing."""
    return F.forall(b, lambda x: F.coalesce(F.exists(a, lambda e: e == x), F.lit(False)))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.exists(b, lambda x: F.coalesce(F.exists(a, lambda e: e == x), F.lit(False))), F.lit(False))


def any_(a: Column, test) -> Column:
    """``x op ANY (array)`` with three-valued logic."""
    return F.exists(a, test)


def all_(a: Column, test) -> Column:
    return F.forall(a, test)


def literal(a: Column) -> Column:
    """The text form ``{1,2,NULL}``; elements that need it are quoted."""

    def one(e: Column) -> Column:
        text = e.cast("string")
        needs = text.rlike(r'[{},"\\\s]') | (text == "") | (F.upper(text) == "NULL")
        quoted = F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))
        return F.when(text.isNull(), F.lit("NULL")).when(needs, quoted).otherwise(text)

    return F.concat(F.lit("{"), F.array_join(F.transform(a, one), ","), F.lit("}"))


def parse_literal(s: Column) -> Column:
    """``{a,"b,c",NULL}`` of one dimension as an array of text."""
    inner = F.regexp_extract(s, r"(?s)^\s*\{(.*)\}\s*$", 1)
    items = F.regexp_extract_all(inner, F.lit(r'(?s)\s*("(?:[^"\\]|\\.)*"|[^,]*[^,\s]|)\s*(?:,|$)'), F.lit(1))
    # the end of the text matches once more, emptily
    items = F.when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(F.filter(items, lambda x: x != ""))

    def one(x: Column) -> Column:
        body = F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
        return F.when(F.startswith(x, F.lit('"')), body).when(F.upper(x) == "NULL", F.lit(None).cast("string")).otherwise(x)

    return F.transform(items, one)
