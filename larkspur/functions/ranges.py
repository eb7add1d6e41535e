"""Ranges and multiranges.

A range is ``struct<lo, hi, lo_inc, hi_inc, empty>``; a null bound is infinite.
Discrete kinds (integers, dates) are kept as ``[lo, hi)``.  A multirange is a
sorted array of ranges that neither overlap nor touch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _range(lo: Column, hi: Column, lo_inc: Column, hi_inc: Column, empty: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        F.when(~empty, lo).otherwise(none).alias("lo"), F.when(~empty, hi).otherwise(none).alias("hi"),
        (~empty & lo.isNotNull() & lo_inc).alias("lo_inc"), (~empty & hi.isNotNull() & hi_inc).alias("hi_inc"), empty.alias("empty"),
    )


def make(lo: Column, hi: Column, bounds: str = "[)") -> Column:
    """A continuous range; a lower bound above the upper is an error."""
    bad = F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast("boolean")
    a, b = F.lit(bounds[0] == "["), F.lit(bounds[1] == "]")
    empty = F.when(lo > hi, bad).otherwise(F.coalesce((lo == hi) & ~(a & b), F.lit(False)))
    return _range(lo, hi, a, b, empty)


def make_discrete(lo: Column, hi: Column, bounds: str = "[)") -> Column:
    """Integers or dates, in the form ``[lo, hi)``."""
    bad = F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast("boolean")
    one = lambda x: x + F.lit(1)
    low = lo if bounds[0] == "[" else one(lo)
    high = one(hi) if bounds[1] == "]" else hi
    empty = F.when(lo > hi, bad).otherwise(F.coalesce(low >= high, F.lit(False)))
    return _range(low, high, F.lit(True), F.lit(False), empty)


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lo"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["hi"].isNull()


def contains_value(r: Column, x: Column) -> Column:
    low = r["lo"].isNull() | (r["lo"] < x) | ((r["lo"] == x) & r["lo_inc"])
    high = r["hi"].isNull() | (r["hi"] > x) | ((r["hi"] == x) & r["hi_inc"])
    return ~r["empty"] & F.coalesce(low, F.lit(False)) & F.coalesce(high, F.lit(False))


def _low_le(a: Column, b: Column) -> Column:
    """Lower bound of ``a`` at or before that of ``b``."""
    return F.coalesce(a["lo"].isNull() | (b["lo"].isNotNull() & ((a["lo"] < b["lo"]) | ((a["lo"] == b["lo"]) & (a["lo_inc"] | ~b["lo_inc"])))), F.lit(False))


def _high_le(a: Column, b: Column) -> Column:
    return F.coalesce(b["hi"].isNull() | (a["hi"].isNotNull() & ((a["hi"] < b["hi"]) | ((a["hi"] == b["hi"]) & (b["hi_inc"] | ~a["hi_inc"])))), F.lit(False))


def before(a: Column, b: Column) -> Column:
    """``a << b``: all of ``a`` lies before all of ``b``."""
    gap = a["hi"].isNotNull() & b["lo"].isNotNull() & ((a["hi"] < b["lo"]) | ((a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"])))
    return ~a["empty"] & ~b["empty"] & F.coalesce(gap, F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & ~before(a, b) & ~before(b, a)


def contains(a: Column, b: Column) -> Column:
    return b["empty"] | (~a["empty"] & _low_le(a, b) & _high_le(b, a))


def not_right(a: Column, b: Column) -> Column:
    """``a &< b``: ``a`` doesn't extend to the right of ``b``."""
    return ~a["empty"] & ~b["empty"] & _high_le(a, b)


def not_left(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & _low_le(b, a)


def adjacent(a: Column, b: Column) -> Column:
    """``a -|- b``: one ends where the other begins, and exactly one of them holds that value."""
    meets = lambda x, y: F.coalesce((x["hi"] == y["lo"]) & (x["hi_inc"] != y["lo_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (meets(a, b) | meets(b, a))


def _lowest(a: Column, b: Column) -> Column:
    return F.when(_low_le(a, b), F.struct(a["lo"].alias("v"), a["lo_inc"].alias("inc"))).otherwise(F.struct(b["lo"].alias("v"), b["lo_inc"].alias("inc")))


def _latest(a: Column, b: Column) -> Column:
    return F.when(_low_le(a, b), F.struct(b["lo"].alias("v"), b["lo_inc"].alias("inc"))).otherwise(F.struct(a["lo"].alias("v"), a["lo_inc"].alias("inc")))


def _highest(a: Column, b: Column) -> Column:
    return F.when(_high_le(a, b), F.struct(b["hi"].alias("v"), b["hi_inc"].alias("inc"))).otherwise(F.struct(a["hi"].alias("v"), a["hi_inc"].alias("inc")))


def _earliest(a: Column, b: Column) -> Column:
    return F.when(_high_le(a, b), F.struct(a["hi"].alias("v"), a["hi_inc"].alias("inc"))).otherwise(F.struct(b["hi"].alias("v"), b["hi_inc"].alias("inc")))


def merge(a: Column, b: Column) -> Column:
    """The least range that holds both."""
    lo, hi = _lowest(a, b), _highest(a, b)
    both = _range(lo["v"], hi["v"], lo["inc"], hi["inc"], F.lit(False))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(both)


def union(a: Column, b: Column) -> Column:
    fits = a["empty"] | b["empty"] | overlaps(a, b) | adjacent(a, b)
    bad = F.raise_error(F.lit("result of range union would not be contiguous")).cast("boolean")
    m = merge(a, b)
    return _range(m["lo"], m["hi"], m["lo_inc"], m["hi_inc"], F.when(fits, m["empty"]).otherwise(bad))


def intersect(a: Column, b: Column) -> Column:
    lo, hi = _latest(a, b), _earliest(a, b)
    return _range(lo["v"], hi["v"], lo["inc"], hi["inc"], ~overlaps(a, b))


def text(r: Column) -> Column:
    shown = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.when(r["empty"], F.lit("empty")).otherwise(
        F.concat(F.when(r["lo_inc"], "[").otherwise("("), shown(r["lo"]), F.lit(","), shown(r["hi"]), F.when(r["hi_inc"], "]").otherwise(")"))
    )


def sort_key(r: Column) -> list[Column]:
    """Empty first, then by lower bound (none is least), then by upper bound (none is greatest)."""
    return [(~r["empty"]).asc(), r["lo"].asc_nulls_first(), (~r["lo_inc"]).asc(), r["hi"].asc_nulls_last(), r["hi_inc"].asc()]


def multirange(rs: Column) -> Column:
    """Ranges of an array joined where they overlap or touch; bounds must not be infinite."""
    full = F.array_sort(F.filter(rs, lambda r: ~r["empty"]))

    def add(acc: Column, r: Column) -> Column:
        def onto(last: Column) -> Column:
            joins = last.isNotNull() & F.coalesce(overlaps(last, r) | adjacent(last, r), F.lit(False))
            kept = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            return F.when(joins, F.concat(kept, F.array(merge(last, r)))).otherwise(F.concat(acc, F.array(r)))

        # bound once, as the last range is named often
        return F.get(F.transform(F.array(F.try_element_at(acc, F.lit(-1))), onto), 0)

    return F.aggregate(full, F.slice(full, 1, 0), add)
