"""Aggregates with PostgreSQL's treatment of nulls, order and empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_agg(x: Column, order: list[Column] | None = None) -> Column:
    """Nulls stay; null on empty input; ordered by ``order`` (ascending, nulls last) if given.

    The list is one group's, so use it for groups of bounded size.
    """
    keys = [F.struct(k.isNull().alias("n"), k.alias("v")).alias(f"k{i}") for i, k in enumerate(order or [])]
    held = F.collect_list(F.struct(*keys, F.struct(x.alias("x")).alias("e")))
    ordered = F.array_sort(held) if order else held
    return F.when(F.count("*") > 0, F.transform(ordered, lambda s: s["e"]["x"]))


def string_agg(x: Column, separator: str, order: list[Column] | None = None) -> Column:
    """Nulls are skipped; null if nothing is left."""
    values = F.filter(array_agg(x.cast("string"), order), lambda v: v.isNotNull())
    return F.when(F.count(x) > 0, F.array_join(values, separator))


def json_agg(x: Column, order: list[Column] | None = None) -> Column:
    return F.to_json(array_agg(x, order), {"ignoreNullFields": "false"})


def json_object_agg(key: Column, value: Column, order: list[Column] | None = None) -> Column:
    """``{ "k" : v, ... }`` in order, duplicate keys and all; a null key is an error."""
    bad = F.raise_error(F.lit("field name must not be null")).cast("string")
    shown = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    entry = F.concat(F.to_json(F.array(F.when(key.isNull(), bad).otherwise(key.cast("string")))), F.lit("\x00"), shown)
    # arrays of one element, to have Spark quote and escape: the brackets come off
    strip = lambda s: F.substring(s, F.lit(2), F.length(s) - 2)
    pair = lambda e: F.concat(strip(F.substring_index(e, "\x00", 1)), F.lit(" : "), strip(F.substring_index(e, "\x00", -1)))
    return F.when(F.count("*") > 0, F.concat(F.lit("{ "), F.array_join(F.transform(array_agg(entry, order), pair), ", "), F.lit(" }")))


def corr(y: Column, x: Column) -> Column:
    """Null, not an error, where either side doesn't vary."""
    both = y.isNotNull() & x.isNotNull()
    a, b = F.when(both, y.cast("double")), F.when(both, x.cast("double"))
    flat = (F.var_pop(a) == 0) | (F.var_pop(b) == 0)
    return F.when(~flat, F.covar_pop(a, b) / F.when(flat, F.lit(1.0)).otherwise(F.stddev_pop(a) * F.stddev_pop(b)))


def regression(y: Column, x: Column) -> dict[str, Column]:
    """The nine ``regr_*`` aggregates over the pairs without nulls."""
    return {f"regr_{k}": getattr(F, f"regr_{k}")(y, x) for k in ("count", "avgx", "avgy", "sxx", "syy", "sxy", "slope", "intercept", "r2")}


def percentile_cont(x: Column, fraction: float) -> Column:
    return F.percentile(x, F.lit(min(1.0, max(0.0, fraction))))


def sum_int8(x: Column) -> Column:
    """``sum`` of bigints is exact beyond 64 bits."""
    return F.sum(x.cast("decimal(38,0)"))
