"""JSON texts: access, construction and jsonb's canonical form.

Access and construction stay in the JVM.  Path updates, containment and the
canonical text need a whole tree at once and run as Arrow-batched UDFs.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def field(j: Column, key: str) -> Column:
    """``j ->> key``."""
    return F.get_json_object(j, "$['" + key.replace("'", "\\'") + "']")


def element(j: Column, i: int) -> Column:
    """``j ->> i``; a negative index counts from the end."""
    if i >= 0:
        return F.get_json_object(j, f"$[{i}]")
    items = F.from_json(j, "array<string>")
    return F.try_element_at(items, F.lit(i))


def path(j: Column, *steps: str | int) -> Column:
    """``j #>> '{a,0,b}'``."""
    return F.get_json_object(j, "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps))


def has_key(j: Column, key: Column | str) -> Column:
    return F.array_contains(F.json_object_keys(j), key)


def has_any(j: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(F.json_object_keys(j), F.array(*[F.lit(k) for k in keys]))


def has_all(j: Column, keys: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), F.json_object_keys(j))) == 0


def typeof(j: Column) -> Column:
    c = F.substring(F.ltrim(j), 1, 1)
    return (
        F.when(c == "{", "object").when(c == "[", "array").when(c == '"', "string").when(c.isin("t", "f"), "boolean").when(c == "n", "null").otherwise("number")
    )


def array_length(j: Column) -> Column:
    return F.json_array_length(j)


def to_json(x: Column) -> Column:
    """Null fields stay."""
    return F.to_json(x, {"ignoreNullFields": "false"})


def build_object(**fields: Column) -> Column:
    return to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def each(j: Column) -> Column:
    """``array<struct<key, value>>`` of an object, the values as text."""
    return F.map_entries(F.from_json(j, "map<string,string>"))


def _canonical(x: object) -> str:
    """Keys by length and then bytes, one space after colon and comma."""
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: (len(k.encode()), k.encode()))
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_canonical(x[k])}" for k in keys) + "}"
    if isinstance(x, list):
        return "[" + ", ".join(map(_canonical, x)) + "]"
    if isinstance(x, Decimal):
        return format(x, "f")  # the digits as written, without an exponent
    return json.dumps(x, ensure_ascii=False)


def _refused(token: str) -> None:
    raise ValueError(f"invalid input syntax for type json: {token}")


def _parsed(text: str) -> object:
    """A tree whose fractions keep their digits; NaN and Infinity are no JSON."""
    return json.loads(text, parse_float=Decimal, parse_constant=_refused)


def _each_text(work):
    """A UDF from ``work(tree, *arguments)`` on parsed trees to canonical text."""

    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        def one(text, *rest):
            return None if text is None else work(_parsed(text), *rest)

        return pd.Series([one(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run


def canonical(j: Column) -> Column:
    return _each_text(_canonical)(j)


def delete(j: Column, key: str | int) -> Column:
    """``j - key``: a key of an object, an index of an array, or equal texts of an array."""

    def work(x):
        if isinstance(x, dict):
            x.pop(key, None)
        elif isinstance(key, int):
            if -len(x) <= key < len(x):
                del x[key]
        else:
            x = [e for e in x if e != key]
        return _canonical(x)

    return _each_text(work)(j)


def delete_path(j: Column, steps: list[str | int]) -> Column:
    def work(x):
        at = x
        for s in steps[:-1]:
            try:
                at = at[s]
            except (KeyError, IndexError, TypeError):
                return _canonical(x)
        last = steps[-1]
        if (isinstance(at, dict) and last in at) or (isinstance(at, list) and isinstance(last, int) and -len(at) <= last < len(at)):
            del at[last]
        return _canonical(x)

    return _each_text(work)(j)


def set_path(j: Column, steps: list[str | int], value: Column, create: bool = True) -> Column:
    """``jsonb_set``: replaces the value at a path, and makes its last step if it's missing."""

    def work(x, text):
        at = x
        for s in steps[:-1]:
            try:
                at = at[s]
            except (KeyError, IndexError, TypeError):
                return _canonical(x)
        last, new = steps[-1], _parsed(text)
        if isinstance(at, dict):
            if create or last in at:
                at[last] = new
        elif isinstance(at, list) and isinstance(last, int):
            if -len(at) <= last < len(at):
                at[last] = new
            elif create:
                at.insert(len(at) if last > 0 else 0, new)
        return _canonical(x)

    return _each_text(work)(j, value)


def strip_nulls(j: Column) -> Column:
    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if v is not None}
        return [strip(v) for v in x] if isinstance(x, list) else x

    return _each_text(lambda x: _canonical(strip(x)))(j)


def pretty(j: Column) -> Column:
    def lines(x, depth):
        pad, end = "\n" + "    " * (depth + 1), "\n" + "    " * depth
        if isinstance(x, dict) and x:
            keys = sorted(x, key=lambda k: (len(k.encode()), k.encode()))
            return "{" + ",".join(f"{pad}{json.dumps(k, ensure_ascii=False)}: {lines(x[k], depth + 1)}" for k in keys) + end + "}"
        if isinstance(x, list) and x:
            return "[" + ",".join(pad + lines(v, depth + 1) for v in x) + end + "]"
        return _canonical(x)

    return _each_text(lambda x: lines(x, 0))(j)


def element(j: Column, step: str | int) -> Column:
    """``j -> step`` as canonical text; null where there is no such member."""

    def work(x):
        if isinstance(x, dict) and isinstance(step, str) and step in x:
            return _canonical(x[step])
        if isinstance(x, list) and isinstance(step, int) and -len(x) <= step < len(x):
            return _canonical(x[step])
        return None

    return _each_text(work)(j)


def insert_path(j: Column, steps: list[str | int], value: Column, after: bool = False) -> Column:
    """``jsonb_insert``: before or after an array's element, or a new key; a key that is there is an error."""

    def work(x, text):
        at = x
        for s in steps[:-1]:
            try:
                at = at[s]
            except (KeyError, IndexError, TypeError):
                return _canonical(x)
        last = steps[-1]
        if isinstance(at, dict):
            if last in at:
                raise ValueError("cannot replace existing key")
            at[last] = _parsed(text)
        elif isinstance(at, list) and isinstance(last, int):
            place = last + len(at) if last < 0 else last
            at.insert(max(0, place + 1 if after else place), _parsed(text))
        return _canonical(x)

    return _each_text(work)(j, value)


def set_lax(j: Column, steps: list[str | int], value: Column, create: bool = True, null_treatment: str = "use_json_null") -> Column:
    """``jsonb_set_lax``: what a null value does is said by ``null_treatment``."""
    if null_treatment == "raise_exception":
        none = F.raise_error(F.lit("JSON value must not be null")).cast("string")
    elif null_treatment == "use_json_null":
        none = set_path(j, steps, F.lit("null"), create)
    elif null_treatment == "delete_key":
        none = delete_path(j, steps)
    elif null_treatment == "return_target":
        none = canonical(j)
    else:
        raise ValueError(f"null_treatment must not be {null_treatment!r}")
    return F.when(value.isNull(), none).otherwise(set_path(j, steps, F.coalesce(value, F.lit("null")), create))


def build_array(*values: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.coalesce(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2), F.lit("null")) for v in values]), F.lit("]"))


def row_to_json(*columns: str) -> Column:
    return to_json(F.struct(*columns))


def _contains(a: object, b: object) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_contains(x, y) for x in a) for y in b)
    if isinstance(a, list):
        return any(not isinstance(x, (dict, list)) and x == b for x in a)
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def contains(a: Column, b: Column) -> Column:
    """``a @> b``."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _contains(_parsed(p), _parsed(q)) for p, q in zip(x, y, strict=True)], dtype=object)

    return run(a, b)
