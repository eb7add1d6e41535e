"""PostgreSQL string functions as Column expressions, where Spark's differ or are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x: Column | str | int | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def substr(s: Column, start: Column | int, count: Column | int | None = None) -> Column:
    """The window ``[start, start + count)``, one-based: positions before the text use up the count."""
    start = _lit(start)
    first = F.greatest(start, F.lit(1))
    if count is None:
        return F.substring(s, first, F.length(s))
    count = _lit(count)
    size = F.when(count < 0, F.raise_error(F.lit("negative substring length not allowed")).cast("int")).otherwise(
        F.greatest(start + count, F.lit(1)) - first
    )
    return F.substring(s, first, F.greatest(size, F.lit(0)))


def left(s: Column, n: Column | int) -> Column:
    """The first ``n`` characters; for a negative ``n`` all but the last ``-n``."""
    n = _lit(n)
    return F.substring(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0))))


def right(s: Column, n: Column | int) -> Column:
    n = _lit(n)
    size = F.when(n >= 0, F.least(n, F.length(s))).otherwise(F.greatest(F.length(s) + n, F.lit(0)))
    return F.substring(s, F.length(s) - size + 1, size)


def initcap(s: Column) -> Column:
    """Upper case at each start of a run of letters and digits, lower case elsewhere."""
    runs = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def concat(*parts: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def split_part(s: Column, delimiter: str, n: int) -> Column:
    """Field ``n`` from 1, or from the end if negative; empty if there is none."""
    if n == 0:
        raise ValueError("field position must not be zero")
    return F.split_part(s, F.lit(delimiter), F.lit(n))


def chr_(n: Column) -> Column:
    """The character of a code point, by its UTF-8 bytes."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda k: byte(F.shiftright(n, 6 * k).bitwiseAND(63).bitwiseOR(128))
    encoded = (
        F.when(n < 128, byte(n))
        .when(n < 2048, F.concat(byte(F.shiftright(n, 6).bitwiseOR(192)), tail(0)))
        .when(n < 65536, F.concat(byte(F.shiftright(n, 12).bitwiseOR(224)), tail(1), tail(0)))
        .otherwise(F.concat(byte(F.shiftright(n, 18).bitwiseOR(240)), tail(2), tail(1), tail(0)))
    )
    return F.unhex(encoded).cast("string")


def quote_literal(s: Column) -> Column:
    body = F.replace(F.replace(s, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.when(F.contains(s, F.lit("\\")), F.lit("E'")).otherwise(F.lit("'")), body, F.lit("'"))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def quote_ident(s: Column) -> Column:
    plain = s.rlike(r"^[a-z_][a-z0-9_$]*$")
    return F.when(plain, s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def format_(template: str, *args: Column) -> Column:
    """``%s``, ``%I``, ``%L`` and ``%%``, with the arguments in turn."""
    parts, rest, left_over = [], template, list(args)
    while rest:
        head, mark, tail = rest.partition("%")
        parts.append(F.lit(head))
        if not mark:
            break
        kind, rest = tail[:1], tail[1:]
        if kind == "%":
            parts.append(F.lit("%"))
        elif kind in ("s", "I", "L") and left_over:
            arg = left_over.pop(0).cast("string")
            parts.append(F.coalesce(arg, F.lit("")) if kind == "s" else quote_ident(arg) if kind == "I" else quote_nullable(arg))
        else:
            raise ValueError(f"unrecognized format() type specifier {kind!r}, or too few arguments")
    return F.concat(*parts)


def like_any(s: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: F.like(s, p))


def like_all(s: Column, patterns: Column) -> Column:
    return F.forall(patterns, lambda p: F.like(s, p))


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """A SQL regular expression as a Java one that must match the whole text."""
    out, i, in_set = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
        elif in_set:
            out.append(c)
            in_set = c != "]"
        elif c == "[":
            out.append(c)
            in_set = True
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def similar_to(s: Column, pattern: str, escape: str = "\\") -> Column:
    return s.rlike(similar_pattern(pattern, escape))


SIZE_UNITS = ("bytes", "kB", "MB", "GB", "TB")


def size_pretty(n: Column, largest: str = "TB") -> Column:
    """Bytes, then kB, MB and so on up to ``largest``, each once ten of the unit before fill 1024, rounded half up."""
    out, unit = None, n.cast("long")
    for k, name in enumerate(SIZE_UNITS[: SIZE_UNITS.index(largest) + 1]):
        value = unit if k == 0 else F.floor((F.abs(n.cast("decimal(38,0)")) / F.lit(1 << (10 * k - 1)).cast("decimal(38,0)")).cast("decimal(38,6)") )
        shown = n.cast("long") if k == 0 else F.when(n < 0, -F.floor((value + 1) / 2)).otherwise(F.floor((value + 1) / 2)).cast("long")
        text = F.concat(shown.cast("string"), F.lit(" " + name))
        fits = F.abs(n.cast("decimal(38,0)")) < F.lit(10240 * (1 << (10 * k)) - (0 if k == 0 else 1 << max(0, 10 * k - 1))).cast("decimal(38,0)")
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out.otherwise(text)
