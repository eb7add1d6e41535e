"""Regular-expression functions; patterns are Java's, flags are g, i and c."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flags(flags: str) -> tuple[str, bool]:
    if set(flags) - set("gic"):
        raise ValueError(f"invalid regular expression option: {flags!r}")
    return ("(?i)" if "i" in flags else ""), "g" in flags


def matches(s: Column, pattern: str, insensitive: bool = False) -> Column:
    return s.rlike(("(?i)" if insensitive else "") + pattern)


def _replacement(text: str) -> str:
    """``\\1`` and ``\\&`` in Java's words."""
    out = re.sub(r"([$])", r"\\\1", text)
    return re.sub(r"\\(\\|&|[1-9])", lambda m: {"\\": "\\\\", "&": "$0"}.get(m[1], f"${m[1]}"), out)


def replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match only, unless flag ``g`` is given."""
    prefix, every = _flags(flags)
    if every:
        return F.regexp_replace(s, prefix + pattern, _replacement(replacement))
    # what comes before the first match is a group, the match another, so the pattern's own move up by two
    shifted = re.sub(r"(?<!\\)\$([0-9])", lambda m: f"${int(m[1]) + 2}", _replacement(replacement))
    inner = re.sub(r"\\(.)", lambda m: f"\\{int(m[1]) + 2}" if m[1] in "1234567" else m[0], pattern)
    return F.regexp_replace(s, f"{prefix}^((?s:.*?))({inner})", "$1" + shifted)


def count(s: Column, pattern: str, start: int = 1, flags: str = "") -> Column:
    prefix, _ = _flags(flags)
    return F.regexp_count(F.substring(s, F.lit(start), F.length(s)), F.lit(prefix + pattern))


def instr(s: Column, pattern: str, start: int = 1, flags: str = "") -> Column:
    prefix, _ = _flags(flags)
    at = F.regexp_instr(F.substring(s, F.lit(start), F.length(s)), F.lit(prefix + pattern))
    return F.when(at > 0, at + (start - 1)).otherwise(0)


def substr(s: Column, pattern: str, start: int = 1, flags: str = "") -> Column:
    """The first match, or null."""
    prefix, _ = _flags(flags)
    return F.regexp_substr(F.substring(s, F.lit(start), F.length(s)), F.lit(prefix + pattern))


def substring(s: Column, pattern: str) -> Column:
    """The first group's text if the pattern has one, else the match; null without a match."""
    group = 1 if re.compile(pattern).groups else 0
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def split(s: Column, pattern: str, flags: str = "") -> Column:
    return F.split(s, _flags(flags)[0] + pattern)


def all_matches(s: Column, pattern: str, flags: str = "g") -> Column:
    """Rows of captures: ``array<array<string>>``, one entry a match."""
    prefix, every = _flags(flags)
    groups = max(1, re.compile(pattern).groups)
    found = [F.regexp_extract_all(s, F.lit(prefix + pattern), F.lit(g if re.compile(pattern).groups else 0)) for g in range(1, groups + 1)]
    rows = F.transform(F.sequence(F.lit(1), F.size(found[0])), lambda i: F.array(*[F.get(f, i - 1) for f in found]))
    rows = F.when(F.size(found[0]) > 0, rows).otherwise(F.array().cast("array<array<string>>"))
    return rows if every else F.slice(rows, 1, 1)
