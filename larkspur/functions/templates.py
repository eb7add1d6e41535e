"""``to_char`` and ``to_number`` of numbers: templates of 9, 0, point, group, sign and fill marks."""

from __future__ import annotations

import decimal
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman numerals, in falling order of value.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
_MARK = re.compile(r"FM|MI|PL|SG|PR|RN|rn|TH|th|EEEE|V|[90.,DGS]|\"[^\"]*\"|.", re.S)


def roman(n: int) -> str:
    if not 1 <= n <= 3999:
        return "#" * 15
    out = ""
    for value, mark in ROMAN:
        while n >= value:
            out, n = out + mark, n - value
    return out


def number_text(value: decimal.Decimal, template: str) -> str:
    """One number in a template; unsupported marks are an error."""
    marks = _MARK.findall(template)
    fill = "FM" not in marks
    marks = [m for m in marks if m != "FM"]
    if "EEEE" in marks:
        digits = sum(m in "90" for m in marks[marks.index(next((m for m in marks if m in ".D"), "EEEE")) :] if m in "90")
        text = f"{value:.{digits}e}"
        mantissa, _, power = text.partition("e")
        out = f"{mantissa}e{power[0]}{int(power[1:]):02d}"
        return out if value < 0 or not fill else " " + out
    if "RN" in marks or "rn" in marks:
        text = roman(int(value.to_integral_value(decimal.ROUND_HALF_UP)))
        text = text.lower() if "rn" in marks else text
        return text.rjust(15) if fill else text
    if bad := [m for m in marks if m in ("V", "TH", "th")]:
        raise ValueError(f"to_char template mark {bad[0]} is not supported")
    point = next((i for i, m in enumerate(marks) if m in (".", "D")), len(marks))
    places = sum(m in ("9", "0") for m in marks[point:])
    shown = abs(value).quantize(decimal.Decimal(1).scaleb(-places), decimal.ROUND_HALF_UP)
    negative = value < 0 and shown != 0
    whole, _, part = f"{shown:f}".partition(".")
    room = sum(m in ("9", "0") for m in marks[:point])
    if whole == "0" and room and places and "0" not in marks[:point]:
        whole = ""
    digits = (whole.rjust(room) if len(whole) <= room else "#" * room) + (part if len(whole) <= room else "#" * places)
    first_zero = next((i for i, m in enumerate([m for m in marks[:point] if m in ("9", "0")]) if m == "0"), room)
    body, at, started = [], 0, False
    last_part = len(digits)
    if not fill:  # zeros that only 9 asks for are left off the end
        asked = [m for m in marks[point:] if m in ("9", "0")]
        keep = max((i + 1 for i, m in enumerate(asked) if m == "0"), default=0)
        tail = digits[room:]
        while len(tail) > keep and tail.endswith("0"):
            tail = tail[:-1]
        last_part = room + len(tail)
    for i, m in enumerate(marks):
        if m in ("9", "0"):
            c = digits[at] if at < len(digits) else ""
            if at < room:
                if c == " " and at >= first_zero:
                    c = "0"
                started = started or c != " "
                body.append(c)
            elif at < last_part:
                body.append(c)
            at += 1
        elif m in (".", "D"):
            body.append(".")
        elif m in (",", "G"):
            body.append("," if started and i < point or i > point else " ")
        elif m[0] == '"':
            body.append(m[1:-1])
        elif m not in ("MI", "PL", "SG", "PR", "S"):
            body.append(m)
    text = "".join(body)
    if not fill:
        text = text.replace(" ", "")
    lead = len(text) - len(text.lstrip(" "))
    if "PR" in marks:
        core = text[lead:]
        text = " " * lead + ("<" + core + ">" if negative else (" " + core + " " if fill else core))
    elif "MI" in marks or "SG" in marks or "PL" in marks:
        mark = next(m for m in marks if m in ("MI", "SG", "PL"))
        sign = "-" if negative else ("+" if mark in ("SG", "PL") else (" " if fill else ""))
        text = sign + text if marks[0] == mark else text + sign
    elif "S" in marks:
        sign = "-" if negative else "+"
        text = text + sign if marks[-1] == "S" else " " * lead + sign + text[lead:]
    else:
        text = " " * lead + ("-" if negative else " " if fill else "") + text[lead:]
    return text


def to_char(x: Column, template: str) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else number_text(decimal.Decimal(v), template) for v in values], dtype=object)

    return run(x.cast("string"))


def to_number(text: Column, template: str) -> Column:
    """Digits, point and sign of a text; group marks and what the template quotes are dropped."""
    scale = len(re.sub(r"[^90]", "", re.split(r"[.D]", template, maxsplit=1)[1])) if re.search(r"[.D]", template) else 0
    digits = F.regexp_replace(text, r"[^0-9.]", "")
    negative = F.contains(text, F.lit("-")) | (F.contains(text, F.lit("<")) & F.lit("PR" in template))
    value = digits.cast(f"decimal(38,{scale})")
    return F.when(negative, -value).otherwise(value)
