"""Dates, timestamps and intervals.

An interval is ``struct<months int, days int, micros long>``, as its three parts
don't convert into each other until ``justify_*`` says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    of = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(of(months, "int").alias("months"), of(days, "int").alias("days"), of(micros, "long").alias("micros"))


def micros_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def add(ts: Column, i: Column) -> Column:
    """Months first, cut back to the month's last day, then days, then time."""
    ts = ts.cast("timestamp_ntz")
    day = F.date_add(F.add_months(ts.cast("date"), i["months"]), i["days"])
    time = micros_of(ts) - F.unix_date(ts.cast("date")).cast("long") * DAY
    return from_micros(F.unix_date(day).cast("long") * DAY + time + i["micros"])


def minus(a: Column, b: Column) -> Column:
    """Timestamp difference: whole days and the rest."""
    us = micros_of(a) - micros_of(b)
    days = (F.signum(us.cast("double")) * F.floor(F.abs(us) / DAY)).cast("int")
    return interval(0, days, us - days.cast("long") * DAY)


def date_minus(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def age(a: Column, b: Column) -> Column:
    """Symbolic difference: months, then days borrowed from the month of the earlier one, then time."""
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    low, high = F.least(a, b), F.greatest(a, b)
    clock = lambda t: micros_of(t) - F.unix_date(t.cast("date")).cast("long") * DAY
    us = clock(high) - clock(low)
    borrow_day = us < 0
    days = F.day(high) - F.day(low) - borrow_day.cast("int")
    months = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low)
    length = F.day(F.last_day(low.cast("date")))
    borrow_month = days < 0
    days = days + F.when(borrow_month, length).otherwise(0)
    months = months - borrow_month.cast("int")
    us = us + F.when(borrow_day, F.lit(DAY)).otherwise(F.lit(0))
    sign = F.when(a < b, -1).otherwise(1)
    return interval(months * sign, days * sign, us * sign)


def justify_hours(i: Column) -> Column:
    days = (F.signum(i["micros"].cast("double")) * F.floor(F.abs(i["micros"]) / DAY)).cast("int")
    total, rest = i["days"] + days, i["micros"] - days.cast("long") * DAY
    shift = F.when((total > 0) & (rest < 0), -1).when((total < 0) & (rest > 0), 1).otherwise(0)
    return interval(i["months"], total + shift, rest - shift.cast("long") * DAY)


def justify_days(i: Column) -> Column:
    months = (F.signum(i["days"].cast("double")) * F.floor(F.abs(i["days"]) / 30)).cast("int")
    total, rest = i["months"] + months, i["days"] - months * 30
    shift = F.when((total > 0) & (rest < 0), -1).when((total < 0) & (rest > 0), 1).otherwise(0)
    return interval(total + shift, rest - shift * 30, i["micros"])


def epoch(i: Column) -> Column:
    """Seconds of an interval: 365.25 days a year, 30 days a month beyond whole years."""
    years = (F.signum(i["months"].cast("double")) * F.floor(F.abs(i["months"]) / 12)).cast("int")
    days = years * 365.25 + (i["months"] - years * 12) * 30 + i["days"]
    return days * 86400.0 + i["micros"] / 1e6


def extract(field: str, ts: Column) -> Column:
    """All fields of a timestamp, as double."""
    ts = ts.cast("timestamp_ntz")
    year = F.year(ts)
    # there is no year 0: centuries and millennia count from 1 on either side
    fields = {
        "year": year, "month": F.month(ts), "day": F.day(ts), "hour": F.hour(ts), "minute": F.minute(ts),
        "second": F.second(ts) + (micros_of(ts) % 1_000_000) / 1e6,
        "dow": F.dayofweek(ts) - 1, "isodow": F.weekday(ts) + 1, "doy": F.dayofyear(ts), "quarter": F.quarter(ts),
        "decade": F.floor(year / 10), "century": F.when(year > 0, F.floor((year + 99) / 100)).otherwise(-F.floor((99 - (year - 1)) / 100)),
        "millennium": F.when(year > 0, F.floor((year + 999) / 1000)).otherwise(-F.floor((999 - (year - 1)) / 1000)),
        "week": F.weekofyear(ts), "isoyear": F.year(F.date_add(ts.cast("date"), 3 - F.weekday(ts))),
        "milliseconds": F.second(ts) * 1000 + (micros_of(ts) % 1_000_000) / 1e3,
        "microseconds": F.second(ts) * 1_000_000 + micros_of(ts) % 1_000_000,
        "epoch": micros_of(ts) / 1e6,
    }
    if field not in fields:
        raise ValueError(f"unit {field!r} not recognized for type timestamp")
    return fields[field].cast("double")


def date_bin(stride_micros: int, ts: Column, origin: Column) -> Column:
    """The last multiple of the stride from the origin that isn't after ``ts``."""
    if stride_micros <= 0:
        raise ValueError("stride must be greater than zero")
    o = micros_of(origin)
    return from_micros(o + F.floor((micros_of(ts) - o) / stride_micros) * stride_micros)


def at_time_zone(ts: Column, zone: str) -> Column:
    """A zoneless timestamp read in ``zone``, as UTC wall time."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def in_time_zone(ts: Column, zone: str) -> Column:
    """A UTC timestamp as wall time in ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open periods in either order; a period without length is its instant."""
    a, b = F.least(s1, e1), F.greatest(s1, e1)
    c, d = F.least(s2, e2), F.greatest(s2, e2)
    return F.when(a == c, F.lit(True)).when(a > c, a < d).otherwise(c < b)


#: Template patterns of to_char and to_date that have a Java counterpart.
_PATTERNS = [
    ("YYYY", "yyyy"), ("YY", "yy"), ("MONTH", None), ("Month", "MMMM"), ("Mon", "MMM"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("Dy", "EEE"), ("Day", "EEEE"),
    ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("Q", "q"),
]


def java_pattern(template: str) -> str:
    """A template in Java's words; what has no counterpart is refused."""
    out, i = [], 0
    while i < len(template):
        for ours, java in _PATTERNS:
            if template.startswith(ours, i):
                if java is None:
                    raise ValueError(f"to_char pattern {ours!r} is not supported")
                out.append(java)
                i += len(ours)
                break
        else:
            c = template[i]
            if c == '"':
                end = template.index('"', i + 1)
                out.append("'" + template[i + 1 : end].replace("'", "''") + "'")
                i = end + 1
                continue
            if c.isalpha():
                raise ValueError(f"to_char pattern {template[i:]!r} is not supported")
            out.append(c)
            i += 1
    return "".join(out)


def _cased(text: Column, pattern: str) -> Column:
    return F.upper(text) if pattern.isupper() else F.lower(text) if pattern.islower() else text


def _pieces(ts: Column) -> dict[str, Callable[[bool], Column]]:
    """What each template pattern writes; the argument says whether blanks and zeros are left out (``FM``)."""
    number = lambda x, width: lambda bare: x.cast("string") if bare else F.when(F.length(x.cast("string")) < width, F.lpad(x.cast("string"), width, "0")).otherwise(x.cast("string"))
    name = lambda java, pattern: lambda bare: _cased(F.date_format(ts, java) if bare else F.rpad(F.date_format(ts, java), 9, " "), pattern)
    short = lambda java, pattern: lambda _: _cased(F.date_format(ts, java), pattern)
    hour, iso_year = F.hour(ts), F.extract(F.lit("YEAROFWEEK"), ts)
    fields: dict[str, Callable[[bool], Column]] = {
        "YYYY": number(F.year(ts), 4), "YY": number(F.year(ts) % 100, 2), "Y": number(F.year(ts) % 10, 1), "IYYY": number(iso_year, 4), "IY": number(iso_year % 100, 2),
        "CC": number(F.ceil(F.year(ts) / 100), 2), "Q": number(F.quarter(ts), 1), "MM": number(F.month(ts), 2), "WW": number(F.floor((F.dayofyear(ts) - 1) / 7) + 1, 2),
        "IW": number(F.weekofyear(ts), 2), "W": number(F.floor((F.day(ts) - 1) / 7) + 1, 1), "DDD": number(F.dayofyear(ts), 3), "DD": number(F.day(ts), 2), "D": number(F.dayofweek(ts), 1),
        "ID": number((F.dayofweek(ts) + 5) % 7 + 1, 1), "J": number(F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")) + 2440588, 1),
        "HH24": number(hour, 2), "HH12": number((hour + 11) % 12 + 1, 2), "HH": number((hour + 11) % 12 + 1, 2), "MI": number(F.minute(ts), 2), "SSSS": number(hour * 3600 + F.minute(ts) * 60 + F.second(ts), 1),
        "SS": number(F.second(ts), 2), "MS": short("SSS", "Ms"), "US": short("SSSSSS", "Us"),
    }
    for java, names in (("MMMM", ("MONTH", "Month", "month")), ("EEEE", ("DAY", "Day", "day"))):
        fields |= {p: name(java, p) for p in names}
    for java, names in (("MMM", ("MON", "Mon", "mon")), ("EEE", ("DY", "Dy", "dy")), ("a", ("AM", "PM", "am", "pm"))):
        fields |= {p: short(java, p) for p in names}
    return fields


def _ordinal(digits: Column) -> Column:
    ten = digits.cast("long") % 100
    one = ten % 10
    return F.when(ten.between(11, 13), "TH").when(one == 1, "ST").when(one == 2, "ND").when(one == 3, "RD").otherwise("TH")


def to_char(ts: Column, template: str) -> Column:
    """A timestamp by a template: names of months and days are blank-padded to nine characters,
    ``FM`` drops padding, ``TH`` and ``th`` after a number make it an ordinal, and quoted text stays."""
    fields = _pieces(ts)
    out: list[Column] = []
    i, bare = 0, False
    while i < len(template):
        if template.startswith("FM", i):
            i, bare = i + 2, True
            continue
        found = max((p for p in fields if template.startswith(p, i)), key=len, default=None)
        if found:
            piece = fields[found](bare)
            i, bare = i + len(found), False
            if template[i : i + 2] in ("TH", "th"):
                suffix = _ordinal(piece)
                piece = F.concat(piece, suffix if template[i] == "T" else F.lower(suffix))
                i += 2
            out.append(piece)
        elif template[i] == '"':
            end = template.index('"', i + 1)
            out.append(F.lit(template[i + 1 : end]))
            i = end + 1
        elif template[i].isalpha():
            raise ValueError(f"to_char pattern {template[i:]!r} is not supported")
        else:
            out.append(F.lit(template[i]))
            i += 1
    return F.concat(*out) if out else F.lit("")


def to_timestamp(text: Column, template: str) -> Column:
    return F.to_timestamp_ntz(text, F.lit(java_pattern(template)))


def to_date(text: Column, template: str) -> Column:
    return F.to_date(text, java_pattern(template))


def interval_plus(a: Column, b: Column) -> Column:
    return interval(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"])


def interval_minus(a: Column, b: Column) -> Column:
    return interval(a["months"] - b["months"], a["days"] - b["days"], a["micros"] - b["micros"])


def interval_times(a: Column, factor: Column) -> Column:
    """Parts of a month go to days of a thirtieth, and parts of a day to time."""
    f = factor.cast("double")
    toward = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    months = a["months"] * f
    days = a["days"] * f + F.round((months - toward(months)) * 30, 6)
    micros = a["micros"] * f + F.round((days - toward(days)) * DAY, 0)
    return interval(toward(months), toward(days), F.rint(micros))


def interval_over(a: Column, divisor: Column) -> Column:
    return interval_times(a, F.lit(1.0) / divisor)


def justify_interval(a: Column) -> Column:
    """Full days of time become days and full thirties of days months, with all parts of one sign."""
    micros = a["micros"] + (a["days"] + a["months"].cast("long") * 30).cast("long") * DAY
    sign = F.when(micros < 0, -1).otherwise(1)
    size = F.abs(micros)
    days = F.floor(size / DAY).cast("long")
    return interval(sign * F.floor(days / 30), sign * (days % 30), sign * (size % DAY))


def interval_text(a: Column) -> Column:
    """The default style: ``1 year 2 mons -3 days 04:05:06.7``."""
    unit = lambda n, one: F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s")))
    years = F.when(a["months"] < 0, F.ceil(a["months"] / 12)).otherwise(F.floor(a["months"] / 12)).cast("int")
    size = F.abs(a["micros"])
    seconds = F.floor(size / 1_000_000).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours = F.floor(seconds / 3600).cast("string")
    part = F.regexp_replace(F.concat(F.lit("."), F.lpad((size % 1_000_000).cast("string"), 6, "0")), r"\.?0+$", "")
    clock = F.concat(F.when(a["micros"] < 0, "-").otherwise(""), F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60), part)
    empty = (a["months"] == 0) & (a["days"] == 0)
    return F.concat_ws(" ", unit(years, "year"), unit(a["months"] - years * 12, "mon"), unit(a["days"], "day"), F.when((a["micros"] != 0) | empty, clock))


def isfinite(x: Column) -> Column:
    """Dates and timestamps read from files are finite; the texts of infinity aren't."""
    return ~F.lower(x.cast("string")).isin("infinity", "-infinity")
