"""COPY in text and CSV form, read and written as lines by Spark.

Text form: tab between fields, ``\\N`` for null, backslash escapes, ``\\.`` ends the
data.  CSV form: an unquoted null string is null and a quoted one isn't, which
Spark's own CSV reader can't tell apart; a quoted field may not hold a line
break here, as lines are split before they are parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def decode_text(line: str, delimiter: str = "\t", null: str = "\\N") -> list[str | None]:
    """Fields of one line of the text form."""
    fields: list[str | None] = []
    raw, out, i = [], [], 0

    def end() -> None:
        fields.append(None if "".join(raw) == null else "".join(out))
        raw.clear()
        out.clear()

    while i < len(line):
        c = line[i]
        if c == delimiter:
            end()
        elif c == "\\" and i + 1 < len(line):
            i += 1
            e = line[i]
            raw.append("\\" + e)
            if e in "01234567":
                j = i
                while j < len(line) and j < i + 3 and line[j] in "01234567":
                    j += 1
                out.append(chr(int(line[i:j], 8) & 255))
                i = j - 1
            elif e == "x" and i + 1 < len(line) and line[i + 1] in "0123456789abcdefABCDEF":
                j = i + 1
                while j < len(line) and j < i + 3 and line[j] in "0123456789abcdefABCDEF":
                    j += 1
                out.append(chr(int(line[i + 1 : j], 16)))
                i = j - 1
            else:
                out.append(_ESCAPES.get(e, e))
        else:
            raw.append(c)
            out.append(c)
        i += 1
    end()
    return fields


def decode_csv(line: str, delimiter: str = ",", quote: str = '"', escape: str | None = None, null: str = "", force_null: frozenset[int] = frozenset(), force_not_null: frozenset[int] = frozenset()) -> list[str | None]:
    """Fields of one CSV line; the sets hold field numbers from 0."""
    escape = quote if escape is None else escape
    fields: list[str | None] = []
    out, quoted, inside, i = [], False, False, 0

    def end() -> None:
        text, k = "".join(out), len(fields)
        empty = text == null and (k in force_null or (not quoted and k not in force_not_null))
        fields.append(None if empty else text)
        out.clear()

    while i < len(line):
        c = line[i]
        if inside:
            if c == escape and i + 1 < len(line) and line[i + 1] in (quote, escape):
                i += 1
                out.append(line[i])
            elif c == quote:
                inside = False
            else:
                out.append(c)
        elif c == quote:
            inside = quoted = True
        elif c == delimiter:
            end()
            quoted = False
        else:
            out.append(c)
        i += 1
    end()
    return fields


def read(
    spark: SparkSession, path: str, schema: T.StructType, form: str = "text", header: bool = False, where: Column | None = None,
    on_error: str = "stop", reject_limit: int | None = None, force_null: list[str] = (), force_not_null: list[str] = (), **options: str,
) -> DataFrame:
    """``COPY ... FROM``: lines to typed rows.  With ``on_error='ignore'`` rows that don't convert are
    left out, and more than ``reject_limit`` of them are an error.  A file ends at its line ``\\.``, and
    with ``header`` its first line is left out."""
    names = schema.names
    sets = {"force_null": frozenset(map(names.index, force_null)), "force_not_null": frozenset(map(names.index, force_not_null))} if form == "csv" else {}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = decode_text if form == "text" else decode_csv
        for batch in batches:
            yield pd.DataFrame({"fields": [work(x, **options, **sets) for x in batch["value"]]})

    # lines keep their order within a block of a file, and blocks theirs within the file
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), place.alias("__at"))
    ends = lines.groupBy("__file").agg(F.min("__at").alias("__first"), F.min(F.when(F.col("value") == "\\.", F.col("__at"))).alias("__end"))  # one row a file
    lines = lines.join(ends, "__file").where("__end is null or __at < __end")
    if header:
        lines = lines.where("__at <> __first")
    lines = lines.select("value")
    fields = lines.mapInPandas(decode, "fields array<string>")
    width = F.size("fields")
    bad = width != len(names)
    converted = []
    for i, f in enumerate(schema.fields):
        value = F.get("fields", i)
        new = value.try_cast(f.dataType)
        bad = bad | (value.isNotNull() & new.isNull())
        converted.append(new.alias(f.name))
    rows = fields.select(bad.alias("__bad"), *converted)
    if on_error == "ignore":
        if reject_limit is not None and (n := rows.where("__bad").count()) > reject_limit:
            raise ValueError(f"skipped more than REJECT_LIMIT ({reject_limit}) rows: {n}")
        rows = rows.where("not __bad").drop("__bad")
    else:
        failed = F.raise_error(F.lit("a line has the wrong number of fields or a value that does not convert")).cast("boolean")
        rows = rows.where(~F.when(F.col("__bad"), failed).otherwise(F.lit(False))).drop("__bad")
    return rows.where(where) if where is not None else rows


def text_lines(df: DataFrame, delimiter: str = "\t", null: str = "\\N") -> DataFrame:
    """``COPY ... TO`` in text form, as one column ``value``."""
    special = r"([\\" + ("\\t" if delimiter == "\t" else "\\" + delimiter) + r"])"

    def field(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        out = F.regexp_replace(text, special, r"\\$1")
        for c, e in (("\n", "n"), ("\r", "r"), ("\b", "b"), ("\f", "f"), ("\v", "v")):
            out = F.replace(out, F.lit(c), F.lit("\\" + e))
        return F.coalesce(out, F.lit(null))

    return df.select(F.concat_ws(delimiter, *map(field, df.columns)).alias("value"))


def csv_lines(df: DataFrame, delimiter: str = ",", quote: str = '"', null: str = "", force_quote: list[str] = ()) -> DataFrame:
    """``COPY ... TO`` in CSV form; a text that looks like the null string is quoted."""

    def field(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        needs = F.contains(text, F.lit(delimiter)) | F.contains(text, F.lit(quote)) | text.rlike("[\r\n]") | (text == null)
        quoted = F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
        return F.when(text.isNull(), F.lit(null)).when(F.lit(name in force_quote) | needs, quoted).otherwise(text)

    return df.select(F.concat_ws(delimiter, *map(field, df.columns)).alias("value"))
