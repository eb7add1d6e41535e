"""Chat formatting from event logs, in DataFrame expressions only.

A log has rows ``(conv_id, seq, turn, op, role, text)``.  Within a turn a
``message``, ``edit`` or ``regenerate`` row replaces what came before and
``delta`` rows append to it; ``delete`` removes the turn.  Logs are folded by
conversation and turn, then rendered by conversation in order of turn.

The template of a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and
roles every ``<``, run of ``\\`` and ``|`` gains one ``\\``, so no control string
is left in them; taking one away again gives back every text.  A line break or
``%`` in a role is percent-coded.  The loss mask covers assistant texts.

Null roles and texts are empty; a null ``conv_id`` is a conversation of its own.
Replacing rows of one conversation and turn that tie in ``seq`` are messages of
their own in the order of role and text, repeated ones too, and deltas append to
the last of them.  Deltas with nothing before them begin a message.  A null
``seq`` comes first and a null turn last.  Long conversations are put together in chunks of ``CHUNK`` turns, so
that what meets in one row is the rendered text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.quality import let

START, END = "<|im_start|>", "<|im_end|>"
CHUNK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def fold(log: DataFrame) -> DataFrame:
    """The log's final messages: ``(conv_id, turn, role, text)``.

    The rows that matter, from the last replacing one on, are found by a
    maximum, so nothing that was replaced is gathered.
    """
    replaces = F.col("op").isin("message", "edit", "regenerate", "delete")
    last = log.groupBy("conv_id", "turn").agg(F.max(F.when(replaces, F.col("seq"))).alias("since"))
    same = F.expr("a.conv_id <=> b.conv_id and a.turn <=> b.turn")
    live = log.alias("a").join(last.alias("b"), same).where("since is null or seq >= since").select("a.*", "since")
    late = F.when(replaces, 0).otherwise(1).alias("late")
    part = F.struct("seq", late, "role", F.coalesce("text", F.lit("")).alias("text"), "op")
    parts = live.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("since").alias("since"))
    gone = F.exists("parts", lambda p: (p["op"] == "delete") & p["seq"].eqNullSafe(F.col("since")))
    first, more = F.filter("parts", lambda p: p["late"] == 0), F.filter("parts", lambda p: p["late"] == 1)
    role = F.get(F.filter("more", lambda p: p["role"].isNotNull()), 0)["role"]
    added = F.array_join(F.transform("more", lambda p: p["text"]), "")

    def message(p: Column, i: Column) -> Column:
        last = i == F.size("first") - 1
        return F.struct(F.when(last, F.coalesce(p["role"], role)).otherwise(p["role"]).alias("role"), F.when(last, F.concat(p["text"], added)).otherwise(p["text"]).alias("text"))

    alone = F.array(F.struct(role.alias("role"), added.alias("text")))
    split = parts.where(~gone).select("conv_id", "turn", first.alias("first"), more.alias("more"))
    said = split.select("conv_id", "turn", F.explode(F.when(F.size("first") == 0, alone).otherwise(F.transform("first", message))).alias("said"))
    return said.select("conv_id", "turn", "said.role", "said.text")


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted)`` of rows ``(conv_id, turn, role, text)``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))
    turns = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"), one.alias("one"), F.expr(f"turn div {CHUNK}").alias("chunk"))
    ordered = F.sort_array(F.collect_list(F.struct(F.isnull("turn").alias("none"), "turn", "role", "text", "one")))
    joined = lambda key, what: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.isnull(key).alias("none"), key, what))), lambda x: x[what]), "")
    chunks = turns.groupBy("conv_id", "chunk").agg(F.array_join(F.transform(ordered, lambda x: x["one"]), "").alias("body"))
    return chunks.groupBy("conv_id").agg(joined("chunk", "body").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation as ``array<struct<role, text>>``."""

    def turn(x: Column) -> Column:
        at = F.locate("\n", x)
        role = F.substring(x, F.lit(len(START) + 1), at - (len(START) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(x, at + 1, F.length(x))).alias("text"))

    # what follows the last end mark is empty
    return let(F.split(formatted, r"<\|im_end\|>\n"), lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))


def masked(turns: Column) -> Column:
    """All text under the loss mask, in order."""
    said = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.array_join(F.transform(said, lambda t: t["text"]), "")
