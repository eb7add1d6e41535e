"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

A source's documents, in the order of a hash, are cut into blocks of
``block_chars`` characters.  With integer shares ``a`` of a period of ``D``
slots, block ``j`` of a source is released at slot ``floor(j D / a)`` and due by
``ceil((j + 1) D / a)``; taking the released block of the earliest deadline in
each slot keeps every source within less than one block of its share.  The
schedule repeats after a period, so one period is made on the driver and a
block's slot is arithmetic.  When a source ends, the others go on with a period
of their own, so no document is dropped or given twice.

The period has as many slots as there are blocks, up to ``MOST_SLOTS`` for all
sources together: then the shares are the weights to within half a block over
the whole corpus.  A longer corpus repeats the period, and each repetition adds
at most half a block to the distance from the real weight.

Documents aren't cut: one belongs to the block in which it begins, so one longer
than a block takes a slot alone and its later blocks' slots stay empty.  The
bound holds for the beginnings of documents.

Weights are not negative; sources of weight 0 come after all others, in equal
shares.  At most ``most_sources`` are mixed, which bounds what the driver sees
(one row a source) and the schedule; more raise an error.  Ranks within a source
are prefix sums over hash buckets and then within a bucket, so that a source of
any size is spread out.

A null source counts as the empty name; null texts have no characters.  Rows
that repeat are told apart by position only and all stay.  An empty table gives
no rows.  Extra columns are carried in ``row``.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import keyed

BLOCK_CHARS = 20_000
#: Slots of a period at least, and of the periods of all phases at most.
PERIOD, MOST_SLOTS = 1000, 1 << 20
MOST_SOURCES = 512
#: Documents in a bucket of a source, about.
BUCKET = 2000


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Integer shares of the period, at least one each, by largest remainder."""
    total = sum(weights.values())
    period = max(period, len(weights))
    exact = {s: period * w / total for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    by = sorted(weights, key=lambda s: (out[s] - exact[s], s))
    left = period - sum(out.values())
    for s in by[: max(0, left)]:
        out[s] += 1
    while left < 0:  # the least shares were raised to one
        s = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -period, s))
        out[s] -= 1
        left += 1
    return out


def edf(a: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period: earliest deadline first among the released."""
    period = sum(a.values())
    slots: dict[str, list[int]] = {s: [] for s in a}
    ahead = [(0, s, 0) for s in sorted(a)]  # by release
    ready: list[tuple[int, str, int]] = []  # by deadline
    for t in range(period):
        while ahead and ahead[0][0] <= t:
            _, s, j = heapq.heappop(ahead)
            heapq.heappush(ready, (-(-(j + 1) * period // a[s]), s, j))
        _, s, j = heapq.heappop(ready)
        slots[s].append(t)
        if j + 1 < a[s]:
            heapq.heappush(ahead, ((j + 1) * period // a[s], s, j + 1))
    return slots


def phases(a: dict[str, int], blocks: dict[str, int], base: int = 0) -> list[dict]:
    """Rows ``(source, low, high, base, share, period, offsets)`` for blocks ``low <= i < high``.

    A phase lasts while its sources last; in its last period a source that runs
    out leaves its slots unused.
    """
    done, rows = dict.fromkeys(a, 0), []
    live = {s: k for s, k in a.items() if blocks.get(s)}
    while live:
        period, slots = sum(live.values()), edf(live)
        rounds = min(-(-(blocks[s] - done[s]) // live[s]) for s in live)
        for s, k in live.items():
            high = min(blocks[s], done[s] + rounds * k)
            rows.append({"source": s, "low": done[s], "high": high, "base": base, "share": k, "period": period, "offsets": slots[s]})
            done[s] = high
        base += rounds * period
        live = {s: k for s, k in live.items() if done[s] < blocks[s]}
    return rows


def schedule(weights: dict[str, float], blocks: dict[str, int], period: int | None = None) -> list[dict]:
    """The phases of all sources of ``blocks``; those of weight 0 come last."""
    if any(not 0 <= w < math.inf for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    most = max(PERIOD, sum(blocks.values()))
    rows: list[dict] = []
    for own in ({s: w for s, w in weights.items() if w > 0}, {s: 1.0 for s, w in weights.items() if w == 0}):
        if own:
            base = max((r["base"] + -(-(r["high"] - r["low"]) // r["share"]) * r["period"] for r in rows), default=0)
            rows += phases(shares(own, period or max(len(own), min(most, MOST_SLOTS // len(weights)))), blocks, base)
    return rows


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, period: int | None = None, most_sources: int = MOST_SOURCES
) -> DataFrame:
    """Per row of ``docs``: ``row``, ``source``, ``block``, ``slot`` and ``place`` within the slot.

    ``weights`` default to the square roots of the sources' characters; a source
    that isn't named gets the least weight named.
    """
    spark = docs.sparkSession
    order = F.xxhash64("d", "tag")
    base = keyed(docs).select(
        "d", "tag", "row", F.coalesce(F.col("row.source").cast("string"), F.lit("")).alias("source"),
        F.length(F.coalesce(F.col("row.text"), F.lit(""))).cast("long").alias("size"), order.alias("o"),
    )
    buckets = max(1, -(-docs.count() // BUCKET))
    # the hash's upper 32 bits, from 0, cut into equal ranges
    base = base.withColumn("bucket", F.shiftrightunsigned(F.shiftright("o", 32).cast("long").bitwiseXOR(-(1 << 31)).bitwiseAND((1 << 32) - 1) * buckets, 32))
    held = base.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    by = Window.partitionBy("source").orderBy("bucket")
    before = held.select("source", "bucket", (F.sum("held").over(by) - F.col("held")).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("o", "d", "tag").rowsBetween(Window.unboundedPreceding, 0)
    ranked = base.join(before, ["source", "bucket"]).withColumn("place", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    ranked = ranked.withColumn("block", F.expr(f"place div {block_chars}"))

    totals = {r["source"]: r["n"] for r in held.groupBy("source").agg(F.sum("held").alias("n")).limit(most_sources + 1).collect()}
    if len(totals) > most_sources:
        raise ValueError(f"there are more than {most_sources} sources: join rare ones, or raise most_sources")
    if weights is None:
        weights = {s: math.sqrt(max(n, 1)) for s, n in totals.items()}
    least = min(weights.values(), default=1.0)
    named = {s: weights.get(s, least) for s in totals}
    # a document of no characters may lie just past the last full block
    blocks = {s: n // block_chars + 1 for s, n in totals.items()}
    kind = "source string, low bigint, high bigint, base bigint, share bigint, period bigint, offsets array<bigint>"
    plan = spark.createDataFrame([tuple(r.values()) for r in schedule(named, blocks, period)], kind)
    j = F.col("block") - F.col("low")
    slot = F.col("base") + F.expr("(block - low) div share") * F.col("period") + F.get("offsets", (j % F.col("share")).cast("int"))
    out = ranked.join(F.broadcast(plan), ["source"]).where("block >= low and block < high")  # at most MOST_SLOTS offsets in all
    return out.select("row", "source", "size", "block", slot.alias("slot"), "place", "o")


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mix (a range-partitioned sort)."""
    return mix(docs, **options).orderBy("slot", "place", "o").select("row.*")
