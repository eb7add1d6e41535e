"""Window frames that Spark's grammar lacks: GROUPS and EXCLUDE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows that a task sorts, about, unless one partition has more.
PER_TASK = 500_000


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], low: int, high: int, **aggregates: Column) -> DataFrame:
    """Adds aggregates over ``GROUPS BETWEEN -low PRECEDING AND high FOLLOWING``.

    Peer groups are numbered by ``dense_rank``; a RANGE frame over the number is
    a GROUPS frame over the rows.
    """
    df = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy("__peer").rangeBetween(low, high)
    return df.select("*", *[a.over(frame).alias(name) for name, a in aggregates.items()]).drop("__peer")


def exclude(df: DataFrame, partition: list[str], order: list[Column], value: str, what: str, low: int | None = None, high: int | None = None, name: str = "sum") -> DataFrame:
    """Adds sum, count, min, max and avg of ``value`` over ``GROUPS BETWEEN low AND high`` without the
    current row (``row``), its peers (``group``) or its other peers (``ties``); ``low`` and ``high``
    count peer groups from the current one, null is unbounded.

    What stays is put together from the frame's parts: the groups before the
    current one, those after it, and of the current one, if the frame holds it,
    the rows that stay.  Nothing is subtracted, so any frame and any of the
    aggregates is right.  Frames run over one row for each peer group, joined
    to the group's rows; only ``row`` sorts those again, by peer group.  Rows
    are counted first: tasks get about ``PER_TASK`` each, however many there are.
    """
    start = Window.unboundedPreceding if low is None else low
    end = Window.unboundedFollowing if high is None else high
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PER_TASK))
    if partition:
        df = df.repartition(tasks, *partition)
    df = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    # the key of a peer group is never null, and nulls in it are equal
    key, names = F.struct(*partition, "__peer"), df.columns[:-1]
    keys, v = [f"__p{i}" for i in range(len(partition))], F.col(value)
    groups = df.groupBy(*[F.col(p).alias(k) for p, k in zip(partition, keys, strict=True)], F.col("__peer").alias("__at")).agg(
        F.sum(v).alias("__sum"), F.count(v).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max")
    )
    summed = groups.schema["__sum"].dataType
    onward, back = Window.partitionBy(*keys).orderBy("__at"), Window.partitionBy(*keys).orderBy(F.desc("__at"))
    before = []
    if start <= -1:
        before.append(onward.rangeBetween(start, min(end, -1)))
    if end >= 1:  # a frame without an end is run through from there
        before.append(back.rangeBetween(Window.unboundedPreceding, -max(start, 1)) if high is None else onward.rangeBetween(max(start, 1), end))
    columns = []
    for i, w in enumerate(before):
        columns += [F.sum("__sum").over(w).cast(summed).alias(f"__sum{i}"), F.sum("__n").over(w).alias(f"__n{i}"), F.min("__min").over(w).alias(f"__min{i}"), F.max("__max").over(w).alias(f"__max{i}")]
    at, rows = [*range(len(before))], df.withColumn("__key", key).repartition(tasks, "__key").drop("__peer")  # the parts, and what their columns are added to
    if start <= 0 <= end:
        if what == "row":
            peers = Window.partitionBy("__key")
            number = F.row_number().over(peers.orderBy(v)).alias("__row")
            rows = rows.select("*", number, *_all_before(v, peers.orderBy(v), "l"))
            rows = rows.select("*", *_all_before(v, peers.orderBy(F.desc("__row")), "r"))
            at += ["l", "r"]
        elif what == "no others":
            columns += [F.col(f"__{x}").alias(f"__{x}g") for x in ("sum", "n", "min", "max")]
            at += ["g"]
        elif what == "ties":
            rows = rows.select("*", v.alias("__sumo"), v.isNotNull().cast("long").alias("__no"), v.alias("__mino"), v.alias("__maxo"))
            at += ["o"]
    out = rows.join(groups.select(F.struct(*[F.col(k).alias(p) for p, k in zip(partition, keys, strict=True)], F.col("__at").alias("__peer")).alias("__key"), *columns), "__key")
    n = reduce(Column.__add__, [F.coalesce(F.col(f"__n{i}"), F.lit(0)) for i in at], F.lit(0).cast("long"))
    zero = F.lit(0).cast(df.schema[value].dataType)
    total = F.when(n > 0, reduce(Column.__add__, [F.coalesce(F.col(f"__sum{i}"), zero) for i in at], zero))
    none = F.lit(None).cast(df.schema[value].dataType)
    return out.select(
        *names, total.alias(f"{name}_sum"), n.alias(f"{name}_count"), (total / F.nullif(n, F.lit(0))).alias(f"{name}_avg"),
        F.least(none, none, *[F.col(f"__min{i}") for i in at]).alias(f"{name}_min"), F.greatest(none, none, *[F.col(f"__max{i}") for i in at]).alias(f"{name}_max"),
    )


def _all_before(v: Column, by: WindowSpec, part: str) -> list[Column]:
    w = by.rowsBetween(Window.unboundedPreceding, -1)
    return [F.sum(v).over(w).alias(f"__sum{part}"), F.count(v).over(w).alias(f"__n{part}"), F.min(v).over(w).alias(f"__min{part}"), F.max(v).over(w).alias(f"__max{part}")]


def lag_by(df: DataFrame, partition: list[str], order: list[Column], value: str, offset: Column, name: str, default: Column | None = None) -> DataFrame:
    """``lag`` with an offset of the row's own: a join on the row number, no gathering of partitions."""
    by = Window.partitionBy(*partition).orderBy(*order)
    rows = df.withColumn("__rn", F.row_number().over(by))
    source = rows.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(partition)], F.col("__rn").alias("__at"), F.col(value).alias("__v"))
    match = F.col("__at") == F.col("__rn") - offset
    for i, p in enumerate(partition):
        match = match & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    out = rows.join(source, match, "left")
    found = F.when(F.col("__at").isNotNull(), F.col("__v")).otherwise(default if default is not None else F.lit(None))
    return out.withColumn(name, found).select(*df.columns, name)


def ntile(n: int) -> Column:
    """Fewer than one bucket counts as one."""
    return F.ntile(max(1, n))
