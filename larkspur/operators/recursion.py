"""``WITH RECURSIVE`` as a loop of DataFrame steps on the driver, which holds no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def _cut(df: DataFrame) -> DataFrame:
    from larkspur.operators.checkpoints import checkpointed

    return checkpointed(df)


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most: int = 1000) -> DataFrame:
    """Rows of ``seed`` and of ``step`` on the rows that the round before added, until it adds none.

    With ``distinct`` (``UNION``) rows seen before are left out by an anti join.
    Each round is cut by a checkpoint; more than ``most`` rounds are an error.
    """
    rows = _cut(seed.distinct() if distinct else seed)
    seen = rows
    for _ in range(most):
        fresh = step(rows).toDF(*seed.columns)
        if distinct:
            fresh = fresh.distinct().exceptAll(seen)
        rows = _cut(fresh)
        if rows.isEmpty():
            return seen
        seen = seen.unionAll(rows)
    raise RecursionError(f"no end after {most} rounds")
