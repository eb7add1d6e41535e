"""Row changes as DataFrames: the table after the change, the rows returned, and checks.

Files have no rows to update, so a change is the old table joined with its
source, written to a new place and put there in one move.  The functions return
frames; :func:`overwrite` writes one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A row to be written breaks a constraint; ``sqlstate`` says which kind."""

    def __init__(self, sqlstate: str, message: str) -> None:
        super().__init__(message)
        self.sqlstate = sqlstate


def _on(keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(f"t.{k}") == F.col(f"s.{k}"))
    return condition


def _null_key(keys: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(k).isNull() for k in keys], F.lit(False))


def insert_do_nothing(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``ON CONFLICT DO NOTHING``: the table after, and the rows that went in (the first of each key).
    A key with a null conflicts with none."""
    source = source.where(~_null_key(keys)).dropDuplicates(keys).unionByName(source.where(_null_key(keys)))
    fresh = source.alias("s").join(target.alias("t"), _on(keys), "left_anti").select(*target.columns)
    return target.unionByName(fresh), fresh


def upsert(target: DataFrame, source: DataFrame, keys: list[str], changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """``ON CONFLICT DO UPDATE SET ... WHERE``: in ``changes`` and ``where``, ``t.`` is the row that is
    there and ``s.`` the one proposed.  A key that the source proposes twice is an error."""
    source = _once(source, keys)
    joined = target.withColumn("__t", F.lit(True)).alias("t").join(source.withColumn("__s", F.lit(True)).alias("s"), _on(keys), "full")
    there, here = F.col("__t").isNotNull(), F.col("__s").isNotNull()
    hit = there & here & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    out = [F.when(hit, changes[c]).when(there, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) if c in changes else F.when(there, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in target.columns]
    return joined.select(*out)


def _once(source: DataFrame, keys: list[str]) -> DataFrame:
    """Raises, when it runs, if a key comes twice; keys with a null are never the same."""
    from pyspark.sql import Window

    bad = F.raise_error(F.lit("command cannot affect row a second time")).cast("long")
    n = F.count("*").over(Window.partitionBy(*keys))
    known = source.where(~_null_key(keys)).withColumn("__n", F.when(n > 1, bad).otherwise(n)).where("__n = 1").drop("__n")
    return known.unionByName(source.where(_null_key(keys)))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """``UPDATE ... FROM``: rows without a match stay as they are."""
    joined = target.alias("t").join(_once(source, keys).withColumn("__s", F.lit(True)).alias("s"), _on(keys), "left")
    hit = F.col("__s").isNotNull() & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    return joined.select(*[F.when(hit, changes[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in changes else F.col(f"t.{c}") for c in target.columns])


def delete_using(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``DELETE ... USING``: the table after, and the rows that went."""
    t, s = target.alias("t"), source.alias("s")
    return t.join(s, _on(keys), "left_anti"), t.join(s, _on(keys), "left_semi")


@dataclass
class When:
    """A clause of MERGE: ``matched`` with ``update``, ``delete`` or nothing, or not matched with ``insert``."""

    matched: bool
    condition: Column | None = None
    update: dict[str, Column] | None = None
    delete: bool = False
    insert: dict[str, Column] | None = None
    index: int = field(default=0)


def merge(target: DataFrame, source: DataFrame, keys: list[str], clauses: list[When]) -> DataFrame:
    """The table after ``MERGE``: each row takes the first clause that applies to it."""
    joined = target.withColumn("__t", F.lit(True)).alias("t").join(_once(source, keys).withColumn("__s", F.lit(True)).alias("s"), _on(keys), "full")
    there, here = F.col("__t").isNotNull(), F.col("__s").isNotNull()
    choice = None
    for i, w in enumerate(clauses):
        applies = (there & here if w.matched else ~there & here) & (F.coalesce(w.condition, F.lit(False)) if w.condition is not None else F.lit(True))
        choice = F.when(applies, i) if choice is None else choice.when(applies, i)
    joined = joined.withColumn("__c", F.coalesce(choice, F.lit(-1)) if choice is not None else F.lit(-1))
    gone = F.lit(False)
    values = {c: F.col(f"t.{c}") for c in target.columns}
    for i, w in enumerate(clauses):
        own = F.col("__c") == i
        gone = gone | (own & F.lit(w.delete))
        for c in target.columns:
            new = (w.update or {}).get(c) if w.matched else (w.insert or {}).get(c, F.lit(None)) if w.insert is not None else None
            if new is not None:
                values[c] = F.when(own, new).otherwise(values[c])
    inserted = F.col("__c").isin([i for i, w in enumerate(clauses) if w.insert is not None] or [-2])
    return joined.where((there | inserted) & ~gone).select(*[values[c].cast(target.schema[c].dataType).alias(c) for c in target.columns])


@dataclass
class Constraints:
    """What rows must hold before they are written."""

    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: dict[str, Column] = field(default_factory=dict)
    foreign_keys: list[tuple[list[str], DataFrame, list[str]]] = field(default_factory=list)
    defaults: dict[str, Column] = field(default_factory=dict)
    generated: dict[str, Column] = field(default_factory=dict)

    def filled(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Missing columns from their defaults, generated ones from the others."""
        for c in columns:
            if c not in df.columns and c not in self.generated:
                df = df.withColumn(c, self.defaults.get(c, F.lit(None)))
        for c, v in self.generated.items():
            df = df.withColumn(c, v)
        return df.select(*columns)

    def validate(self, df: DataFrame) -> DataFrame:
        """``df`` itself if all hold, else an error; a check that is null holds."""
        for c in self.not_null:
            if not df.where(F.col(c).isNull()).isEmpty():
                raise ConstraintError("23502", f'null value in column "{c}" violates not-null constraint')
        for name, check in self.checks.items():
            if not df.where(~F.coalesce(check, F.lit(True))).isEmpty():
                raise ConstraintError("23514", f'new row violates check constraint "{name}"')
        for keys in self.unique:
            whole = F.lit(True)
            for k in keys:
                whole = whole & F.col(k).isNotNull()
            if not df.where(whole).groupBy(*keys).count().where("count > 1").isEmpty():
                raise ConstraintError("23505", f"duplicate key value violates unique constraint on {', '.join(keys)}")
        for keys, parent, of in self.foreign_keys:
            whole = F.lit(True)
            match = F.lit(True)
            for k, p in zip(keys, of, strict=True):
                whole = whole & F.col(k).isNotNull()
                match = match & (F.col(f"c.{k}") == F.col(f"p.{p}"))
            if not df.where(whole).alias("c").join(parent.alias("p"), match, "left_anti").isEmpty():
                raise ConstraintError("23503", f"row violates foreign key constraint on {', '.join(keys)}")
        return df


def overwrite(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and rename, so that ``df`` may read ``path`` itself."""
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    jvm = spark.sparkContext._jvm
    of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{path}.{uuid.uuid4().hex}"
    if fs.exists(of(path)):
        fs.rename(of(path), of(old))
    fs.rename(of(beside), of(path))
    fs.delete(of(old), True)


@dataclass
class MaterializedView:
    """A stored query and the rows it last gave."""

    path: str
    query: Callable[[], DataFrame]

    def refresh(self) -> None:
        overwrite(self.query(), self.path)

    def read(self) -> DataFrame:
        df = self.query()
        return df.sparkSession.read.parquet(self.path)
