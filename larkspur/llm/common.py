"""Shared pieces of the corpus operators: document keys, byte hashing, components.

Documents are told apart by ``(d, tag)``: ``d`` is ``doc_id`` (a null counts as
the smallest long) and ``tag`` is a 64-bit hash of the whole text, so rows that
share a ``doc_id`` but differ in text stay apart, and rows that repeat both are
one document given twice.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LONG = -(1 << 63)
#: Spark's setting that removes an action's shuffle files when the action has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Links in one file of a round of :func:`components`, about.
LINKS_A_FILE = 100_000

Batches = Iterator[pa.RecordBatch]


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of its own only for a local session without any."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Actions begun inside leave no shuffle files: what they made is a table or a checkpoint by then."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the checkpoint folder."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    with shuffles_dropped(spark):
        return df.select("*").checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut lineage like :func:`checkpointed`, as a compressed table in a new folder there."""
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which the worker gives back free memory: workers outlive tasks and stages, and
    what one stage needed at its peak stays with them else."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim is not None:
                trim(0)

    return whole


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch as well as its rows: texts may be long."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
    now = spark.conf.get(key).strip().lower().removesuffix("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """``(d, tag, row)`` with the whole input row packed, so no extra column can clash."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)).alias("d"),
        F.xxhash64(text).alias("tag"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
    )


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of at most ``most`` bytes (a longer row comes alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RollingHash:
    """Polynomial hashes, modulo 2^64, of any substring of one byte buffer."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 62, dtype=np.uint64)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("powers", self.base), ("inverses", self.inverse)):
                    steps = np.full(size, base % (1 << 64), np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverses[start]


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ``[start, start + length)`` for all ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return first + np.arange(total)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: ``(node, component)``, the smallest node.

    Alternates the large-star and small-star steps, so hubs never expand into
    pairs; each round is one aggregation and one join on the node, cut by a
    checkpoint.  Only nodes of at least one edge come back.

    No round has more links than the first, so a round writes as many files as
    those ask for and not one for each shuffle partition.
    """
    spark = edges.sparkSession
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = checkpointed(links)
    files = max(spark.sparkContext.defaultParallelism, -(-links.count() // LINKS_A_FILE))
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour goes to the smallest node around u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours go to the smallest of them
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct().coalesce(files))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
