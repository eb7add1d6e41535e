"""URL filtering by listed hosts and path prefixes.

A rule ``(host, path, verdict)`` fits its host and all subdomains, if the url's
path starts with the rule's; the longest ``host + path`` wins, then the longer
host, then ``block``.  A url's candidates are its host's suffixes, label by
label, with the prefixes of its path that are as long as some rule's.  A blocked
Bloom filter of the rules' keys passes possible hits, which an exact hash join
with the rules confirms or drops.

The filter has 512 bits a block and at most ``MOST_BITS`` bits (32 MB), so it can
be broadcast whatever the list's length; more than some 16 million rules only
make more false hits for the join.  The join is Spark's own choice by the rules'
size.  Urls are tested where they are read, and only keys that hit are joined.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  A null url, or one
without ``://``, has neither and fits no rule.  Repeated rows each get a result;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import mixed

BLOCK_WORDS = 8
MOST_BITS = 1 << 28
BITS_A_KEY = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def bits_of(keys: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each key's block, and one bit for each of them."""
    h = pd.util.hash_array(np.array(keys, object), categorize=False)
    word = (h % np.uint64(blocks)).astype(np.int64)[:, None] * BLOCK_WORDS + np.arange(BLOCK_WORDS)
    bit = mixed(h ^ np.uint64(0x9E3779B97F4A7C15))[:, None] >> np.arange(0, 6 * BLOCK_WORDS, 6, dtype=np.uint64) & np.uint64(63)
    return word, np.uint64(1) << bit


def bloom(keys: DataFrame, blocks: int) -> np.ndarray:
    """The filter's words from a column ``key``: each task sets its bits, Spark ors them by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(blocks * BLOCK_WORDS, np.uint64)
        for batch in batches:
            if len(batch):
                np.bitwise_or.at(words, *bits_of(batch.column("key").to_pylist(), blocks))
        some = np.flatnonzero(words)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], names=["word", "bits"])

    rows = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()  # at most MOST_BITS / 64
    out = np.zeros(blocks * BLOCK_WORDS, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)`` for each row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``; ``otherwise`` is the verdict
    on urls that no rule fits.
    """
    spark = pages.sparkSession
    listed = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null")
    listed = listed.withColumn("key", F.concat("host", "path"))
    listed = listed.groupBy("key", "host", "path").agg(F.max("verdict").alias("rule_verdict"))  # block before allow
    size = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()
    lengths = sorted(size["lengths"])  # of paths, so few
    blocks = max(1, min(MOST_BITS, size["n"] * BITS_A_KEY) // (64 * BLOCK_WORDS))
    words = spark.sparkContext.broadcast(bloom(listed.select("key"), blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], np.zeros(len(batch), np.int64)
            for r, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                before = len(keys)
                prefixes = [path[:n] for n in lengths if n <= len(path)]
                while host:
                    keys += [host + p for p in prefixes]
                    host = host.partition(".")[2]
                counts[r] = len(keys) - before
            if keys:
                word, bit = bits_of(keys, blocks)
                hit = (words.value[word] & bit == bit).all(axis=1)
            else:
                hit = np.zeros(0, bool)
            ends = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(counts)])]
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k for k, x in zip(keys, hit, strict=True) if x], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=["at", "page_id", "url", "host", "path", "hits"])

    host, path = host_and_path(F.col("url"))
    # rows may repeat: their places tell them apart, and a task that runs again reads the same ones
    urls = pages.select(F.monotonically_increasing_id().alias("at"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = urls.select("at", "page_id", "url", host.alias("host"), path.alias("path"))
    found = urls.mapInArrow(run, "at long, page_id long, url string, host string, path string, hits array<string>")
    found = found.withColumn("key", F.explode_outer("hits")).join(
        listed.select("key", F.col("host").alias("rule_host"), "rule_verdict"), "key", "left"
    )
    order = F.struct(F.length("key").alias("n"), F.length("rule_host").alias("m"))
    best = F.max_by(F.struct("key", "rule_verdict"), F.when(F.col("rule_verdict").isNotNull(), order))
    out = found.groupBy("at", "page_id", "url", "host", "path").agg(best.alias("best"))
    return out.select("page_id", "url", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.rule_verdict", F.lit(otherwise)).alias("verdict"))
