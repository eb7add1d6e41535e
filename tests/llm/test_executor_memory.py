"""What stays with an executor: files of small rounds, and memory of Python workers between tasks."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.llm.common import checkpoint_folder, components, frugal


def test_rounds_of_components_write_few_files(spark):
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 10 <> 9")
        got = {r.node: r.component for r in components(edges).collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert all(got.get(i, i // 10 * 10) == i // 10 * 10 for i in range(500)) and len(got) >= 450
    rounds: dict[Path, int] = {}
    for p in set(folder.rglob("part-*")) - before:
        rounds[p.parent] = rounds.get(p.parent, 0) + 1
    assert len(rounds) >= 3
    assert sorted(rounds.values())[-2] <= spark.sparkContext.defaultParallelism, rounds  # all but the first


def held() -> float:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_a_worker_gives_back_what_it_no_longer_uses():
    def run(batches):
        for batch in batches:
            some = [np.ones(8000, np.uint8) for _ in range(25_000)]  # 200 MB in parts too small to be mapped alone
            kept.append([bytes(8000) for _ in range(10)])  # lies above them
            del some
            yield batch

    kept: list = []
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])
    before = held()
    assert [b.num_rows for b in frugal(run)(iter([batch]))] == [2]
    assert held() - before < 60
