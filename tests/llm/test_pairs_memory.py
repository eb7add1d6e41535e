"""Arrays of the pairs of torn shingles: blocks keep them small and add up to the same pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa

from larkspur.llm.jaccard_join import pairs_of


def test_pairs_are_filtered_in_blocks():
    rng = np.random.default_rng(4)
    rows, docs = 12_000, 6000
    token, d = np.sort(rng.integers(0, 30, rows)), rng.integers(0, docs, rows)
    n = np.where(d % 50 < 2, 100, 1000 + 300 * (d % 50))  # few pairs pass the length filter
    columns = {"token": token, "cell": np.zeros(rows, np.int32), "xs": np.ones(rows, bool), "ys": np.ones(rows, bool), "outside": np.ones(rows, bool), "d": d, "tag": d, "cd": d, "ctag": d}
    columns |= {"n": n, "pos": np.zeros(rows, np.int32), "common": n} | {f"sign{i}": np.zeros(rows, np.int64) for i in range(8)}
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
    tracemalloc.start()
    out = list(pairs_of(80, 100_000, 2_000_000)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {}
    for r in out:
        for a, b, shared in zip(*(r.column(x).to_pylist() for x in ("ad", "bd", "shared")), strict=True):
            got[a, b] = got.get((a, b), 0) + shared
    want = {}
    for t in range(30):
        own = d[token == t]
        size = n[token == t]
        for x, m in zip(own.tolist(), size.tolist(), strict=True):
            for y in own[(own > x) & (100 * np.minimum(size, m) >= 80 * np.maximum(size, m))].tolist():
                want[x, y] = want.get((x, y), 0) + 1
    assert got == want
    assert peak < 90e6, peak
