"""Steps whose cost must not grow faster than their rows, on rows that would make it."""

import random

from pyspark.sql import functions as F

from larkspur.operators import joins, windows
from larkspur.registry import QUERIES


def test_overlap_counts(spark):
    rng = random.Random(5)
    spans = lambda n: [(i, float(low), float(low + rng.randrange(-1, 25))) for i in range(n) for low in [rng.randrange(-40, 40)]]
    left, right = spans(60) + [(60, None, 5.0)], spans(90) + [(90, 1.0, None)]
    want = {}
    for i, low, high in left:
        n = sum(None not in (low, high, a, b) and low < high and a < b and low < b and a < high for _, a, b in right)
        want |= {i: n} if n else {}
    a, b = (spark.createDataFrame(x, "k long, low double, high double") for x in (left, right))
    span = (F.col("low"), F.col("high"))
    assert {r.k: r.n for r in joins.overlap_counts(a, b, span, span, 7).collect()} == want


def test_join_overlap_makes_no_pairs_of_rows(spark, tmp_path, monkeypatch):
    made = []
    whole = joins.overlap_join
    monkeypatch.setattr(joins, "overlap_join", lambda *a: made.append(whole(*a)) or made[-1])
    spark.range(2000).selectExpr("id % 1000 AS o_orderkey", "4e5 AS o_totalprice", "TIMESTAMP'1996-05-04' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "45.0D AS l_quantity", "date_add(DATE'1996-05-01', int(id % 3)) AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = QUERIES["join_overlap"](spark, str(tmp_path)).collect()
    assert sorted(r.o_orderkey for r in rows) == list(range(1000)) and {r.n for r in rows} == {4000}
    assert [x.count() for x in made] == [2]


def test_exclude_by_brute_force_with_bounded_tasks(spark, monkeypatch):
    """Null keys, orders and values, one large group of peers, frames of all kinds; tasks follow the rows."""
    monkeypatch.setattr(windows, "PER_TASK", 20)
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = [(i, pick("a", None), pick(1, 2, 3, 5, None), pick(0.5, 2.0, 1e17, -1e17, None)) for i in range(150)] + [(150 + i, "b", 7, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, p string, o int, v double")
    for what, low, high in [("row", None, 0), ("row", -1, None), ("ties", -2, 1), ("group", -1, None), ("no others", 0, 1), ("row", 1, 2), ("group", 0, 0)]:
        out = windows.exclude(df, ["p"], [F.col("o").asc_nulls_last()], "v", what, low, high, "q")
        assert out.columns == [*df.columns, "q_sum", "q_count", "q_avg", "q_min", "q_max"]
        got = {r.id: r for r in out.collect()}
        assert len(got) == len(rows)
        for i, p, o, _ in rows:
            peers = sorted({x[2] for x in rows if x[1] == p}, key=lambda k: (k is None, k or 0))
            at = {k: n for n, k in enumerate(peers)}
            kept = []
            for j, p2, o2, v2 in rows:
                d = at[o2] - at[o] if p2 == p else None
                if d is None or v2 is None or (low is not None and d < low) or (high is not None and d > high):
                    continue
                if d or what == "no others" or (what == "row" and j != i) or (what == "ties" and j == i):
                    kept.append(v2)
            r = got[i]
            assert (r.q_count, r.q_min, r.q_max) == (len(kept), min(kept, default=None), max(kept, default=None))
            assert r.q_sum is None if not kept else abs(r.q_sum - sum(kept)) <= 1e-12 * sum(map(abs, kept)), (what, low, high, i)
    plan = windows.exclude(df, ["p"], [F.col("o")], "v", "row", -1, 1)._jdf.queryExecution().toString()
    assert "RepartitionByExpression [p" in plan and ", 11" in plan  # 210 rows, 20 a task
