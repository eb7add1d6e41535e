"""Window functions, sorting, limits and distinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators.ordering import asc, desc, distinct_on, page, top_with_ties
from larkspur.operators.windows import exclude, groups_frame, lag_by
from larkspur.plans import Query, frame, sql

_W = "OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)"
_ITEMS = "l_orderkey, l_linenumber"


def _excluded(what: str):
    return lambda i: exclude(i, ["l_suppkey"], [F.col("l_linenumber")], "l_quantity", what, -1, 1, "q").select(
        "l_orderkey", "l_linenumber", F.round("q_sum", 2).alias("s"), F.col("q_count").alias("n")
    )


def _exclude_sql(what: str) -> str:
    over = f"OVER (PARTITION BY l_suppkey ORDER BY l_linenumber GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE {what})"
    return f"SELECT {_ITEMS}, round(sum(l_quantity) {over}, 2) AS s, count(l_quantity) {over} AS n FROM lineitem"


QUERIES: list[Query] = [
    sql("win_row_number", "lineitem", f"SELECT {_ITEMS}, row_number() {_W} AS rn FROM lineitem"),
    sql("win_rank", "orders", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d FROM orders"),
    sql("win_percent", "nation", "SELECT n_nationkey, round(percent_rank() OVER (PARTITION BY n_regionkey ORDER BY n_name), 6) AS p, round(cume_dist() OVER (PARTITION BY n_regionkey ORDER BY n_name), 6) AS c FROM nation"),
    sql("win_ntile", "customer", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS t FROM customer"),
    sql("win_lag_lead", "lineitem", f"SELECT {_ITEMS}, lag(l_quantity) {_W} AS a, lead(l_quantity, 2) {_W} AS b, lag(l_quantity, 1, -1.0) {_W} AS c FROM lineitem"),
    frame("win_lag_row_offset", "lineitem", lambda i: lag_by(i, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_shipdate")], "l_quantity", F.col("l_linenumber") % 3, "v").select("l_orderkey", "l_linenumber", "v"),
        "SELECT l_orderkey, l_linenumber, v FROM (SELECT l_orderkey, l_linenumber, lag(l_quantity, (l_linenumber % 3)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS v FROM lineitem)"),
    sql("win_values", "lineitem", f"""SELECT {_ITEMS}, first_value(l_quantity) {_W} AS f, last_value(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(l_quantity, 2) {_W} AS n FROM lineitem"""),
    sql("win_running", "orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"),
    sql("win_peers", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS n FROM orders"),
    sql("win_rows_frame", "lineitem", f"SELECT {_ITEMS}, round(avg(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a FROM lineitem"),
    sql("win_range_frame", "part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS n FROM part"),
    sql("win_range_interval", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS n FROM orders"),
    frame("win_groups_frame", "lineitem", lambda i: groups_frame(i, ["l_suppkey"], [F.col("l_linenumber")], -1, 1, s=F.sum("l_quantity"), n=F.count("*")).select("l_orderkey", "l_linenumber", F.round("s", 2).alias("s"), "n"),
        f"SELECT {_ITEMS}, round(sum(l_quantity) OVER w, 2) AS s, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_linenumber GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
    frame("win_exclude_row", "lineitem", _excluded("row"), _exclude_sql("CURRENT ROW")),
    frame("win_exclude_group", "lineitem", _excluded("group"), _exclude_sql("GROUP")),
    frame("win_exclude_ties", "lineitem", _excluded("ties"), _exclude_sql("TIES")),
    frame("win_exclude_none", "lineitem", _excluded("no others"), _exclude_sql("NO OTHERS")),
    sql("win_named", "orders", "SELECT o_orderkey, rank() OVER w AS r, round(sum(o_totalprice) OVER w, 2) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)"),
    sql("win_filter", "orders", "SELECT o_orderkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders",
        "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders"),
    sql("win_distinct_rows", "orders", "SELECT DISTINCT o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders"),
    sql("top_k_per_group", "orders", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2"),
    frame("order_nulls", "lineitem", lambda i: page(i.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("q")), [desc("q"), asc("l_orderkey"), asc("l_linenumber")], 25),
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS q FROM lineitem ORDER BY q DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 25"),
    sql("limit_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10"),
    frame("fetch_with_ties", "part", lambda p: top_with_ties(p, "p_size", 7).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 7"),
    sql("distinct", "customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    frame("distinct_on", "orders", lambda o: distinct_on(o, ["o_custkey"], [desc("o_totalprice"), asc("o_orderkey")]).select("o_custkey", "o_orderkey"),
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
]
