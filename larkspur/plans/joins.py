"""Joins, subqueries and common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.joins import greater_than_all, less_than_any, overlap_counts
from larkspur.operators.recursion import recursive_union
from larkspur.plans import Query, frame, sql


def overlapping_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Line items whose three days after shipping overlap one of the priciest orders' ten days."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("double")
    dear = orders.where("o_totalprice > 350000").select("o_orderkey", day("o_orderdate").alias("a"))
    ship = items.where("l_quantity >= 45").select("l_orderkey", "l_linenumber", day("l_shipdate").alias("b"))
    dear = dear.groupBy("o_orderkey", "a").agg(F.count("*").alias("m"))
    out = overlap_counts(dear, ship, (F.col("a"), F.col("a") + 10), (F.col("b"), F.col("b") + 3), 10)
    return out.groupBy("o_orderkey").agg(F.sum(F.col("m") * F.col("n")).alias("n"))


def reach(nation: DataFrame) -> DataFrame:
    """Nations reached from nation 0 along ``k -> (2 k + 1) mod 25`` and ``k -> (k + 7) mod 25``."""
    edges = nation.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("b")).union(
        nation.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 7) % 25).alias("b"))
    )
    seed = nation.where("n_nationkey = 0").select(F.col("n_nationkey").alias("k"))
    return recursive_union(seed, lambda rows: rows.join(edges, F.col("k") == F.col("a")).select(F.col("b").alias("k")))


QUERIES: list[Query] = [
    sql("join_inner", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000"),
    sql("join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    sql("join_comma", "region nation", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey"),
    sql("join_left", "customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000"),
    sql("join_right", "orders customer", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'"),
    sql("join_full", "customer supplier", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3"),
    sql("join_using", "lineitem", """SELECT k, a.n AS n1, b.n AS n2 FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey) a
        FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity < 5 GROUP BY l_orderkey) b USING (k)"""),
    sql("join_natural", "nation region", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region) b"),
    sql("join_theta", "supplier nation", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 100"),
    sql("join_self", "nation", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    sql("join_multi", "lineitem orders customer nation region", """SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""),
    sql("join_semi", "orders lineitem", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)"),
    sql("join_anti", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    sql("not_in_null_aware", "customer orders", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"""),
    sql("not_in_with_null", "customer orders", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END FROM orders)"""),
    sql("join_lateral", "customer orders", """SELECT c_custkey, o.n AS n, o.top AS top FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey) o"""),
    sql("join_lateral_left", "nation supplier", """SELECT n_name, s.best AS best FROM nation LEFT JOIN LATERAL (SELECT max(s_acctbal) AS best FROM supplier WHERE s_nationkey = n_nationkey) s ON true"""),
    frame("join_overlap", "orders lineitem", overlapping_orders, """SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_shipdate::DATE < o_orderdate::DATE + 10 AND o_orderdate::DATE < l_shipdate::DATE + 3
        WHERE o_totalprice > 350000 AND l_quantity >= 45 GROUP BY o_orderkey"""),
    sql("scalar_subquery", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)"),
    sql("correlated_scalar", "lineitem", """SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)"""),
    sql("correlated_in_select", "nation supplier", "SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation"),
    sql("in_subquery", "orders customer", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    sql("row_in_subquery", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_quantity) IN (SELECT l_orderkey, max(l_quantity) FROM lineitem GROUP BY l_orderkey)"),
    sql("exists_in_or", "orders lineitem", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09)"),
    frame("quantified_all", "orders", lambda o: greater_than_all(o, "o_totalprice", o.where("o_orderstatus = 'P'"), "o_totalprice").select("o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')"),
    frame("quantified_any", "orders", lambda o: less_than_any(o, "o_totalprice", o.where("o_orderpriority = '1-URGENT'"), "o_totalprice").select("o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE o_totalprice < ANY (SELECT o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT')"),
    sql("array_subquery", "nation region", "SELECT r_name, (SELECT array_join(array_sort(collect_list(n_name)), ',') FROM nation WHERE n_regionkey = r_regionkey) AS names FROM region",
        "SELECT r_name, array_to_string(list_sort(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey)), ',') AS names FROM region"),
    sql("cte", "orders", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT o_custkey, round(total, 2) AS total FROM top"),
    sql("cte_twice", "orders", "WITH d AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus) SELECT a.s AS a, b.s AS b FROM d a JOIN d b ON a.n < b.n"),
    sql("recursive_union_all", "nation", "WITH RECURSIVE c(k, depth) AS (SELECT n_nationkey, 0 FROM nation UNION ALL SELECT k, depth + 1 FROM c WHERE depth < k % 5) SELECT k, max(depth) AS depth FROM c GROUP BY k"),
    frame("recursive_union", "nation", reach, """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation),
        r(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 0 UNION SELECT b FROM r JOIN e ON k = a) SELECT k FROM r"""),
]
