"""Set operations."""

from __future__ import annotations

from larkspur.plans import Query, sql

_A = "SELECT l_partkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity > 30"
_B = "SELECT l_partkey AS k, l_linenumber AS n FROM lineitem WHERE l_discount > 0.03"

QUERIES: list[Query] = [
    sql("union_all", "lineitem", f"{_A} UNION ALL {_B}"),
    sql("union", "lineitem", f"{_A} UNION {_B}"),
    sql("intersect", "lineitem", f"{_A} INTERSECT {_B}"),
    sql("intersect_all", "lineitem", f"{_A} INTERSECT ALL {_B}"),
    sql("except", "lineitem", f"{_A} EXCEPT {_B}"),
    sql("except_all", "lineitem", f"{_A} EXCEPT ALL {_B}"),
    sql("set_precedence", "nation supplier customer", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer"),
    sql("set_types", "nation part", "SELECT n_nationkey AS x, n_name AS y FROM nation UNION SELECT p_retailprice, p_brand FROM part"),
    sql("set_order_limit", "customer supplier", "SELECT c_acctbal AS b, c_name AS n FROM customer UNION ALL SELECT s_acctbal, s_name FROM supplier ORDER BY b DESC, n LIMIT 15"),
]
