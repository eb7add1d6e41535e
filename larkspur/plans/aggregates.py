"""Aggregates and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import aggregates as A
from larkspur.plans import Query, frame, sql

_NULLS = "(SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem) t"


def regressions(items: DataFrame) -> DataFrame:
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    # sums of squares in millions: their last digits depend on the order of addition
    large = ("regr_sxx", "regr_syy", "regr_sxy")
    rounded = {k: v if k == "regr_count" else F.round(v / 1e6, 1) if k in large else F.round(v, 3) for k, v in A.regression(y, x).items()}
    return items.groupBy("l_returnflag").agg(*[v.alias(k) for k, v in rounded.items()])


def correlation(items: DataFrame) -> DataFrame:
    flat = F.when(F.col("l_returnflag") == "A", F.lit(1.0)).otherwise(F.col("l_quantity"))
    return items.groupBy("l_returnflag").agg(F.round(A.corr(F.col("l_extendedprice"), flat), 6).alias("r"))


QUERIES: list[Query] = [
    sql("agg_count", "lineitem", f"SELECT l_returnflag, count(*) AS n, count(q) AS nq, count(DISTINCT l_suppkey) AS ns FROM {_NULLS} GROUP BY l_returnflag"),
    sql("agg_sum_avg", "lineitem", f"SELECT l_linestatus, round(sum(q), 2) AS s, round(avg(q), 6) AS a, CAST(sum(l_linenumber) AS BIGINT) AS i FROM {_NULLS} GROUP BY l_linestatus"),
    sql("agg_empty", "lineitem", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_shipdate) AS m FROM lineitem WHERE l_quantity < 0"),
    sql("agg_min_max", "orders", "SELECT o_orderpriority, min(o_orderdate) AS lo, max(o_orderdate) AS hi, min(o_totalprice) AS pl, max(o_orderstatus) AS sh FROM orders GROUP BY o_orderpriority"),
    sql("agg_bool", "lineitem", "SELECT l_orderkey, bool_and(l_quantity > 5) AS every_five, bool_or(l_discount = 0) AS some_free FROM lineitem GROUP BY l_orderkey"),
    sql("agg_bits", "lineitem", "SELECT l_suppkey, bit_and(l_partkey) AS a, bit_or(l_partkey) AS o, bit_xor(l_partkey) AS x FROM lineitem GROUP BY l_suppkey"),
    frame("agg_string", "nation", lambda n: n.groupBy("n_regionkey").agg(A.string_agg(F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")), ", ", [F.col("n_name")]).alias("names")),
        "SELECT n_regionkey, string_agg(CASE WHEN n_nationkey % 7 <> 0 THEN n_name END, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    frame("agg_array", "lineitem", lambda i: i.groupBy("l_orderkey").agg(F.array_join(F.transform(A.array_agg(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")), [F.col("l_linenumber")]), lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))), ",").alias("xs")),
        "SELECT l_orderkey, array_to_string(list_transform(list(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END ORDER BY l_linenumber), lambda x: coalesce(x::VARCHAR, 'NULL')), ',') AS xs FROM lineitem GROUP BY l_orderkey"),
    frame("agg_json", "nation", lambda n: n.groupBy("n_regionkey").agg(A.json_agg(F.col("n_name"), [F.col("n_name")]).alias("names")),
        "SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_name)) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey"),
    frame("agg_json_object", "nation", lambda n: n.groupBy("n_regionkey").agg(A.json_object_agg(F.col("n_name"), F.col("n_nationkey"), [F.col("n_name")]).alias("o")),
        """SELECT n_regionkey, '{ ' || string_agg('"' || n_name || '" : ' || n_nationkey, ', ' ORDER BY n_name) || ' }' AS o FROM nation GROUP BY n_regionkey"""),
    sql("agg_percentile_cont", "lineitem", "SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS p25, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS med FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY l_returnflag"),
    sql("agg_percentile_disc", "lineitem", "SELECT l_returnflag, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_extendedprice) AS p90 FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag"),
    sql("agg_mode", "part", "SELECT p_brand, mode() WITHIN GROUP (ORDER BY p_size) AS m FROM part GROUP BY p_brand",
        "SELECT p_brand, p_size AS m FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS r FROM part GROUP BY p_brand, p_size) WHERE r = 1"),
    sql("agg_variance", "lineitem", "SELECT l_linestatus, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss FROM lineitem GROUP BY l_linestatus"),
    frame("agg_corr_flat", "lineitem", correlation, """SELECT l_returnflag, CASE WHEN l_returnflag <> 'A' THEN round(corr(l_extendedprice, l_quantity), 6) END AS r FROM lineitem GROUP BY l_returnflag"""),
    sql("agg_covariance", "lineitem", "SELECT l_returnflag, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs FROM lineitem GROUP BY l_returnflag"),
    frame("agg_regression", "lineitem", regressions, "SELECT l_returnflag, " + ", ".join(f"round(regr_{k}(l_extendedprice, l_quantity), 3) AS regr_{k}" for k in ("avgx", "avgy", "slope", "intercept", "r2"))
        + ", " + ", ".join(f"round(regr_{k}(l_extendedprice, l_quantity) / 1e6, 1) AS regr_{k}" for k in ("sxx", "syy", "sxy"))
        + ", regr_count(l_extendedprice, l_quantity)::BIGINT AS regr_count FROM lineitem GROUP BY l_returnflag"),
    sql("agg_distinct", "lineitem", "SELECT l_returnflag, sum(DISTINCT l_quantity) AS s, count(DISTINCT l_linenumber) AS n, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag"),
    sql("agg_filter", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS s FROM orders GROUP BY o_orderpriority"),
    frame("agg_sum_exact", "orders", lambda o: o.groupBy("o_orderstatus").agg(A.sum_int8(F.col("o_orderkey") * 1000003).cast("string").alias("s")), "SELECT o_orderstatus, CAST(sum(o_orderkey * 1000003) AS VARCHAR) AS s FROM orders GROUP BY o_orderstatus"),
    sql("group_expression", "orders", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)"),
    sql("group_ordinal", "customer", "SELECT c_mktsegment AS seg, c_nationkey % 5 AS k, count(*) AS n FROM customer GROUP BY 1, 2"),
    sql("grouping_sets", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"),
    sql("rollup", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    sql("cube", "lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    sql("grouping_mixed", "lineitem", "SELECT l_linenumber, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_linenumber, ROLLUP (l_returnflag, l_linestatus)"),
    sql("having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) > 1000"),
    sql("window_over_group", "orders", "SELECT o_orderpriority, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM orders GROUP BY o_orderpriority"),
]
