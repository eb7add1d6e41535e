"""Scans, projections, filters and predicates (and the flagship pricing summary)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import strings
from larkspur.functions.dates import overlaps
from larkspur.operators.joins import row_less
from larkspur.plans import Query, frame, sql


def pricing_summary(items: DataFrame) -> DataFrame:
    items = items.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(price), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


def overlaps_periods(orders: DataFrame) -> DataFrame:
    a = F.col("o_orderdate")
    b = F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 40 as int))")
    hit = overlaps(a, b, F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-02-01").cast("timestamp_ntz"))
    return orders.where(hit).select("o_orderkey")


QUERIES: list[Query] = [
    frame("pricing_summary", "lineitem", pricing_summary, """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""),
    sql("scan_base", "nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    sql("scan_pruned", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49"),
    sql("scan_range_pushdown", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200"),
    sql("values_join", "nation", "SELECT v.k AS k, v.label AS label, n_name FROM (VALUES (0, 'a'), (1, 'b'), (2, NULL)) AS v(k, label) JOIN nation ON n_nationkey = v.k"),
    sql("derived_table", "customer", "SELECT d.seg AS seg, d.n AS n FROM (SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment) AS d(seg, n)"),
    sql("select_expressions", "part", "SELECT p_partkey, upper(p_brand) AS brand, p_size * 2 + 1 AS twice, p_retailprice / 2 AS half, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class FROM part"),
    sql("where_three_valued", "lineitem", """SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem) t
        WHERE NOT (q > 10 AND l_discount > 0.05) OR q IS NULL"""),
    sql("is_distinct_from", "lineitem", """SELECT l_orderkey, l_linenumber, q IS DISTINCT FROM 5.0 AS d, q IS NOT DISTINCT FROM NULL AS n, (q > 10) IS TRUE AS t, (q > 10) IS NOT FALSE AS f, (q > 10) IS UNKNOWN AS u
        FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem) t""",
        """SELECT l_orderkey, l_linenumber, q IS DISTINCT FROM 5.0 AS d, q IS NOT DISTINCT FROM NULL AS n, coalesce(q > 10, false) AS t, coalesce(q > 10, true) AS f, (q > 10) IS NULL AS u
        FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem) t"""),
    sql("in_list", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')"),
    sql("in_list_with_null", "lineitem", """SELECT l_orderkey, l_linenumber, q IN (1.0, 2.0, NULL) AS hit, q NOT IN (1.0, 2.0) AS miss
        FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem) t"""),
    sql("between", "part", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1100"),
    sql("between_symmetric", "part", "SELECT p_partkey FROM part WHERE p_size BETWEEN least(20, p_partkey % 50) AND greatest(20, p_partkey % 50)",
        "SELECT p_partkey FROM part WHERE (p_size BETWEEN 20 AND p_partkey % 50) OR (p_size BETWEEN p_partkey % 50 AND 20)"),
    sql("like_ilike", "part", "SELECT p_partkey, p_name LIKE '%a_' AS l, p_name ILIKE 'P%' AS i, p_type NOT LIKE '%STEEL' AS n FROM part"),
    frame("like_any_all", "part", lambda p: p.select("p_partkey", strings.like_any(F.col("p_type"), F.array(F.lit("%STEEL"), F.lit("SMALL%"))).alias("any_hit"), strings.like_all(F.col("p_type"), F.array(F.lit("%E%"), F.lit("%L%"))).alias("all_hit")),
        "SELECT p_partkey, p_type LIKE '%STEEL' OR p_type LIKE 'SMALL%' AS any_hit, p_type LIKE '%E%' AND p_type LIKE '%L%' AS all_hit FROM part"),
    frame("similar_to", "orders", lambda o: o.select("o_orderkey", strings.similar_to(F.col("o_orderpriority"), "[1-3]-(URGENT|HIGH|M%)").alias("hit")),
        "SELECT o_orderkey, regexp_full_match(o_orderpriority, '[1-3]-(URGENT|HIGH|M.*)') AS hit FROM orders"),
    sql("case_forms", "orders", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS simple_case,
        CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'low' END AS searched FROM orders"""),
    sql("casts", "lineitem", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_orderkey AS STRING) AS s,
        CAST(l_shipdate AS DATE) AS day FROM lineitem""", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_orderkey AS VARCHAR) AS s,
        CAST(l_shipdate AS DATE) AS day FROM lineitem"""),
    frame("row_comparison", "lineitem", lambda i: i.where(row_less([F.col("l_linenumber"), F.col("l_quantity")], [F.lit(3), F.lit(20.0)])).select("l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber, l_quantity) < (3, 20.0)"),
    frame("overlaps", "orders", overlaps_periods, """SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-02-01' AND
        (o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) > TIMESTAMP '1996-01-01' OR o_orderdate = TIMESTAMP '1996-01-01')"""),
    frame("array_quantifiers", "lineitem", lambda i: i.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("qs")).select(
        "l_orderkey", F.exists("qs", lambda q: q == 10.0).alias("any_ten"), F.forall("qs", lambda q: q > 5).alias("all_five")),
        "SELECT l_orderkey, bool_or(l_quantity = 10.0) AS any_ten, bool_and(l_quantity > 5) AS all_five FROM lineitem GROUP BY l_orderkey"),
    sql("composite_fields", "customer", "SELECT c_custkey, r.a AS a, r.b AS b FROM (SELECT c_custkey, named_struct('a', c_name, 'b', c_acctbal) AS r FROM customer) t",
        "SELECT c_custkey, r.a AS a, r.b AS b FROM (SELECT c_custkey, {'a': c_name, 'b': c_acctbal} AS r FROM customer) t"),
    sql("whole_row_null", "customer orders", "SELECT c_custkey, count(struct(o_orderkey, o_custkey).o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
        "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    frame("enum_order", "orders", lambda o: o.withColumn("rank", F.element_at(F.create_map(F.lit("F"), F.lit(1), F.lit("P"), F.lit(2), F.lit("O"), F.lit(3)), F.col("o_orderstatus"))).where("rank >= 2").select("o_orderkey", "rank"),
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 WHEN 'O' THEN 3 END AS rank FROM orders WHERE o_orderstatus IN ('P', 'O')"),
    frame("domain_check", "part", lambda p: p.select("p_partkey", F.when(F.col("p_size") > 0, F.col("p_size")).otherwise(F.raise_error(F.lit("value for domain positive violates check constraint")).cast("int")).alias("size")),
        "SELECT p_partkey, p_size AS size FROM part"),
    frame("padded_char", "part", lambda p: p.where(F.rtrim(F.rpad("p_brand", 20, " ")) == F.rtrim(F.lit("Brand#11   "))).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11'"),
    sql("collate_binary", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE UTF8_BINARY < 'C'", "SELECT c_custkey FROM customer WHERE c_mktsegment < 'C'"),
    Query("parameters", lambda s, d: s.sql("SELECT o_orderkey FROM {t} WHERE o_totalprice > :low AND o_orderstatus = :st", args={"low": 150000.0, "st": "O"}, t=s.read.parquet(f"{d}/orders.parquet")),
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000.0 AND o_orderstatus = 'O'"),
]
