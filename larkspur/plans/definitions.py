"""Tables from queries, views, functions, partitions, cursors; types, times of day, intervals, arrays and JSON by parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import dates, jsons, numbers, regex, values
from larkspur.operators import definitions as D
from larkspur.operators import writes as W
from larkspur.operators.checkpoints import scratch
from larkspur.operators.ordering import top_with_ties
from larkspur.operators.windows import exclude
from larkspur.plans import Query, frame, sql
from larkspur.session import table, views
from larkspur.sources import catalog

_FAR = "OVER (PARTITION BY l_suppkey ORDER BY l_linenumber GROUPS BETWEEN {} AND {} EXCLUDE {})"


def _excluded(what: str, low: int | None, high: int | None):
    return lambda i: exclude(i, ["l_suppkey"], [F.col("l_linenumber")], "l_quantity", what, low, high, "q").select(
        "l_orderkey", "l_linenumber", F.round("q_sum", 2).alias("s"), F.col("q_count").alias("n"), F.col("q_min").alias("lo"), F.col("q_max").alias("hi"), F.round("q_avg", 6).alias("a")
    )


def _exclude_sql(what: str, low: str, high: str) -> str:
    over = _FAR.format(low, high, what)
    return f"SELECT l_orderkey, l_linenumber, round(sum(l_quantity) {over}, 2) AS s, count(l_quantity) {over} AS n, min(l_quantity) {over} AS lo, max(l_quantity) {over} AS hi, round(avg(l_quantity) {over}, 6) AS a FROM lineitem"


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders", "customer")
    D.create_view(spark, "open_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
    D.create_view(spark, "open_totals", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM open_orders GROUP BY o_custkey")
    return spark.sql("SELECT c_custkey, n, total FROM customer JOIN open_totals ON c_custkey = o_custkey")


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders", "customer")
    D.define(spark, "net_of(price DOUBLE, rate DOUBLE DEFAULT 0.1) RETURNS DOUBLE", "price * (1 - rate)")
    D.define(spark, "orders_of(c BIGINT) RETURNS TABLE (k BIGINT, p DOUBLE)", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c")
    return spark.sql("SELECT c_custkey, k, net_of(p) AS net, net_of(p, 0.5) AS half FROM customer, LATERAL orders_of(c_custkey)")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement with parameters, run for two sets of them."""
    views(spark, sf_dir, "orders")
    text = "SELECT o_orderkey, :label AS label FROM orders WHERE o_totalprice > :least AND o_orderpriority = :priority"
    runs = ({"label": "a", "least": 200000.0, "priority": "1-URGENT"}, {"label": "b", "least": 300000.0, "priority": "5-LOW"})
    one, two = (spark.sql(text, args=args) for args in runs)
    return one.unionAll(two)


def _partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid out by price range, with one partition read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    part = D.by_range(F.col("o_totalprice"), {"low": (None, 100000.0), "middle": (100000.0, 300000.0)}, "rest")
    laid = D.write_partitions(o, part, f"{scratch(spark)}/orders")
    return laid.where("__partition = 'middle'").select("o_orderkey", "o_totalprice")


def _moved(c: DataFrame) -> DataFrame:
    """A WITH clause that deletes, and an INSERT of the rows it returns elsewhere."""
    left, gone = W.delete_using(c, c.where("c_acctbal < 0").select("c_custkey"), ["c_custkey"])
    archive = D.add_column(gone, "reason", "string", F.lit("debt"))
    return archive.select("c_custkey", "reason").unionByName(left.select("c_custkey", F.lit("kept").alias("reason")))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the catalog with how many values each holds and how many are distinct, one pass a table."""
    frames = {t: table(spark, sf_dir, t) for t in ("region", "nation", "supplier")}
    known = catalog.columns(spark, frames)
    stats = None
    for t, df in frames.items():
        counts = df.agg(*[F.struct(F.count(c).alias("n"), F.countDistinct(c).alias("k")).alias(c) for c in df.columns])
        rows = counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(c)["n"].alias("n_values"), F.col(c)["k"].alias("n_distinct")) for c in df.columns])).alias("r")).select("r.*")
        stats = rows if stats is None else stats.unionByName(rows)
    return known.join(stats, ["table_name", "column_name"]).select("table_name", "column_name", "ordinal_position", "data_type", "n_values", "n_distinct")


def _catalog_sql() -> str:
    named = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")}
    stats = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct FROM {t}" for t, cs in named.items() for c in cs)
    return f"""SELECT table_name, column_name, i.ordinal_position::INTEGER AS ordinal_position,
        CASE i.data_type WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'double precision' ELSE lower(i.data_type) END AS data_type, n_values, n_distinct
        FROM ({stats}) s JOIN information_schema.columns i USING (table_name, column_name)"""


def _interval(n: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    a, b = dates.interval(k * 5, k - 7, (k - 12).cast("long") * 3_723_000_000), dates.interval(3, k * 4, 60_000_000)
    return n.select("n_nationkey", dates.interval_text(dates.interval_plus(a, b)).alias("plus"), dates.interval_minus(a, b)["days"].alias("minus_days"), dates.interval_times(b, k)["months"].alias("times_months"), dates.interval_text(dates.justify_interval(dates.interval(0, k * 10, 0))).alias("justified"))


_CLOCK = "(n_nationkey - 12) * 3723 + 60"
_INTERVAL_SQL = f"""WITH x AS (SELECT n_nationkey, n_nationkey * 5 + 3 AS m, n_nationkey * 5 - 7 AS d, {_CLOCK} AS s FROM nation)
SELECT n_nationkey, concat_ws(' ', CASE WHEN m // 12 <> 0 THEN (m // 12) || CASE WHEN m // 12 = 1 THEN ' year' ELSE ' years' END END,
  CASE WHEN m % 12 <> 0 THEN (m % 12) || CASE WHEN m % 12 = 1 THEN ' mon' ELSE ' mons' END END, CASE WHEN d <> 0 THEN d || CASE WHEN d = 1 THEN ' day' ELSE ' days' END END,
  CASE WHEN s <> 0 THEN CASE WHEN s < 0 THEN '-' ELSE '' END || lpad((abs(s) // 3600)::VARCHAR, 2, '0') || ':' || lpad((abs(s) // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((abs(s) % 60)::VARCHAR, 2, '0') END) AS plus,
  (n_nationkey - 7 - n_nationkey * 4)::INTEGER AS minus_days, (3 * n_nationkey)::INTEGER AS times_months,
  CASE WHEN n_nationkey = 0 THEN '00:00:00' ELSE concat_ws(' ', CASE WHEN n_nationkey // 3 > 0 THEN (n_nationkey // 3) || CASE WHEN n_nationkey // 3 = 1 THEN ' mon' ELSE ' mons' END END,
    CASE WHEN n_nationkey % 3 > 0 THEN (n_nationkey % 3 * 10) || ' days' END) END AS justified FROM x"""

_NULL_SIZE = "CASE WHEN p_size % 7 <> 0 THEN p_size END"

QUERIES: list[Query] = [
    frame("win_exclude_ahead", "lineitem", _excluded("row", 1, 2), _exclude_sql("CURRENT ROW", "1 FOLLOWING", "2 FOLLOWING")),
    frame("win_exclude_row_any", "lineitem", _excluded("row", None, 0), _exclude_sql("CURRENT ROW", "UNBOUNDED PRECEDING", "CURRENT ROW")),
    frame("win_exclude_ties_any", "lineitem", _excluded("ties", -2, 1), _exclude_sql("TIES", "2 PRECEDING", "1 FOLLOWING")),
    frame("win_exclude_group_any", "lineitem", _excluded("group", -1, None), _exclude_sql("GROUP", "1 PRECEDING", "UNBOUNDED FOLLOWING")),
    frame("fetch_with_ties_nulls", "part", lambda p: top_with_ties(p.select("p_partkey", F.expr(_NULL_SIZE).alias("k")), "k", 5).select("p_partkey", "k"),
        f"SELECT p_partkey, k FROM (SELECT p_partkey, {_NULL_SIZE} AS k, rank() OVER (ORDER BY {_NULL_SIZE} DESC NULLS FIRST) AS r FROM part) WHERE r <= 5"),
    frame("fetch_with_ties_offset", "part", lambda p: top_with_ties(p.select("p_partkey", F.expr(_NULL_SIZE).alias("k")), "k", 5, False, 60).groupBy("k").agg(F.count("*").alias("n")),
        f"""SELECT k, count(*) AS n FROM (SELECT {_NULL_SIZE} AS k, row_number() OVER (ORDER BY {_NULL_SIZE} NULLS LAST) AS rn, rank() OVER (ORDER BY {_NULL_SIZE} NULLS LAST) AS r FROM part)
        WHERE rn > 60 AND r <= 65 GROUP BY k"""),
    frame("set_with_ties", "customer supplier", lambda c, s: top_with_ties(c.select(F.col("c_nationkey").alias("k")).unionAll(s.select("s_nationkey")), "k", 9, False).groupBy("k").agg(F.count("*").alias("n")),
        "SELECT k, count(*) AS n FROM (SELECT k, rank() OVER (ORDER BY k) AS r FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)) WHERE r <= 9 GROUP BY k"),
    frame("re_replace_alternation", "part", lambda p: p.select("p_partkey", regex.replace(F.col("p_type"), "E|A|(N)N", "<\\1\\&>").alias("a"), regex.replace(F.concat("p_type", F.lit("\n"), "p_brand"), "[a-z]*.B", "-").alias("b")),
        r"SELECT p_partkey, regexp_replace(p_type, 'E|A|(N)N', '<\1\0>') AS a, regexp_replace(p_type || chr(10) || p_brand, '[a-z]*.B', '-') AS b FROM part"),
    frame("dml_insert_null_keys", "customer", lambda c: W.insert_do_nothing(c.select("c_custkey", "c_nationkey"), c.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 2).alias("c_custkey"), "c_nationkey"), ["c_custkey"])[1].select("c_custkey"),
        "SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2 END AS c_custkey FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)"),
    frame("json_numbers", "orders", lambda o: o.select("o_orderkey", jsons.canonical(F.concat(F.lit('{"b": '), (F.col("o_orderkey") + 1).cast("string"), F.lit('12345678901234567.890, "a":1e3}'))).alias("j")),
        """SELECT o_orderkey, '{"a": 1000, "b": ' || (o_orderkey + 1) || '12345678901234567.890}' AS j FROM orders"""),
    frame("json_element", "events", lambda e: e.select("event_id", jsons.element(F.concat(F.lit('{"x": [1, '), "props", F.lit("]}")), "x").alias("whole"), jsons.element(jsons.element(F.concat(F.lit('{"x": [1, '), "props", F.lit("]}")), "x"), -1).alias("last")),
        """SELECT event_id, '[1, {"k": ' || (props->>'k') || '}]' AS whole, '{"k": ' || (props->>'k') || '}' AS last FROM events"""),
    frame("json_insert", "events", lambda e: e.select("event_id", jsons.insert_path(F.concat(F.lit('{"x":[1,2]}')), ["x", 1], F.get_json_object("props", "$.k")).alias("before"), jsons.insert_path(F.lit('{"x":[1,2]}'), ["x", -1], F.get_json_object("props", "$.k"), True).alias("after")),
        """SELECT event_id, '{"x": [1, ' || (props->>'k') || ', 2]}' AS before, '{"x": [1, 2, ' || (props->>'k') || ']}' AS after FROM events"""),
    frame("json_set_lax", "events", lambda e: e.select("event_id", jsons.set_lax(F.col("props"), ["k"], F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")), True, "delete_key").alias("d"), jsons.set_lax(F.col("props"), ["k"], F.when(F.col("event_id") % 2 == 0, F.lit("7"))).alias("n")),
        """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k": ' || event_id || '}' ELSE '{}' END AS d, CASE WHEN event_id % 2 = 0 THEN '{"k": 7}' ELSE '{"k": null}' END AS n FROM events"""),
    frame("json_delete_path", "events", lambda e: e.select("event_id", jsons.delete_path(F.concat(F.lit('{"a": '), "props", F.lit(', "b": 1}')), ["a", "k"]).alias("j")), """SELECT event_id, CASE WHEN json_exists(props, '$.k') THEN '{"a": {}, "b": 1}' END AS j FROM events"""),
    frame("json_build_array", "nation", lambda n: n.select("n_nationkey", jsons.build_array(F.col("n_nationkey"), F.col("n_name"), F.lit(None).cast("string"), F.col("n_regionkey") > 1).alias("j")),
        """SELECT n_nationkey, '[' || n_nationkey || ', "' || n_name || '", null, ' || (n_regionkey > 1) || ']' AS j FROM nation"""),
    frame("json_row", "nation", lambda n: n.select("n_nationkey", jsons.row_to_json("n_nationkey", "n_name", "n_regionkey").alias("j")), "SELECT n_nationkey, to_json(nation)::VARCHAR AS j FROM nation"),
    frame("json_pretty", "nation", lambda n: n.select("n_nationkey", jsons.pretty(jsons.row_to_json("n_name", "n_regionkey")).alias("j")),
        """SELECT n_nationkey, '{' || chr(10) || '    "n_name": "' || n_name || '",' || chr(10) || '    "n_regionkey": ' || n_regionkey || chr(10) || '}' AS j FROM nation"""),
    frame("time_to_char_padded", "orders", lambda o: o.select("o_orderkey", dates.to_char(F.col("o_orderdate"), "Month|Day|FMMonth FMDDth|IYYY-IW|DDD|MON").alias("t")),
        """SELECT o_orderkey, rpad(strftime(o_orderdate, '%B'), 9, ' ') || '|' || rpad(strftime(o_orderdate, '%A'), 9, ' ') || '|' || strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) ||
        CASE WHEN day(o_orderdate) BETWEEN 11 AND 13 THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END ||
        '|' || isoyear(o_orderdate) || '-' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') || '|' || strftime(o_orderdate, '%j') || '|' || upper(strftime(o_orderdate, '%b')) AS t FROM orders"""),
    frame("interval_arithmetic", "nation", _interval, _INTERVAL_SQL),
    sql("time_current", "nation", "SELECT n_nationkey, current_date() = CAST(now() AS DATE) AS today, current_timestamp() = now() AS same, now() > make_timestamp(2000, 1, n_nationkey + 1, 0, 0, 0) AS later FROM nation",
        "SELECT n_nationkey, current_date = CAST(now() AS DATE) AS today, now() = transaction_timestamp() AS same, now() > make_timestamp(2000, 1, n_nationkey + 1, 0, 0, 0) AS later FROM nation"),
    frame("date_isfinite", "orders", lambda o: o.select("o_orderkey", dates.isfinite(F.col("o_orderdate")).alias("f")), "SELECT o_orderkey, isfinite(o_orderdate) AS f FROM orders"),
    sql("date_make_interval", "nation", "SELECT n_nationkey, CAST(DATE'2024-01-31' + make_interval(0, n_nationkey, 0, n_nationkey) AS DATE) AS d FROM nation", "SELECT n_nationkey, (DATE '2024-01-31' + to_months(n_nationkey) + to_days(n_nationkey))::DATE AS d FROM nation"),
    frame("num_scales", "lineitem", lambda i: i.select("l_orderkey", "l_linenumber", numbers.min_scale(F.col("l_extendedprice").cast("decimal(14,4)")).alias("m"), numbers.trim_scale(F.col("l_extendedprice").cast("decimal(14,4)")).alias("t")),
        r"SELECT l_orderkey, l_linenumber, length(rtrim(split_part(x, '.', 2), '0'))::INTEGER AS m, rtrim(rtrim(x, '0'), '.') AS t FROM (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(14,4)::VARCHAR AS x FROM lineitem)"),
    frame("type_names", "lineitem", lambda i: i.groupBy(values.typeof(i, "l_orderkey").alias("a"), values.typeof(i, "l_shipdate").alias("b"), values.typeof(i, "l_quantity").alias("c")).agg(F.count("*").alias("n")),
        "SELECT lower(typeof(l_orderkey)) AS a, CASE typeof(l_shipdate) WHEN 'TIMESTAMP' THEN 'timestamp without time zone' END AS b, CASE typeof(l_quantity) WHEN 'DOUBLE' THEN 'double precision' END AS c, count(*) AS n FROM lineitem GROUP BY ALL"),
    frame("uuid_text", "customer", lambda c: c.select("c_custkey", values.uuid(F.concat(F.lit("{"), F.upper(F.md5("c_name")), F.lit("}"))).alias("u")), "SELECT c_custkey, ('{' || upper(md5(c_name)) || '}')::UUID::VARCHAR AS u FROM customer"),
    frame("bytes_convert", "nation", lambda n: n.select("n_nationkey", values.convert_from(values.bytea(F.concat(F.lit("\\x"), F.hex(values.convert_to(F.col("n_name"), "UTF-8")))), "UTF-8").alias("t"), values.get_bit(F.encode("n_name", "UTF-8"), 9).alias("b"),
            values.convert_from(values.set_byte(F.encode("n_name", "UTF-8"), 1, F.lit(33)), "UTF-8").alias("s"), values.convert_from(values.decode(F.base64(F.encode("n_name", "UTF-8")), "base64"), "UTF-8").alias("d")),
        "SELECT n_nationkey, decode(encode(n_name)) AS t, ((ascii(n_name[2]) >> 1) & 1)::INTEGER AS b, n_name[1] || '!' || substr(n_name, 3) AS s, decode(from_base64(to_base64(encode(n_name)))) AS d FROM nation"),
    frame("net_mac", "customer", lambda c: c.select("c_custkey", values.mac_trunc(F.concat_ws(":", *[F.substring(F.md5("c_name"), i, 2) for i in range(1, 12, 2)])).alias("t"), values.mac8_set7bit(F.concat_ws(":", *[F.substring(F.md5("c_name"), i, 2) for i in range(1, 16, 2)])).alias("s")),
        """SELECT c_custkey, concat_ws(':', m[1:2], m[3:4], m[5:6]) || ':00:00:00' AS t, concat_ws(':', lower(printf('%02x', ('0x' || m[1:2])::INTEGER | 2)), m[3:4], m[5:6], m[7:8], m[9:10], m[11:12], m[13:14], m[15:16]) AS s FROM (SELECT c_custkey, md5(c_name) AS m FROM customer)"""),
    frame("arr_dims", "nation", lambda n: n.select("n_nationkey", values.array_dims(F.array(F.sequence(F.lit(1), F.col("n_regionkey") + 1), F.sequence(F.lit(1), F.col("n_regionkey") + 1)), 2).alias("d"), values.array_upper(F.array(F.sequence(F.lit(1), F.col("n_regionkey") + 1)), 2).alias("u"),
            values.subscript(values.rectangular(F.array(F.array("n_nationkey", "n_regionkey"), F.array("n_regionkey", "n_nationkey"))), 2, 1).alias("x"), values.subscript(F.array(F.array("n_nationkey")), 1, 3).alias("y")),
        "SELECT n_nationkey, '[1:2][1:' || (n_regionkey + 1) || ']' AS d, n_regionkey + 1 AS u, [[n_nationkey, n_regionkey], [n_regionkey, n_nationkey]][2][1] AS x, [[n_nationkey]][1][3] AS y FROM nation"),
    frame("arr_compare", "nation", lambda n: n.select("n_nationkey", values.compare(F.array(F.col("n_nationkey") % 3, F.col("n_regionkey")), F.array(F.col("n_regionkey") % 3, F.col("n_nationkey") % 5)).alias("c")),
        "SELECT n_nationkey, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS c FROM (SELECT n_nationkey, [n_nationkey % 3, n_regionkey] AS a, [n_regionkey % 3, n_nationkey % 5] AS b FROM nation)"),
    frame("srf_expandarray", "part", lambda p: p.select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("i", "x")).select("p_partkey", "x", (F.col("i") + 1).alias("n")), "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS x, unnest(range(1, len(string_split(p_type, ' ')) + 1))::INTEGER AS n FROM part"),
    frame("srf_options", "part", lambda p: p.select("p_partkey", F.inline(values.options(F.array(F.concat(F.lit("brand="), "p_brand"), F.lit("plain"))))), "SELECT p_partkey, unnest(['brand', 'plain']) AS option_name, unnest([p_brand, NULL]) AS option_value FROM part"),
    Query("view_expansion", _views, "SELECT c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY c_custkey"),
    Query("sql_functions", _functions, "SELECT c_custkey, o_orderkey AS k, o_totalprice * (1 - 0.1::DOUBLE) AS net, o_totalprice * (1 - 0.5::DOUBLE) AS half FROM customer JOIN orders ON c_custkey = o_custkey"),
    Query("prepared_statement", _prepared, "SELECT o_orderkey, 'a' AS label FROM orders WHERE o_totalprice > 200000 AND o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'b' FROM orders WHERE o_totalprice > 300000 AND o_orderpriority = '5-LOW'"),
    Query("table_partitions", _partitioned, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 300000"),
    frame("partition_lists", "customer", lambda c: c.groupBy(D.by_list(F.when(F.col("c_nationkey") > 2, F.col("c_mktsegment")), {"machines": ["MACHINERY", "AUTOMOBILE"], "none": [None]}, "others").alias("p")).agg(F.count("*").alias("n")),
        "SELECT CASE WHEN c_nationkey <= 2 THEN 'none' WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'machines' ELSE 'others' END AS p, count(*) AS n FROM customer GROUP BY 1"),
    frame("create_table_as", "orders", lambda o: D.create_table_as(o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"),
    frame("truncate_insert", "orders", lambda o: D.truncated(o).unionByName(o.where("o_orderpriority = '2-HIGH'")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'"),
    frame("alter_table", "nation", lambda n: D.rename_column(D.drop_column(D.add_column(n, "code", "string", F.substring("n_name", 1, 2)), "n_regionkey"), "n_name", "label"), "SELECT n_nationkey, n_name AS label, substr(n_name, 1, 2) AS code FROM nation"),
    frame("cte_delete_returning", "customer", _moved, "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'kept' END AS reason FROM customer"),
    frame("cursor_fetch", "lineitem", lambda i: D.fetch(i.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"], 50, (5, 2)), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) > (5, 2) ORDER BY l_orderkey, l_linenumber LIMIT 50"),
    sql("select_no_from", "orders nation", "SELECT (SELECT count(*) FROM orders) AS n, (SELECT max(n_name) FROM nation) AS m, 1 + 1 AS two"),
    sql("group_star", "customer", "SELECT * FROM (SELECT c_nationkey, c_mktsegment FROM customer) t GROUP BY c_nationkey, c_mktsegment"),
    sql("like_escape", "part", "SELECT p_partkey, concat(p_name, '%x') LIKE '%!%_' ESCAPE '!' AS a, p_name LIKE '%!_%' ESCAPE '!' AS b FROM part"),
    Query("catalog_columns", _catalog, _catalog_sql()),
]
