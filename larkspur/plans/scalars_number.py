"""Arithmetic and conditional functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import numbers as N
from larkspur.plans import Query, frame, sql


def col(query: str, column, oracle: str, table: str = "lineitem", key: str = "l_orderkey, l_linenumber, l_partkey") -> Query:
    return frame(query, table, lambda t: t.select(*key.split(", "), column(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber")).alias("v")), f"SELECT {key}, {oracle} AS v FROM {table}")


QUERIES: list[Query] = [
    sql("num_arithmetic", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 1 AS a, l_quantity - l_discount AS s, l_quantity * l_tax AS m, l_extendedprice / l_quantity AS d, l_partkey % 7 AS r FROM lineitem"),
    col("num_int_div", lambda q, p, n: N.div(F.col("l_partkey"), n + 1), "l_partkey // (l_linenumber + 1)"),
    col("num_mod_negative", lambda q, p, n: (F.lit(5) - F.col("l_partkey")) % 7, "(5 - l_partkey) % 7"),
    col("num_round_float", lambda q, p, n: N.round_float(p / 2), "round_even(l_extendedprice / 2, 0)"),
    col("num_round_numeric", lambda q, p, n: N.round_numeric(p, -2).cast("double"), "round(l_extendedprice::DECIMAL(18, 6), -2)::DOUBLE"),
    col("num_float_to_int", lambda q, p, n: N.float_to_int(q / 4), "(l_quantity / 4)::INTEGER"),
    col("num_trunc", lambda q, p, n: N.trunc(F.lit(10.0) - p / 1000), "trunc(10.0 - l_extendedprice / 1000)"),
    sql("num_floor_ceil", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice) AS f, ceil(l_extendedprice) AS c, abs(5 - l_quantity) AS a, sign(5 - l_quantity) AS s FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice)::BIGINT AS f, ceil(l_extendedprice)::BIGINT AS c, abs(5 - l_quantity) AS a, sign(5 - l_quantity)::DOUBLE AS s FROM lineitem"),
    sql("num_roots", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity), 6) AS r, round(cbrt(l_quantity), 6) AS c, round(exp(l_discount), 6) AS e, round(ln(l_quantity), 6) AS l, power(l_linenumber, 3) AS p FROM lineitem"),
    col("num_log", lambda q, p, n: F.round(N.log10_(p), 6), "round(log(l_extendedprice), 6)"),
    col("num_gcd", lambda q, p, n: N.gcd(F.col("l_partkey"), F.col("l_orderkey")), "gcd(l_partkey, l_orderkey)"),
    col("num_lcm", lambda q, p, n: N.lcm(F.col("l_partkey"), n), "lcm(l_partkey, l_linenumber)"),
    col("num_width_bucket", lambda q, p, n: N.width_bucket_range(q, 0.0, 60.0, 6), "CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 60 THEN 7 ELSE floor(l_quantity / 10)::BIGINT + 1 END"),
    col("num_width_bucket_array", lambda q, p, n: N.width_bucket(q, F.array(F.lit(5.0), F.lit(20.0), F.lit(40.0))), "(l_quantity >= 5)::INTEGER + (l_quantity >= 20)::INTEGER + (l_quantity >= 40)::INTEGER"),
    col("num_factorial", lambda q, p, n: N.factorial(n + 15).cast("string"), "factorial(l_linenumber + 15)::VARCHAR"),
    sql("num_trig", "lineitem", """SELECT l_orderkey, l_linenumber, l_partkey, round(sin(l_quantity), 6) AS s, round(cos(l_quantity), 6) AS c, round(tan(l_discount), 6) AS t, round(cot(l_quantity), 6) AS ct, round(asin(l_discount), 6) AS a,
        round(acos(l_discount), 6) AS ac, round(atan2(l_quantity, 3), 6) AS at, round(sinh(l_discount), 6) AS sh, round(cosh(l_discount), 6) AS ch, round(tanh(l_discount), 6) AS th, round(degrees(l_discount), 6) AS d, round(radians(l_quantity), 6) AS r FROM lineitem"""),
    sql("num_bitwise", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey & 12 AS a, l_partkey | 12 AS o, l_partkey ^ 12 AS x, ~l_partkey AS n, shiftleft(l_partkey, 2) AS l, shiftright(l_partkey, 2) AS r FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey & 12 AS a, l_partkey | 12 AS o, xor(l_partkey, 12) AS x, ~l_partkey AS n, l_partkey << 2 AS l, l_partkey >> 2 AS r FROM lineitem"),
    sql("cond_coalesce", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END, l_tax) AS c, nullif(l_linenumber, 2) AS n, greatest(l_tax, l_discount, CASE WHEN l_linenumber > 3 THEN 0.05 END) AS g, least(l_tax, NULL, l_discount) AS l FROM lineitem"),
    col("cond_num_nulls", lambda q, p, n: N.num_nulls(F.when(n > 2, q), F.when(n > 4, q), q), "(l_linenumber <= 2)::INTEGER + (l_linenumber <= 4)::INTEGER"),
    col("cond_num_nonnulls", lambda q, p, n: N.num_nonnulls(F.when(n > 2, q), F.when(n > 4, q), q), "(l_linenumber > 2)::INTEGER + (l_linenumber > 4)::INTEGER + 1"),
]
