"""Dates, timestamps and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import dates as D
from larkspur.plans import Query, frame, sql


def col(query: str, column, oracle: str) -> Query:
    return frame(query, "orders", lambda t: t.select("o_orderkey", column(F.col("o_orderdate"), F.col("o_orderkey")).alias("v")), f"SELECT o_orderkey, {oracle} AS v FROM orders")


def event(query: str, column, oracle: str) -> Query:
    return frame(query, "events", lambda t: t.select("event_id", column(F.col("ts")).alias("v")), f"SELECT event_id, {oracle} AS v FROM events")


def origin():
    return F.lit("2024-01-01 00:05:00").cast("timestamp_ntz")


def parts(i):
    return F.concat_ws(",", i["months"], i["days"], i["micros"])


QUERIES: list[Query] = [
    *[event(f"time_extract_{f}", lambda ts, f=f: D.extract(f, ts), f"date_part('{f}', ts)::DOUBLE") for f in ("year", "month", "day", "hour", "minute", "dow", "isodow", "doy", "quarter", "decade", "century", "millennium", "week", "isoyear", "epoch")],
    event("time_extract_second", lambda ts: D.extract("second", ts), "second(ts) + (epoch_us(ts) % 1000000) / 1e6"),
    sql("time_trunc", "events", "SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('week', ts) AS w, date_trunc('quarter', ts) AS q, date_trunc('month', ts) AS m FROM events",
        "SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('week', ts)::TIMESTAMP AS w, date_trunc('quarter', ts)::TIMESTAMP AS q, date_trunc('month', ts)::TIMESTAMP AS m FROM events"),
    event("time_bin", lambda ts: D.date_bin(900_000_000, ts, origin()), "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2024-01-01 00:05:00')"),
    col("date_add_days", lambda o, k: F.date_add(o.cast("date"), (k % 50).cast("int")), "o_orderdate::DATE + (o_orderkey % 50)::INTEGER"),
    col("date_minus_date", lambda o, k: D.date_minus(o.cast("date"), F.lit("1995-01-01").cast("date")), "date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INTEGER"),
    col("time_add_months", lambda o, k: D.add(o, D.interval((k % 14).cast("int"), 3, 3_600_000_000)), "o_orderdate + to_months((o_orderkey % 14)::INTEGER) + INTEGER '3' * INTERVAL 1 DAY + INTERVAL 1 HOUR"),
    event("time_minus", lambda ts: parts(D.minus(ts, origin())), """concat_ws(',', 0, CASE WHEN us >= 0 THEN us // 86400000000 ELSE -(-us // 86400000000) END, us - 86400000000 * CASE WHEN us >= 0 THEN us // 86400000000 ELSE -(-us // 86400000000) END)""".replace("us ", "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:05:00')) ").replace("-us", "-(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:05:00'))")),
    col("time_age", lambda o, k: parts(D.age(F.lit("1999-03-15").cast("timestamp_ntz"), o)), "concat_ws(',', date_part('year', age(TIMESTAMP '1999-03-15', o_orderdate)) * 12 + date_part('month', age(TIMESTAMP '1999-03-15', o_orderdate)), date_part('day', age(TIMESTAMP '1999-03-15', o_orderdate)), 0)"),
    col("time_justify", lambda o, k: parts(D.justify_days(D.justify_hours(D.interval(0, (k % 90).cast("int"), k * 7_200_000_000)))),
        "concat_ws(',', (o_orderkey % 90 + o_orderkey * 7200000000 // 86400000000) // 30, (o_orderkey % 90 + o_orderkey * 7200000000 // 86400000000) % 30, o_orderkey * 7200000000 % 86400000000)"),
    col("time_interval_epoch", lambda o, k: D.epoch(D.interval((k % 30).cast("int"), 2, 1_500_000)), "((o_orderkey % 30) // 12 * 365.25 + ((o_orderkey % 30) % 12) * 30 + 2) * 86400.0 + 1.5"),
    col("date_make", lambda o, k: F.make_date(F.year(o), F.month(o), F.lit(1)), "make_date(year(o_orderdate), month(o_orderdate), 1)"),
    sql("time_make", "orders", "SELECT o_orderkey, make_timestamp_ntz(year(o_orderdate), month(o_orderdate), 1, cast(o_orderkey % 24 AS INT), 30, 15.5) AS v FROM orders",
        "SELECT o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), 1, o_orderkey % 24, 30, 15.5) AS v FROM orders"),
    event("time_to_char", lambda ts: D.to_char(ts, "YYYY-MM-DD HH24:MI:SS"), "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    event("time_to_char_names", lambda ts: D.to_char(ts, "Dy, DD Mon YYYY HH12:MI AM"), "strftime(ts, '%a, %d %b %Y %I:%M %p')"),
    event("time_to_timestamp", lambda ts: D.to_timestamp(D.to_char(ts, "DD/MM/YYYY HH24.MI"), "DD/MM/YYYY HH24.MI"), "date_trunc('minute', ts)"),
    event("time_to_date", lambda ts: D.to_date(D.to_char(ts, "DD Mon YYYY"), "DD Mon YYYY"), "ts::DATE"),
    event("time_zone_in", lambda ts: D.at_time_zone(ts, "Asia/Tokyo"), "ts - INTERVAL 9 HOUR"),
    event("time_zone_out", lambda ts: D.in_time_zone(ts, "Asia/Kolkata"), "ts + INTERVAL 330 MINUTE"),
    event("time_from_epoch", lambda ts: D.from_micros(F.unix_micros(ts.cast("timestamp"))), "make_timestamp(epoch_us(ts))"),
]
