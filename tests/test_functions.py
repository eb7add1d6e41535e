"""Values that PostgreSQL documents, on inline rows."""

import decimal

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larkspur.functions import arrays, bits, dates, jsons, net, numbers, ranges, regex, strings
from larkspur.functions.templates import number_text, to_char, to_number
from larkspur.registry import ORACLES, QUERIES


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("template, number, text", [
    ("999.99", "3.14", "   3.14"), ("FM999.99", "3.10", "3.1"), ("0999.9", "-12.34", "-0012.3"), ("9,999", "1234567", " #,###"), ("9,999,999", "1234567", " 1,234,567"), ("999PR", "-5", "  <5>"),
    ("999MI", "-5", "  5-"), ("S999", "5", "  +5"), ("999S", "-5", "  5-"), ("RN", "1994", "MCMXCIV".rjust(15)), ("FMRN", "4", "IV"), ("9.99EEEE", "12345", " 1.23e+04"), ("999.99", "0.5", "    .50"), ("FM990.00", "0", "0.00"),
])
def test_number_templates(template, number, text):
    assert number_text(decimal.Decimal(number), template) == text


def test_number_columns(spark):
    assert value(spark, to_char(F.lit(3.14), "999.99")) == "   3.14"
    assert value(spark, to_number(F.lit("-12,345.6"), "99,999.9")) == decimal.Decimal("-12345.6")
    with pytest.raises(ValueError):
        number_text(decimal.Decimal(1), "9V9")


def test_strings(spark):
    assert value(spark, strings.substr(F.lit("abc"), 0, 2)) == "a"
    assert value(spark, strings.left(F.lit("abc"), -1)) == "ab"
    assert value(spark, strings.right(F.lit("abc"), -1)) == "bc"
    assert value(spark, strings.initcap(F.lit("hi-THERE bob's"))) == "Hi-There Bob'S"
    assert value(spark, strings.concat(F.lit("a"), F.lit(None).cast("string"))) == "a"
    assert value(spark, strings.chr_(F.lit(0x20AC))) == "€"
    assert value(spark, strings.quote_literal(F.lit("O'Re\\il"))) == "E'O''Re\\\\il'"
    assert value(spark, strings.format_("%I is %L, 100%%", F.lit("A b"), F.lit(None).cast("string"))) == '"A b" is NULL, 100%'
    assert value(spark, strings.similar_to(F.lit("abc"), "%(b|d)%")) is True
    assert value(spark, strings.similar_to(F.lit("a.c"), "a.c")) is True
    assert value(spark, strings.similar_to(F.lit("abc"), "a.c")) is False
    assert value(spark, strings.size_pretty(F.lit(10240))) == "10 kB"
    with pytest.raises(PySparkException):
        value(spark, strings.substr(F.lit("abc"), 1, -1))


def test_size_pretty_stops_at_the_largest_unit(spark):
    sizes = [10239, 10240, 10485247, 10485248, 44_400_000, 1 << 40]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select(strings.size_pretty(F.col("n")), strings.size_pretty(F.col("n"), "kB")).collect()
    assert [r[0] for r in rows] == ["10239 bytes", "10 kB", "10239 kB", "10 MB", "42 MB", "1024 GB"]
    assert [r[1] for r in rows] == ["10239 bytes", "10 kB", "10239 kB", "10240 kB", "43359 kB", f"{1 << 30} kB"]


def test_str_size_pretty_of_large_keys(spark, tmp_path):
    spark.range(280_000, 290_000, 7).selectExpr("id AS p_partkey", "'' AS p_name", "'' AS p_type", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        want = dict(con.sql(ORACLES["str_size_pretty"]).fetchall())
    assert {r.p_partkey: r.v for r in QUERIES["str_size_pretty"](spark, str(tmp_path)).collect()} == want


def test_regex(spark):
    assert value(spark, regex.replace(F.lit("foobarbaz"), "b..", "X")) == "fooXbaz"
    assert value(spark, regex.replace(F.lit("foobarbaz"), "b..", "X", "g")) == "fooXX"
    assert value(spark, regex.replace(F.lit("foobarbaz"), "b(..)", "X\\1Y", "g")) == "fooXarYXazY"
    assert value(spark, regex.replace(F.lit("foobarbaz"), "b(..)", "[\\&]")) == "foo[bar]baz"
    assert value(spark, regex.substring(F.lit("foobar"), "o(.)b")) == "o"
    assert value(spark, regex.all_matches(F.lit("a1b2"), "([a-z])(\\d)")) == [["a", "1"], ["b", "2"]]
    with pytest.raises(ValueError):
        regex.replace(F.lit("a"), "a", "b", "z")


def test_numbers(spark):
    assert value(spark, numbers.round_float(F.lit(2.5))) == 2
    assert value(spark, numbers.round_numeric(F.lit("2.5"))) == 3
    assert value(spark, numbers.float_to_int(F.lit(2.7))) == 3
    assert value(spark, numbers.gcd(F.lit(1071), F.lit(-462))) == 21
    assert value(spark, numbers.lcm(F.lit(4), F.lit(6))) == 12
    assert value(spark, numbers.width_bucket(F.lit(35), F.array(*[F.lit(x) for x in (10, 20, 30)]))) == 3
    assert value(spark, numbers.num_nulls(F.lit(None), F.lit(1))) == 1
    assert value(spark, numbers.factorial(F.lit(25))) == decimal.Decimal("15511210043330985984000000")
    with pytest.raises(PySparkException):
        value(spark, numbers.log10_(F.lit(0.0)))


def test_dates(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    assert tuple(value(spark, dates.age(ts("2024-03-01"), ts("2024-01-31")))) == (1, 1, 0)
    assert tuple(value(spark, dates.age(ts("2001-04-10"), ts("1957-06-13")))) == (43 * 12 + 9, 27, 0)
    assert tuple(value(spark, dates.justify_hours(dates.interval(0, 0, 27 * 3_600_000_000)))) == (0, 1, 3 * 3_600_000_000)
    assert tuple(value(spark, dates.justify_days(dates.interval(0, 35)))) == (1, 5, 0)
    assert str(value(spark, dates.add(ts("2024-01-31 10:00:00"), dates.interval(1)))) == "2024-02-29 10:00:00"
    assert value(spark, dates.extract("century", ts("2000-12-16"))) == 20
    assert value(spark, dates.extract("isodow", ts("2024-03-03"))) == 7
    assert value(spark, dates.overlaps(ts("2001-02-16"), ts("2001-12-21"), ts("2001-10-30"), ts("2002-10-30"))) is True
    assert value(spark, dates.to_char(ts("2024-03-01 14:05:09"), "DD/MM/YYYY HH12:MI:SS AM")) == "01/03/2024 02:05:09 PM"
    with pytest.raises(ValueError):
        dates.java_pattern("YYYY-WW")


def test_arrays(spark):
    a = F.array(F.lit(1), F.lit(None), F.lit(2))
    assert value(spark, arrays.at(a, 4)) is None
    assert value(spark, arrays.position(a, F.lit(None).cast("int"))) == 2
    assert value(spark, arrays.position(a, F.lit(9))) is None
    assert value(spark, arrays.literal(F.array(F.lit('a"b'), F.lit(None), F.lit("")))) == '{"a\\"b",NULL,""}'
    assert value(spark, arrays.parse_literal(F.lit('{a,"b,\\"c",NULL}'))) == ["a", 'b,"c', None]
    assert value(spark, arrays.from_string(F.lit("abc"), None)) == ["a", "b", "c"]
    assert value(spark, arrays.contains(a, F.array(F.lit(None).cast("int")))) is False


def test_ranges(spark):
    r = lambda lo, hi, b="[)": ranges.make_discrete(F.lit(lo).cast("int"), F.lit(hi).cast("int"), b)
    assert value(spark, ranges.text(r(1, 3, "[]"))) == "[1,4)"
    assert value(spark, ranges.text(r(3, 3))) == "empty"
    assert value(spark, ranges.text(ranges.intersect(r(1, 5), r(3, 9)))) == "[3,5)"
    assert value(spark, ranges.text(ranges.union(r(1, 3), r(3, 9)))) == "[1,9)"
    assert [tuple(x)[:2] for x in value(spark, ranges.multirange(F.array(r(1, 3), r(2, 5), r(7, 8))))] == [(1, 5), (7, 8)]
    assert value(spark, ranges.contains_value(r(None, 5), F.lit(-100))) is True
    with pytest.raises(PySparkException):
        value(spark, ranges.text(ranges.union(r(1, 3), r(5, 9))))


def test_bits_and_addresses(spark):
    assert value(spark, bits.xor(F.lit("1100"), F.lit("1010"))) == "0110"
    assert value(spark, bits.from_hex(F.lit("1F"))) == "00011111"
    assert value(spark, bits.encode_escape(F.unhex(F.lit("00415CFF")))) == "\\000A\\\\\\377"
    a = net.inet(F.lit("192.168.1.5/24"))
    assert value(spark, net.text(net.network(a))) == "192.168.1.0/24"
    assert value(spark, net.text(net.broadcast(a))) == "192.168.1.255/24"
    assert value(spark, net.within(a, net.inet(F.lit("192.168.0.0/16")))) is True
    assert value(spark, net.text(net.merge(a, net.inet(F.lit("192.168.2.5/24"))))) == "192.168.0.0/22"
    with pytest.raises(PySparkException):
        value(spark, net.text(net.inet(F.lit("300.1.1.1"))))


def test_json(spark):
    j = F.lit('{"b":1,"aa":null,"a":[1,{"x":2}]}')
    assert value(spark, jsons.canonical(j)) == '{"a": [1, {"x": 2}], "b": 1, "aa": null}'
    assert value(spark, jsons.set_path(j, ["a", 1, "x"], F.lit("9"))) == '{"a": [1, {"x": 9}], "b": 1, "aa": null}'
    assert value(spark, jsons.delete_path(j, ["a", 0])) == '{"a": [{"x": 2}], "b": 1, "aa": null}'
    assert value(spark, jsons.contains(j, F.lit('{"a":[{"x":2}]}'))) is True
    assert value(spark, jsons.typeof(F.lit("[1]"))) == "array"
    assert value(spark, jsons.element(F.lit("[1,2,3]"), -1)) == "3"


def test_replace_first_match(spark):
    assert value(spark, regex.replace(F.lit("xbxb"), "a|b", "Z")) == "xZxb"
    assert value(spark, regex.replace(F.lit("a\nb ab"), "a.", "Z")) == "a\nb Z"
    assert value(spark, regex.replace(F.lit("foobar"), "(o)\\1", "<\\1\\&>")) == "f<ooo>bar"


def test_json_keeps_digits(spark):
    assert value(spark, jsons.canonical(F.lit('{"b":12345678901234567890.123,"a":1e3}'))) == '{"a": 1000, "b": 12345678901234567890.123}'
    with pytest.raises(PySparkException):
        value(spark, jsons.canonical(F.lit("[NaN]")))


def test_dates_by_template(spark):
    t = F.lit("2024-05-03 07:08:09").cast("timestamp_ntz")
    assert value(spark, dates.to_char(t, 'Month|Day|FMMonth|FMDDth|IYYY-IW|J|HH12:MI AM|DDD|"q"D')) == "May      |Friday   |May|3rd|2024-18|2460434|07:08 AM|124|q6"
    with pytest.raises(ValueError):
        dates.to_char(t, "RM")


@pytest.mark.parametrize("months, days, micros, text, justified", [
    (14, -3, 3_600_000_000, "1 year 2 mons -3 days 01:00:00", "1 year 1 mon 27 days 01:00:00"), (1, -1, 0, "1 mon -1 days", "29 days"), (0, 0, 0, "00:00:00", "00:00:00"), (0, 0, -1_500_000, "-00:00:01.5", "-00:00:01.5"),
])
def test_intervals(spark, months, days, micros, text, justified):
    i = dates.interval(months, days, micros)
    assert value(spark, dates.interval_text(i)) == text
    assert value(spark, dates.interval_text(dates.justify_interval(i))) == justified
