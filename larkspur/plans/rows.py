"""Set-returning functions, COPY round trips and catalog relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import regex
from larkspur.operators import srf
from larkspur.plans import Query, frame, sql
from larkspur.sources import copytext


def _decoded(form: str):
    """Customers written in a COPY form and decoded again, as typed rows."""

    def build(customers: DataFrame) -> DataFrame:
        odd = customers.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.concat("c_name", F.lit('\t"x\\y",'), "c_mktsegment")).alias("note"), "c_acctbal")
        lines = (copytext.text_lines if form == "text" else copytext.csv_lines)(odd)
        work = copytext.decode_text if form == "text" else copytext.decode_csv

        def decode(batches):
            for batch in batches:
                fields = [work(x) for x in batch["value"]]
                batch = batch.iloc[:, :0]
                batch["c_custkey"] = [int(f[0]) for f in fields]
                batch["note"] = [f[1] for f in fields]
                batch["c_acctbal"] = [float(f[2]) for f in fields]
                yield batch

        return lines.mapInPandas(decode, T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("note", T.StringType()), T.StructField("c_acctbal", T.DoubleType())]))

    return build


_COPY_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name || chr(9) || '"x\\y",' || c_mktsegment END AS note, c_acctbal FROM customer"""

QUERIES: list[Query] = [
    frame("srf_series", "nation", lambda n: srf.generate_series(n, "i", F.lit(1), F.col("n_nationkey") % 4).select("n_nationkey", "i"), "SELECT n_nationkey, unnest(generate_series(1, n_nationkey % 4)) AS i FROM nation"),
    frame("srf_series_down", "nation", lambda n: srf.generate_series(n, "i", F.col("n_nationkey"), F.lit(3), F.lit(-5)).select("n_nationkey", "i"), "SELECT n_nationkey, unnest(generate_series(n_nationkey, 3, -5)) AS i FROM nation"),
    sql("srf_series_time", "region", "SELECT r_regionkey, explode(sequence(DATE '2024-01-31', DATE '2024-05-31', INTERVAL 1 MONTH)) AS d FROM region", "SELECT r_regionkey, unnest(generate_series(0, 4)) AS i, (DATE '2024-01-31' + to_months(i::INTEGER))::DATE AS d FROM region".replace("SELECT r_regionkey, unnest(generate_series(0, 4)) AS i, (DATE '2024-01-31' + to_months(i::INTEGER))::DATE AS d FROM region", "SELECT r_regionkey, (DATE '2024-01-31' + to_months(i::INTEGER))::DATE AS d FROM region, range(5) g(i)")),
    frame("srf_unnest_ordinality", "part", lambda p: srf.unnest(p.select("p_partkey", F.split("p_type", " ").alias("ws")), F.col("ws"), "w", "n").select("p_partkey", "w", "n"),
        "SELECT p_partkey, w, n FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS n FROM part)"),
    frame("srf_lockstep", "part", lambda p: srf.lockstep(p.select("p_partkey", F.split("p_type", " ").alias("ws"), F.split("p_name", " ").alias("ns")), w=F.col("ws"), m=F.col("ns")).select("p_partkey", "w", "m"),
        "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, unnest(string_split(p_name, ' ')) AS m FROM part"),
    frame("srf_subscripts", "part", lambda p: p.select("p_partkey", F.explode(srf.subscripts(F.split("p_type", " "))).alias("i")), "SELECT p_partkey, unnest(range(1, len(string_split(p_type, ' ')) + 1))::INTEGER AS i FROM part"),
    frame("srf_string_to_table", "part", lambda p: p.select("p_partkey", F.explode(regex.split(F.col("p_type"), "[ E]")).alias("w")), "SELECT p_partkey, unnest(string_split_regex(p_type, '[ E]')) AS w FROM part"),
    frame("srf_regexp_matches", "part", lambda p: p.select("p_partkey", F.explode(regex.all_matches(F.col("p_type"), "([A-Z])([AEIOU])")).alias("m")).select("p_partkey", F.get("m", 0).alias("a"), F.get("m", 1).alias("b")),
        "SELECT p_partkey, m[1] AS a, m[2] AS b FROM (SELECT p_partkey, unnest(regexp_extract_all(p_type, '[A-Z][AEIOU]')) AS m FROM part)"),
    frame("srf_json_each", "events", lambda e: e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")), "SELECT event_id, 'k' AS key, props->>'k' AS value FROM events"),
    frame("srf_json_elements", "events", lambda e: e.select("event_id", F.explode(F.from_json(F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(",7]")), "array<int>")).alias("x")), "SELECT event_id, unnest([(props->>'k')::INTEGER, 7]) AS x FROM events"),
    frame("srf_json_keys", "events", lambda e: e.select("event_id", F.explode(F.json_object_keys("props")).alias("k")), "SELECT event_id, unnest(json_keys(props)) AS k FROM events"),
    frame("copy_text_round_trip", "customer", _decoded("text"), _COPY_SQL),
    frame("copy_csv_round_trip", "customer", _decoded("csv"), _COPY_SQL),
    frame("copy_text_out", "nation", lambda n: copytext.text_lines(n.select("n_nationkey", F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("n"), F.lit("a\tb\\c").alias("t"))), "SELECT n_nationkey || chr(9) || CASE WHEN n_regionkey > 0 THEN n_name ELSE '\\N' END || chr(9) || 'a\\' || chr(9) || 'b\\\\c' AS value FROM nation"),
    frame("copy_csv_out", "nation", lambda n: copytext.csv_lines(n.select("n_nationkey", F.concat("n_name", F.lit(', "x"')).alias("n"), F.lit(None).cast("string").alias("t"))), "SELECT n_nationkey || ',\"' || n_name || ', \"\"x\"\"\",' AS value FROM nation"),
]
