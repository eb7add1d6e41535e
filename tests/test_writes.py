import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators import definitions as D
from larkspur.operators import writes as W
from larkspur.operators.recursion import recursive_union
from larkspur.sources import copybinary, copytext
from larkspur.streaming.feeds import subscribe


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    for rules, state in (
        (W.Constraints(not_null=["v"]), "23502"),
        (W.Constraints(checks={"small": F.col("id") < 2}), "23514"),
        (W.Constraints(foreign_keys=[(["id"], df.where("id = 1"), ["id"])]), "23503"),
    ):
        with pytest.raises(W.ConstraintError) as e:
            rules.validate(df)
        assert e.value.sqlstate == state
    with pytest.raises(W.ConstraintError):
        W.Constraints(unique=[["id"]]).validate(df.union(df))
    assert W.Constraints(unique=[["v"]]).validate(df.where("id = 2").union(df.where("id = 2"))).count() == 2  # nulls differ


def test_upsert_twice_is_an_error(spark):
    t = spark.createDataFrame([(1, 1)], "id int, v int")
    s = spark.createDataFrame([(1, 2), (1, 3)], "id int, v int")
    with pytest.raises(PySparkException):
        W.upsert(t, s, ["id"], {"v": F.col("s.v")}).collect()


def test_merge_takes_the_first_clause(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, v int")
    s = spark.createDataFrame([(1, 11), (2, 21), (4, 41)], "id int, v int")
    out = W.merge(t, s, ["id"], [W.When(True, F.col("t.id") == 1, delete=True), W.When(True, update={"v": F.col("s.v")}), W.When(False, insert={"id": F.col("s.id")})])
    assert rows(out) == [(2, 21), (3, 30), (4, None)]


def test_materialized_view_and_overwrite(spark, tmp_path):
    source = str(tmp_path / "t")
    spark.createDataFrame([(1,)], "id int").write.parquet(source)
    view = W.MaterializedView(str(tmp_path / "v"), lambda: spark.read.parquet(source).groupBy().count())
    view.refresh()
    W.overwrite(spark.read.parquet(source).union(spark.read.parquet(source)), source)  # reads what it replaces
    assert view.read().first()[0] == 1
    view.refresh()
    assert view.read().first()[0] == 2


def test_recursive_union_stops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int")
    seed = spark.createDataFrame([(1,)], "k int")
    step = lambda r: r.join(edges, F.col("k") == F.col("a")).select(F.col("b").alias("k"))
    assert rows(recursive_union(seed, step)) == [(1,), (2,), (3,)]
    with pytest.raises(RecursionError):
        recursive_union(seed, step, distinct=False, most=4)


def test_subscription(spark, tmp_path):
    table, feed = str(tmp_path / "t"), str(tmp_path / "feed")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(table)
    schema = "op string, seq long, id int, v string"
    spark.createDataFrame([("update", 1, 1, "x"), ("delete", 2, 2, None), ("insert", 3, 3, "c"), ("update", 4, 3, "d")], schema).write.parquet(feed)
    for _ in range(2):  # the second run finds nothing new
        q = subscribe(spark, feed, spark.read.parquet(feed).schema, table, ["id"], str(tmp_path / "cp"))
        q.awaitTermination()
        assert rows(spark.read.parquet(table)) == [(1, "x"), (3, "d")]
    spark.createDataFrame([("truncate", 5, None, None), ("insert", 6, 9, "z")], schema).write.mode("append").parquet(feed)
    subscribe(spark, feed, spark.read.parquet(feed).schema, table, ["id"], str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(table)) == [(9, "z")]


def test_copy_decoders():
    assert copytext.decode_text("a\\tb\t\\N\t\\101\\x42\t\\\\N") == ["a\tb", None, "AB", "\\N"]
    assert copytext.decode_csv('1,"",,"a ""q"", b"') == ["1", "", None, 'a "q", b']
    assert copytext.decode_csv('"",x', force_null=frozenset({0})) == [None, "x"]
    assert copytext.decode_csv(",x", force_not_null=frozenset({0})) == ["", "x"]


def test_copy_from(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("id\tv\n1\ta\nx\tb\n3\t\\N\n\\.\n")
    schema = spark.createDataFrame([], "id int, v string").schema
    got = copytext.read(spark, str(path), schema, header=True, on_error="ignore", where=F.col("id") > 0)
    assert rows(got) == [(1, "a"), (3, None)]
    with pytest.raises(ValueError):
        copytext.read(spark, str(path), schema, header=True, on_error="ignore", reject_limit=0)
    with pytest.raises(PySparkException):
        copytext.read(spark, str(path), schema, header=True).collect()


def test_copy_binary_round_trip(spark, tmp_path):
    copybinary.register(spark)
    df = spark.sql("SELECT 1 AS a, 2L AS b, 1.5D AS c, 'é' AS d, true AS e, DATE '2024-02-29' AS f, TIMESTAMP_NTZ '2024-02-29 01:02:03.5' AS g, CAST(NULL AS string) AS h")
    path = str(tmp_path / "b")
    df.write.format("pgcopy").mode("append").save(path)
    assert rows(spark.read.format("pgcopy").schema(df.schema).load(path)) == rows(df)


def test_keys_with_a_null_never_conflict(spark):
    table = spark.createDataFrame([(1, 1), (None, 5)], "k int, v int")
    source = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (4, 4), (4, 4)], "k int, v int")
    after, fresh = W.insert_do_nothing(table, source, ["k"])
    assert sorted(map(tuple, fresh.collect()), key=str) == [(4, 4), (None, 1), (None, 2)] and after.count() == 5
    once = source.where("v <> 4")
    assert W.upsert(table, once, ["k"], {"v": F.col("s.v")}).count() == 4
    with pytest.raises(Exception, match="second time"):
        W.upsert(table, source, ["k"], {"v": F.col("s.v")}).collect()


def test_copy_ends_and_headers(spark, tmp_path):
    """A file ends at its end mark; only its first line is a header."""
    (tmp_path / "a.csv").write_text("id,v\n1,a\nid,v\n2,b\n\\.\n3,c\n")
    (tmp_path / "b.csv").write_text("id,v\n9,z\n")
    schema = T.StructType.fromDDL("id string, v string")
    rows = copytext.read(spark, str(tmp_path), schema, "csv", header=True).collect()
    assert sorted(map(tuple, rows)) == [("1", "a"), ("2", "b"), ("9", "z"), ("id", "v")]
    assert copytext.read(spark, str(tmp_path), schema, "csv").count() == 6


def test_definitions_refuse(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    with pytest.raises(Exception, match="no partition"):
        df.select(D.by_range(F.col("k"), {"p": (0, 5)})).collect()
    assert [r[0] for r in df.select(D.by_range(F.col("k"), {"p": (0, 5)}, "rest")).collect()] == ["p", "rest"]
    for wrong in (lambda: D.add_column(df, "k", "int"), lambda: D.drop_column(df, "x"), lambda: D.rename_column(df, "x", "y")):
        with pytest.raises(ValueError):
            wrong()
    assert D.fetch(df.where("k is not null"), ["k"], 5, (1,)).count() == 0
