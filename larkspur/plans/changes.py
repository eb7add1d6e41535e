"""Row changes: inserts with conflicts, updates, deletes, merges, constraints, change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import writes as W
from larkspur.plans import Query, frame
from larkspur.streaming.feeds import apply_changes

KEY = ["c_custkey"]
#: Customers of even keys with a new balance, and as many new ones.
_NEW_SQL = "SELECT c_custkey * 2 AS c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer"
_OLD_SQL = "SELECT * FROM customer"


def proposed(c: DataFrame) -> DataFrame:
    return c.select((F.col("c_custkey") * 2).alias("c_custkey"), "c_name", "c_nationkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))


def upsert(c: DataFrame) -> DataFrame:
    return W.upsert(c, proposed(c), KEY, {"c_acctbal": F.col("t.c_acctbal") + F.col("s.c_acctbal"), "c_mktsegment": F.col("s.c_mktsegment")}, F.col("t.c_nationkey") < 12)


def merge(c: DataFrame) -> DataFrame:
    s = proposed(c)
    return W.merge(c, s, KEY, [
        W.When(True, F.col("t.c_nationkey") == 3, delete=True),
        W.When(True, F.col("s.c_acctbal") > 5000, update={"c_acctbal": F.col("s.c_acctbal")}),
        W.When(True),
        W.When(False, F.col("s.c_nationkey") > 5, insert={k: F.col(f"s.{k}") for k in c.columns}),
    ])


def changed(c: DataFrame) -> DataFrame:
    """A feed in which each customer of an even key is updated twice, and each third one then deleted."""
    base = c.where("c_custkey % 2 = 0")
    feed = base.select(F.lit("update").alias("op"), F.col("c_custkey").alias("seq"), "*").unionByName(
        base.select(F.lit("update").alias("op"), (F.col("c_custkey") + 1_000_000_000).alias("seq"), "*").withColumn("c_acctbal", F.col("c_acctbal") * 2)
    )
    gone = c.where("c_custkey % 3 = 0").select(F.lit("delete").alias("op"), (F.col("c_custkey") + 2_000_000_000).alias("seq"), "*")
    return apply_changes(c, feed.unionByName(gone), KEY)


def checked(c: DataFrame, n: DataFrame) -> DataFrame:
    rules = W.Constraints(not_null=KEY, unique=[KEY], checks={"balance": F.col("c_acctbal") > -100000}, foreign_keys=[(["c_nationkey"], n, ["n_nationkey"])], defaults={"status": F.lit("new")}, generated={"twice": F.col("c_acctbal") * 2})
    return rules.validate(rules.filled(c, [*c.columns, "status", "twice"])).select("c_custkey", "status", "twice")


_JOINED = f"FROM ({_OLD_SQL}) t FULL JOIN ({_NEW_SQL}) s ON t.c_custkey = s.c_custkey"

QUERIES: list[Query] = [
    frame("dml_insert_do_nothing", "customer", lambda c: W.insert_do_nothing(c, proposed(c), KEY)[0], f"{_OLD_SQL} UNION ALL SELECT * FROM ({_NEW_SQL}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)"),
    frame("dml_insert_returning", "customer", lambda c: W.insert_do_nothing(c, proposed(c), KEY)[1], f"SELECT * FROM ({_NEW_SQL}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)"),
    frame("dml_upsert", "customer", upsert, f"""SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(t.c_name, s.c_name) AS c_name, coalesce(t.c_nationkey, s.c_nationkey) AS c_nationkey,
        CASE WHEN t.c_custkey IS NULL THEN s.c_acctbal WHEN s.c_custkey IS NOT NULL AND t.c_nationkey < 12 THEN t.c_acctbal + s.c_acctbal ELSE t.c_acctbal END AS c_acctbal,
        CASE WHEN t.c_custkey IS NULL OR (s.c_custkey IS NOT NULL AND t.c_nationkey < 12) THEN s.c_mktsegment ELSE t.c_mktsegment END AS c_mktsegment {_JOINED}"""),
    frame("dml_update_from", "customer", lambda c: W.update_from(c, proposed(c), KEY, {"c_acctbal": F.col("s.c_acctbal") * 2}, F.col("t.c_nationkey") > 3), f"""SELECT t.c_custkey, t.c_name, t.c_nationkey,
        CASE WHEN s.c_custkey IS NOT NULL AND t.c_nationkey > 3 THEN s.c_acctbal * 2 ELSE t.c_acctbal END AS c_acctbal, t.c_mktsegment FROM customer t LEFT JOIN ({_NEW_SQL}) s ON t.c_custkey = s.c_custkey"""),
    frame("dml_delete_using", "customer", lambda c: W.delete_using(c, proposed(c), KEY)[0], f"SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_NEW_SQL}))"),
    frame("dml_delete_returning", "customer", lambda c: W.delete_using(c, proposed(c), KEY)[1], f"SELECT * FROM customer WHERE c_custkey IN (SELECT c_custkey FROM ({_NEW_SQL}))"),
    frame("dml_merge", "customer", merge, f"""SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(t.c_name, s.c_name) AS c_name, coalesce(t.c_nationkey, s.c_nationkey) AS c_nationkey,
        CASE WHEN t.c_custkey IS NULL OR s.c_acctbal > 5000 THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal, CASE WHEN t.c_custkey IS NULL THEN s.c_mktsegment ELSE t.c_mktsegment END AS c_mktsegment {_JOINED}
        WHERE (t.c_custkey IS NOT NULL AND NOT (s.c_custkey IS NOT NULL AND t.c_nationkey = 3)) OR (t.c_custkey IS NULL AND s.c_nationkey > 5)"""),
    frame("dml_change_feed", "customer", changed, "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0"),
    frame("dml_constraints", "customer nation", checked, "SELECT c_custkey, 'new' AS status, c_acctbal * 2 AS twice FROM customer"),
]
