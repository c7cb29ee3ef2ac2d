import pytest
from pyspark.sql import functions as F

from effectframe.operators import joins


def test_salted_join_equals_plain_join(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("k"), F.col("id") % 11)
    )
    left = spark.range(900).select(key.alias("k"), (F.col("id") % 5).alias("v"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 9)], "k string, w int")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("left", "inner"):
        got = joins.salted_join(left, right, ["k"], counts, how, hot_rows=20)
        want = left.join(right, "k", how)
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    with pytest.raises(ValueError):
        joins.salted_join(left, right.withColumnRenamed("w", "v"), ["k"], counts)


def test_any_number_of_hot_keys_is_salted(spark):
    left = spark.range(60_000).select((F.col("id") % 12_000).alias("k"), "id")
    right = spark.range(12_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = joins.salted_join(left, right, ["k"], counts, hot_rows=2)
    assert got.filter("w = 2 * k").count() == 60_000


def test_hot_keys_are_relative_to_the_table(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 500, 0).otherwise(F.col("id")).alias("k"))
    right = spark.createDataFrame([(0, 1), (700, 2)], "k long, w int")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = joins.salted_join(left, right, ["k"], counts)
    assert sorted(got.collect(), key=str) == sorted(left.join(right, "k", "left").collect(), key=str)
    assert joins.salted_join(left.limit(0), right, ["k"], counts.limit(0)).collect() == []


def test_null_safe_join(spark):
    left = spark.createDataFrame([("p", None), ("p", "x"), (None, None)], "a string, b string")
    right = spark.createDataFrame([("p", None, 1), (None, None, 2)], "a string, b string, c int")
    got = {tuple(r) for r in joins.null_safe_join(left, right, ["a", "b"]).collect()}
    assert got == {("p", None, 1), ("p", "x", None), (None, None, 2)}


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    first = joins.first_per_key(df, ["k"], ["v"])
    assert sorted(tuple(r) for r in first.collect()) == [(0, 0), (1, 1)]
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_merge_back_replaces_columns(spark):
    base = spark.createDataFrame([(1, "old", "x"), (2, "old", "y")], "id int, a string, b string")
    update = spark.createDataFrame([(1, "n2"), (1, "n1")], "id int, a string")
    got = {tuple(r) for r in joins.merge_back(base, update, "id").select("id", "a", "b").collect()}
    assert got == {(1, "n1", "x"), (2, None, "y")}


def test_members_are_marked_before_a_join(spark, monkeypatch):
    """Rows that meet nothing went through the shuffles of every join all the same."""
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 600, 2)] + [("k0",), (None,), ("",)], "k string")
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(600)] + [("k0", -1), (None, -2), ("", -3)], "k string, x long")
    members = {*range(0, 600, 2), -1, -3}
    flags = {r["x"]: r["m"] for r in joins.mark_members(rows, keys, "k", "m").collect()}
    assert len(flags) == 603 and {x for x, m in flags.items() if m} == members and flags[-2] is False
    monkeypatch.setattr(joins, "MEMBER_BITS", 1024)
    kept = {r["x"] for r in joins.possible_members(rows, keys, "k").collect()}
    assert members <= kept and len(kept) < 500 and -2 not in kept
    assert joins.possible_members(rows, keys.limit(0), "k").isEmpty()
