from __future__ import annotations

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyline.operators import duplicates
from tallyline.operators.duplicates import drop_duplicates, duplicate_count, duplicate_counts, flag_duplicates

ROWS = [(None, 1)] * 2 + [("a", 2)] * 3 + [("b", 3)]


@pytest.fixture(params=["whole", "in pieces"])
def suspects(request, monkeypatch):
    """Copies spelled out at once, and two at a time."""
    if request.param == "in pieces":
        monkeypatch.setattr(duplicates, "PIECE", 2)


def count(df, **arguments) -> int:
    return duplicate_count(df, **arguments).collect()[0].duplicates


def test_counts(spark, suspects):
    df = spark.createDataFrame(ROWS, "a string, b int")
    assert count(df) == 3
    assert count(df, subset=["a"], keep="last") == 3
    assert count(df, subset=["b"], keep=False) == 5


def test_counts_of_nested_keys(spark, suspects):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 1, 2), ("b", 1, 1)], "a string, b int, c int")
    row = duplicate_counts(df, [None, ["a", "b"], ["b"]]).collect()[0]
    assert (row.n0, row.n1, row.n2) == (1, 2, 3)
    with pytest.raises(ValueError):
        duplicate_counts(df, [["a"], ["b"]])


def test_zero_has_no_sign(spark, suspects):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert count(df) == 1


def test_empty_table(spark, suspects):
    df = spark.createDataFrame([], "a int")
    assert count(df) == 0
    assert flag_duplicates(df).collect() == []


@pytest.mark.parametrize(("keep", "flagged"), [("first", 3), ("last", 3), (False, 5)])
def test_whole_row_flags(spark, suspects, keep, flagged):
    rows = flag_duplicates(spark.createDataFrame(ROWS, "a string, b int"), keep=keep).collect()
    assert Counter((r.a, r.b) for r in rows) == Counter(ROWS)
    assert sum(r.is_duplicate for r in rows) == flagged


@pytest.mark.parametrize(
    ("keep", "kept"),
    [("first", [(None, None, "x"), ("k", 1, "q"), ("u", 9, "z")]), ("last", [(None, 5, "y"), ("k", 3, "p"), ("u", 9, "z")]), (False, [("u", 9, "z")])],
)
def test_keeping_by_order(spark, suspects, keep, kept):
    df = spark.createDataFrame(
        [("k", 3, "p"), ("k", 1, "q"), ("k", 1, "r"), ("k", 3, "p"), (None, 5, "y"), (None, None, "x"), ("u", 9, "z")],
        "key string, at int, rest string",
    )
    rows = drop_duplicates(df, ["key"], keep, order_by=["at"]).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(kept, key=str)


def test_bad_arguments(spark):
    df = spark.createDataFrame(ROWS, "a string, b int")
    for call in (
        lambda: flag_duplicates(df, subset=[]),
        lambda: flag_duplicates(df, subset=["nope"], order_by=["b"]),
        lambda: flag_duplicates(df, subset=["a"]),
        lambda: flag_duplicates(df, keep="middle"),
        lambda: duplicate_count(df, keep=True),
    ):
        with pytest.raises(ValueError):
            call()


def test_a_hot_group_of_copies_is_counted_before_the_shuffle(spark):
    df = spark.range(0, 200_000, numPartitions=8).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id as string)) as key", "if(id % 3 = 0, 0, id) as value"
    )
    hot = (200_000 + 2) // 3
    assert count(df) == hot - 1
    kept = drop_duplicates(df, ["key"], order_by=["value"])
    assert kept.count() == 200_000 - (hot - 1)
    assert kept.filter("key = 'hot'").count() == 1


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_random_tables_against_pandas(spark, keep):
    rng = random.Random(11)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2]), n) for n in range(40)]
    rows += rng.sample(rows, 10)
    df = spark.createDataFrame(rows, "a string, b int, at int")
    # Pandas keeps by arrival, so it is given the rows in the order that order_by names.
    frame = pd.DataFrame(sorted(rows, key=lambda row: row[2]), columns=["a", "b", "at"], dtype=object)
    flags = frame.duplicated(["a", "b"], keep=keep)
    assert count(df, subset=["a", "b"], keep=keep) == flags.sum()
    expected = Counter(zip(frame["a"], frame["b"], frame["at"], flags))
    actual = flag_duplicates(df, ["a", "b"], keep, order_by=["at"]).collect()
    assert Counter(map(tuple, actual)) == expected


def test_many_equal_rows_are_dropped_without_being_spelled_out(spark):
    rows = spark.range(0, 60_000_000, 1, 8).select(F.lit("a").alias("k"), F.lit(1).alias("v"))
    assert duplicates.drop_duplicates(rows).collect() == [("a", 1)]
    assert duplicates.drop_duplicates(rows, ["k"], "last", ["v"]).collect() == [("a", 1)]
    assert duplicates.drop_duplicates(rows, keep=False).collect() == []


def test_flagged_copies_leave_in_several_tasks(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select(F.lit("a").alias("k"))
    flagged = duplicates.flag_duplicates(rows)
    sizes = [r["count"] for r in flagged.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_000_000 and len(sizes) > 1
    assert flagged.filter(~F.col("is_duplicate")).count() == 1


def test_rows_keep_the_order_in_which_they_arrived(spark, tmp_path):
    """Three deliveries, one file each; rows of a file in their order, and none of the values tells the order."""
    deliveries = [[("a", 5), ("b", 9), ("a", 1)], [("c", 3), ("a", 7), ("a", 7)], [("b", 2), ("b", 9), (None, 4), (None, 3)]]
    for i, rows in enumerate(deliveries):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.parquet(str(tmp_path / f"day={i}"))
    df = spark.read.option("basePath", str(tmp_path)).parquet(str(tmp_path / "day=*"))

    def kept(keep):
        rows = duplicates.drop_duplicates(df, ["k"], keep)
        assert rows.columns == ["k", "v", "day"]
        return sorted((r.k or "", r.v, r.day) for r in rows.collect())

    assert kept("first") == [("", 4, 2), ("a", 5, 0), ("b", 9, 0), ("c", 3, 1)]
    assert kept("last") == [("", 3, 2), ("a", 7, 1), ("b", 9, 2), ("c", 3, 1)]
    flagged = duplicates.flag_duplicates(df, ["k"], "first")
    assert flagged.columns == ["k", "v", "day", "is_duplicate"]
    assert sorted((r.k or "", r.v) for r in flagged.filter("not is_duplicate").collect()) == [("", 4), ("a", 5), ("b", 9), ("c", 3)]
    assert flagged.count() == 10
    with pytest.raises(ValueError):
        duplicates.drop_duplicates(df.groupBy("k", "v").count(), ["k"], "first")


def test_few_copies_are_spelled_out_without_a_shuffle_of_their_own(spark):
    df = spark.createDataFrame([(i // 2, i) for i in range(50)], "k int, v int")
    flagged = duplicates.flag_duplicates(df, ["k"], "first", ["v"])
    flagged.collect()
    text = flagged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in text
    assert flagged.filter("is_duplicate").count() == 25


@pytest.fixture(params=["few", "by bitmap", "by bitmap, some hot", "hot"])
def sorted_out(request, monkeypatch):
    """Every way in which suspects are sorted out, at test size."""
    if "bitmap" in request.param:
        monkeypatch.setattr(duplicates, "FEW_HASHES", 0)
        monkeypatch.setattr(duplicates, "MOST_BITS", 64)
    if "hot" in request.param:
        monkeypatch.setattr(duplicates, "HOT", 1 if request.param == "hot" else 4)


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_every_way_of_sorting_out_gives_the_same_rows(spark, sorted_out, keep):
    rng = random.Random(5)
    rows = [(rng.choice([None, *"abcdefghijklmnop"]), rng.randrange(6), rng.choice([None, 1, 2, 3])) for _ in range(120)]
    rows += [(f"u{i}", i, i) for i in range(60)] + rng.sample(rows, 20)
    df = spark.createDataFrame(rows, "k string, b int, at int")
    frame = pd.DataFrame(sorted(rows, key=lambda row: (row[2] is not None, row[2] or 0, row[1])), columns=["k", "b", "at"], dtype=object)
    flags = frame.duplicated(["k", "b"] if keep is False else ["k"], keep=keep)
    keys = ["k", "b"] if keep is False else ["k"]
    expected = Counter(zip(frame["k"], frame["b"], frame["at"], flags))
    assert Counter(map(tuple, flag_duplicates(df, keys, keep, order_by=["at"]).collect())) == expected
    kept = Counter(row[:3] for row in expected.elements() if not row[3])
    assert Counter(map(tuple, drop_duplicates(df, keys, keep, order_by=["at"]).collect())) == kept
    row = duplicate_counts(df, [None, keys], keep).first()
    assert (row.n0, row.n1) == (frame.duplicated(keep=keep).sum(), flags.sum())


def test_rows_are_shuffled_once_and_by_key(spark, monkeypatch):
    """Many suspects: the rows of a key meet in one shuffle, and rows that the bitmap settles in none."""
    monkeypatch.setattr(duplicates, "FEW_HASHES", 0)
    df = spark.range(0, 3000).select((F.col("id") % 2000).alias("k"), F.col("id").alias("v"))
    for keep in ("first", "last", False):
        text = flag_duplicates(df, ["k"], keep, ["v"])._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1
        text = drop_duplicates(df, ["k"], keep, ["v"])._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1
    text = duplicate_counts(df, [None, ["k"]])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
