"""Window joins against every pair of a point and a window."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyline.operators.intervals import instants, window_join
from tallyline.sources.staging import stage
from tests.test_plans import executed_plan, plan, skew_sensitive  # noqa: F401

HOUR = timedelta(hours=1)


def tables(seed: int, around: datetime, spread: timedelta):
    rng = random.Random(seed)

    def moment():
        return rng.choice([None, *[around + timedelta(microseconds=rng.randint(0, spread // timedelta(microseconds=1)))] * 15])

    points = [(i, rng.choice(["a", "b", None]), moment()) for i in range(150)]
    windows = [(i, rng.choice(["a", "b", None]), moment()) for i in range(60)]
    points += [(1000 + i, k, end) for i, k, end in windows]
    return points, windows


def brute_force(points, windows, width, on, whole_days=False):
    def cut(t):
        return datetime.combine(t.date(), datetime.min.time()) if whole_days else t

    return sorted(
        (p, w)
        for p, k, at in points
        for w, j, end in windows
        if at is not None and end is not None and cut(end) - width < cut(at) <= cut(end) and (not on or (k == j and k is not None))
    )


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize(
    ("width", "on", "whole_days"),
    [(HOUR, [], False), (36 * HOUR, ["k"], False), (timedelta(days=400), ["k"], False), (timedelta(microseconds=7), [], False), (timedelta(days=2), [], True)],
)
def test_against_every_pair(spark, kind, width, on, whole_days):
    points, windows = tables(3, datetime(1969, 12, 29, 5), timedelta(days=6))
    p = spark.createDataFrame(points, f"p int, k string, at {kind}")
    w = spark.createDataFrame(windows, f"w int, k string, until {kind}")
    w = w if on else w.withColumnRenamed("k", "j")
    found = window_join(p, w, "at", "until", width, on, whole_days)
    assert found.columns == ["p", "k", "at", "w", *([] if on else ["j"]), "until"]
    assert sorted((r.p, r.w) for r in found.collect()) == brute_force(points, windows, width, on, whole_days)


def test_days_are_windows_of_times(spark):
    points = spark.createDataFrame([(1, datetime(2024, 1, 1, 23, 59)), (2, datetime(2024, 1, 2, 0, 0))], "p int, at timestamp_ntz")
    days = spark.createDataFrame([(date(2024, 1, 2),), (date(2024, 1, 3),)], "d date")
    found = {(r.p, r.d.day) for r in window_join(points, days, "at", "d", timedelta(days=1), whole_days=True).collect()}
    assert found == {(2, 2)}
    found = {(r.p, r.d.day) for r in window_join(points, days, "at", "d", timedelta(days=1)).collect()}
    assert found == {(1, 2), (2, 2)}


def test_refusals(spark):
    points = spark.createDataFrame([(1, datetime(2024, 1, 1))], "p int, at timestamp")
    for windows, width, days in (
        ("w int, until timestamp_ntz", HOUR, False),
        ("p int, until timestamp", HOUR, False),
        ("w int, until timestamp", timedelta(0), False),
        ("w int, until timestamp", HOUR, True),
        ("w int, until string", HOUR, False),
    ):
        with pytest.raises(ValueError):
            window_join(points, spark.createDataFrame([], windows), "at", "until", width, whole_days=days)
    with pytest.raises(ValueError):
        instants(points, datetime(2024, 1, 1), datetime(2024, 1, 2), timedelta(0))
    assert instants(points, datetime(2024, 1, 2), datetime(2024, 1, 1), HOUR).count() == 0


def test_a_long_window_repeats_no_point(spark):
    """Points stay one row each up to the join, windows are two."""
    points = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("at"))
    windows = instants(spark.range(1), datetime(1970, 1, 1), datetime(1970, 2, 1), timedelta(days=1)).drop("id")
    text = plan(window_join(points, windows, "at", "instant", timedelta(days=365)))
    assert text.count("Generate explode(array(") == 1 and "NestedLoop" not in text and "CartesianProduct" not in text
    assert "HashJoin" in text or "SortMergeJoin" in text


def test_a_hot_account_is_split(spark, skew_sensitive):  # noqa: F811
    number = F.col("id")
    points = stage(
        spark.range(0, 120_000, numPartitions=16).select(
            F.when(number % 3 == 0, "hot").otherwise((number % 977).cast("string")).alias("k"),
            F.md5(number.cast("string")).alias("p"),
            F.timestamp_seconds(number % 3600).alias("at"),
        ),
        "points",
    )
    windows = stage(points.select("k").distinct().select("k", F.timestamp_seconds(F.lit(3600)).alias("until")), "windows")
    joined = window_join(points, windows, "at", "until", 2 * HOUR, ["k"])
    assert "SortMergeJoin(skew=true)" in executed_plan(joined)
    assert joined.count() == 120_000
