from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest

from tallyline.operators import checks

NAN, INF = float("nan"), float("inf")
NOON = datetime(2024, 1, 1, 12)


def passed(check, df) -> bool:
    (row,) = checks.run_checks(df, [check]).collect()
    return row.passed


def one_column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"a {kind}")


@pytest.mark.parametrize(
    ("values", "kind", "expected"),
    [
        ([0, 1], "int", True),
        ([0, 1, None], "int", False),
        ([], "int", True),
        ([0, 2], "int", False),
        ([None], "int", False),
        ([NAN], "double", False),
        ([True, False], "boolean", True),
        ([True, None], "boolean", False),
        (["0", "1"], "string", False),
        (["abc"], "string", False),
        ([0.0, 1.0], "double", True),
        ([Decimal("1.00"), Decimal("0")], "decimal(5,2)", True),
        ([Decimal("0.50")], "decimal(5,2)", False),
    ],
)
def test_binary(spark, values, kind, expected):
    df = one_column(spark, values, kind)
    assert passed(checks.binary(df, "a"), df) is expected


@pytest.mark.parametrize(
    ("values", "kind", "number", "point_in_time"),
    [
        ([1], "int", True, False),
        ([1.5], "double", True, False),
        ([Decimal("1.5")], "decimal(5,2)", True, False),
        ([True], "boolean", True, False),
        (["1"], "string", False, False),
        ([NOON], "timestamp", False, True),
        ([NOON], "timestamp_ntz", False, True),
        ([date(2024, 1, 1)], "date", False, False),
        ([], "int", True, False),
    ],
)
def test_declared_types(spark, values, kind, number, point_in_time):
    df = one_column(spark, values, kind)
    assert passed(checks.numerical(df, "a"), df) is number
    assert passed(checks.timestamp(df, "a"), df) is point_in_time


def test_values_that_read_as_numbers_or_times(spark):
    df = spark.createDataFrame(
        [("1.5", "2024-01-01 10:00:00", "x"), (None, None, None), ("-3e2", "2024-02-30", "1")], "n string, t string, m string"
    )
    rows = checks.run_checks(
        df,
        [
            checks.numerical(df, "n", by_values=True),
            checks.timestamp(df, "t", by_values=True),
            checks.numerical(df, "m", by_values=True),
            checks.numerical(df, "m"),
        ],
    ).collect()
    assert [(r.passed, r.bad_rows) for r in rows] == [(True, 0), (False, 1), (False, 1), (False, 1)]


def test_mandatory_status(spark):
    df = spark.createDataFrame([(None, 1.0, ""), ("x", NAN, "")], "a string, b double, c string")
    rows = checks.mandatory_status(df).collect()
    assert [(r.column, r.has_null, r.null_rows) for r in rows] == [("a", True, 1), ("b", True, 1), ("c", False, 0)]
    assert not passed(checks.mandatory(df), df)
    assert passed(checks.mandatory(df, ["c"]), df)


def test_an_empty_table_passes(spark):
    df = spark.createDataFrame([], "a int, b int")
    rows = checks.run_checks(
        df, [checks.binary(df, "a"), checks.mandatory(df), checks.greater_than(df, "a"), checks.greater_than(df, "a", "b")]
    ).collect()
    assert all(r.passed and r.bad_rows == 0 for r in rows)


@pytest.mark.parametrize(
    ("values", "kind", "expected"),
    [
        ([1, 2], "int", True),
        ([0], "int", False),
        ([1, None], "int", False),
        ([NAN], "double", False),
        ([INF], "double", True),
        ([Decimal("0.01")], "decimal(5,2)", True),
    ],
)
def test_greater_than_zero(spark, values, kind, expected):
    df = one_column(spark, values, kind)
    assert passed(checks.greater_than(df, "a"), df) is expected


def test_greater_than_column(spark):
    df = spark.createDataFrame([(2, 1, 5.0, NAN), (3, None, 6.0, 1.0)], "a int, b int, c double, d double")
    (ab, cd) = checks.run_checks(df, [checks.greater_than(df, "a", "b"), checks.greater_than(df, "c", "d")]).collect()
    assert (ab.passed, ab.bad_rows) == (False, 1)
    assert (cd.passed, cd.bad_rows) == (False, 1)


def test_comparing_different_kinds_is_refused(spark):
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    with pytest.raises(ValueError, match="'a'"):
        checks.greater_than(df, "a")
    with pytest.raises(ValueError, match="'b'"):
        checks.greater_than(df, "a", "b")


@pytest.mark.parametrize("check", [checks.binary, checks.numerical, checks.timestamp, checks.greater_than])
def test_unknown_columns_are_named(spark, check):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="'nope'"):
        check(df, "nope")
    with pytest.raises(ValueError, match="'nope', 'neither'"):
        checks.mandatory(df, ["a", "nope", "neither"])


def test_checks_of_a_table_share_one_aggregation(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    plan = checks.run_checks(df, [checks.binary(df, "a"), checks.greater_than(df, "b", "a"), checks.mandatory(df)])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 1
