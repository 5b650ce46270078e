from __future__ import annotations

import pytest

from tallyline.operators.foreign_keys import check_foreign_key, foreign_key_mismatches

KEYS = "a string, b int"


def mismatches(spark, child, parent):
    rows = foreign_key_mismatches(
        spark.createDataFrame(child, KEYS), ["a", "b"], spark.createDataFrame(parent, KEYS), ["a", "b"]
    ).collect()
    return sorted(map(tuple, rows))


def test_null_equals_null(spark):
    assert mismatches(spark, [("a", None)], [("a", None)]) == []


def test_mismatches_are_distinct(spark):
    assert mismatches(spark, [("x", 1), ("x", 1), ("a", 1)], [("a", 1), ("b", 1)]) == [("x", 1)]


def test_an_empty_child_passes(spark):
    row = check_foreign_key(
        spark.createDataFrame([], KEYS), ["a"], spark.createDataFrame([("a", 1)], KEYS), ["a"]
    ).collect()[0]
    assert (row.passed, row.bad_rows) == (True, 0)


def test_numbers_of_different_types_compare(spark):
    child = spark.createDataFrame([(1,), (2,)], "k int")
    parent = spark.createDataFrame([(1.0,)], "k double")
    assert [r.k for r in foreign_key_mismatches(child, ["k"], parent, ["k"]).collect()] == [2]


def test_refusals(spark):
    df = spark.createDataFrame([("a", 1)], KEYS)
    for fk, pk in ((["a", "b"], ["a"]), (["a"], ["b"]), (["nope"], ["a"]), (["a"], ["nope"]), ([], [])):
        with pytest.raises(ValueError):
            foreign_key_mismatches(df, fk, df, pk)
