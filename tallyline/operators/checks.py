"""Row-level checks of a table.

A check counts the rows that break its rule; a table passes when there are none, so an empty table
passes. Several checks of one table share a single aggregation without a shuffle of rows. Type
checks pass by the declared type of the column, and count on top the values that do not fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import (
    is_binary,
    is_greater,
    is_missing,
    is_not_number,
    is_not_timestamp,
    is_numeric_type,
    is_timestamp_type,
    require_columns,
    type_of,
)


@dataclass(frozen=True)
class Check:
    """A named rule: the rows that break it, and optionally a verdict that does not depend on them."""

    name: str
    columns: tuple[str, ...]
    broken: Column
    by_type: bool | None = None


def binary(df: DataFrame, column: str) -> Check:
    """Only 0 and 1, and nothing missing."""
    require_columns(df, [column])
    return Check("binary", (column,), ~is_binary(df, column))


def numerical(df: DataFrame, column: str, by_values: bool = False) -> Check:
    """A numeric column; with ``by_values`` any column whose present values all read as numbers."""
    require_columns(df, [column])
    declared = None if by_values else is_numeric_type(type_of(df, column))
    return Check("numerical", (column,), is_not_number(df, column), declared)


def timestamp(df: DataFrame, column: str, by_values: bool = False) -> Check:
    """A timestamp column; with ``by_values`` any column whose present values all read as timestamps."""
    require_columns(df, [column])
    declared = None if by_values else is_timestamp_type(type_of(df, column))
    return Check("timestamp", (column,), is_not_timestamp(df, column), declared)


def mandatory(df: DataFrame, columns: Sequence[str] | None = None) -> Check:
    """Nothing missing in any of the columns, by default all of them."""
    names = df.columns if columns is None else list(columns)
    require_columns(df, names)
    broken = F.lit(False)
    for name in names:
        broken = broken | is_missing(df, name)
    return Check("mandatory", tuple(names), broken)


def greater_than(df: DataFrame, column: str, other: str | None = None) -> Check:
    """Strictly greater than another column, or than zero, on every row."""
    require_columns(df, [column] if other is None else [column, other])
    if other is None:
        return Check("greater than zero", (column,), ~is_greater(df, column))
    return Check("greater than", (column, other), ~is_greater(df, column, other))


def report_row(name: str, columns: Sequence[str], passed: Column, bad_rows: Column) -> Column:
    """A check result as a struct."""
    return F.struct(
        F.lit(name).alias("check"),
        F.lit(",".join(columns)).alias("columns"),
        passed.alias("passed"),
        bad_rows.cast("long").alias("bad_rows"),
    )


def verdict(totals: DataFrame, name: str, columns: Sequence[str], bad_rows: Column) -> DataFrame:
    """One check result from a one-row table of totals."""
    return totals.select(F.inline(F.array(report_row(name, columns, bad_rows == 0, bad_rows))))


def broken_counts(checks: Sequence[Check]) -> list[Column]:
    """Aggregates: how many rows break each check, as ``c0, c1, ..``."""
    return [F.count_if(check.broken).alias(f"c{i}") for i, check in enumerate(checks)]


def missing_counts(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Aggregates: how many rows have no value in each column, as ``m0, m1, ..``."""
    return [F.count_if(is_missing(df, name)).alias(f"m{i}") for i, name in enumerate(names)]


def missing_rows(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column, has_null, null_rows)`` for each column, from a row of ``missing_counts``."""
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            (F.col(f"m{i}") > 0).alias("has_null"),
            F.col(f"m{i}").alias("null_rows"),
        )
        for i, name in enumerate(names)
    ]
    return totals.select(F.inline(F.array(*rows)))


def result_of(check: Check, bad_rows: Column) -> Column:
    passed = bad_rows == 0 if check.by_type is None else F.lit(check.by_type)
    return report_row(check.name, check.columns, passed, bad_rows)


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Rows ``(check, columns, passed, bad_rows)``, from one pass over the table."""
    results = [result_of(check, F.col(f"c{i}")) for i, check in enumerate(checks)]
    return df.agg(*broken_counts(checks)).select(F.inline(F.array(*results)))


def mandatory_status(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column, whether and how often it has a missing value: ``(column, has_null, null_rows)``."""
    names = mandatory(df, columns).columns
    return missing_rows(df.agg(*missing_counts(df, names)), names)
