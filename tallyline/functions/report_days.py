"""Which report days a trade counts on.

Each function maps a trade's close day to the array of report days that see the trade, or null
when there is none. Exploding the array gives the pairs of a date range join without comparing
every day with every trade.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.spec import ReportSpec


def close_day(column: str = "close_time") -> Column:
    return F.col(column).cast("date")


def days_between(first: Column, last: Column) -> Column:
    """Every day of the closed range, or null when the range is empty."""
    return F.when(first <= last, F.sequence(first, last))


def report_days(spec: ReportSpec) -> Column:
    return days_between(spec.first_day(), spec.last_day())


def rolling_days(day: Column, spec: ReportSpec) -> Column:
    """Report days whose rolling window holds ``day``: itself and the ``window_days - 1`` after it."""
    return days_between(
        F.greatest(day, spec.first_day()),
        F.least(F.date_add(day, spec.window_days - 1), spec.last_day()),
    )


def cumulative_days(day: Column, spec: ReportSpec) -> Column:
    """Report days on which ``day`` is past or present."""
    return days_between(F.greatest(day, spec.first_day()), spec.last_day())


def in_month(day: Column, spec: ReportSpec) -> Column:
    return day.between(F.lit(spec.month_start), F.lit(spec.month_end))


def calendar_days(day: Column, spec: ReportSpec) -> Column:
    """As ``cumulative_days``, for close days inside the calendar range only."""
    return F.when(in_month(day, spec), cumulative_days(day, spec))
