"""Parameters of the trading report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReportSpec:
    """Report range, calendar range and rolling-window length; every range includes both ends."""

    # The ranges of the standard report.
    start: date = date(2020, 6, 1)
    end: date = date(2020, 9, 30)
    month_start: date = date(2020, 8, 1)
    month_end: date = date(2020, 8, 31)
    window_days: int = 7

    def __post_init__(self) -> None:
        if self.start > self.end:
            raise ValueError("the report range ends before it starts")
        if self.month_start > self.month_end:
            raise ValueError("the calendar range ends before it starts")
        if self.window_days < 1:
            raise ValueError("the rolling window needs at least one day")

    @property
    def n_days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def last_stale_day(self) -> date:
        """The newest close day that no rolling window of the report can reach."""
        return self.start - timedelta(days=self.window_days)

    @property
    def month_column(self) -> str:
        return f"sum_volume_{self.month_start:%Y_%m}"

    def first_day(self) -> Column:
        return F.lit(self.start)

    def last_day(self) -> Column:
        return F.lit(self.end)
