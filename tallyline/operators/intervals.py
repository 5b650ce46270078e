"""Joining points in time to the windows that hold them, by buckets.

Time is cut into buckets as long as the longest window. A point lies in one bucket and a window in two at most, so an equi-join of the
buckets meets every pair, and the exact condition is checked inside. Neither side is repeated more than twice,
however long the windows are, and bounds are as exact as the times, not whole days.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.columns import TIMESTAMP_TYPES, require_columns, type_of

BUCKET, AT, UNTIL = "bucket__", "at__", "until__"


def _micros(df: DataFrame, column: str, whole_days: bool) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a zone, or of the midnight a date begins with."""
    kind, time = type_of(df, column), F.col(column)
    if not isinstance(kind, (T.DateType, *TIMESTAMP_TYPES)):
        raise ValueError(f"column {column!r} holds no times")
    if isinstance(kind, T.TimestampType) and not whole_days:
        return F.unix_micros(time)
    if whole_days:
        time = time.cast("date")
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), time.cast("timestamp_ntz"))


def _bucket(micros: Column, size: Column) -> Column:
    """The number of the bucket, rounded down also before 1970."""
    return ((micros - F.pmod(micros, size)) / size).cast("bigint")


def instants(grid: DataFrame, first: datetime, last: datetime, step: timedelta, name: str = "instant") -> DataFrame:
    """The times from ``first`` to ``last`` in equal steps, both ends included, for every row of ``grid``."""
    if step <= timedelta(0):
        raise ValueError("the step must be longer than nothing")
    bounds = [F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz") for moment in (first, last)]
    times = F.when(bounds[0] <= bounds[1], F.sequence(*bounds, F.lit(step)))
    return grid.select("*", F.explode(times).alias(name))


def window_join(
    points: DataFrame,
    windows: DataFrame,
    point: str,
    end: str,
    width: timedelta,
    on: Sequence[str] = (),
    whole_days: bool = False,
) -> DataFrame:
    """Every pair of a point and a window that holds it, with the columns of both: ``end - width < point <= end``.

    ``on`` names columns that must be equal as well; a null matches nothing, neither there nor as a time. Both tables may have only these columns in common.
    With ``whole_days`` times count by the day they lie in, so that a window of n days is that day and the n - 1 before.
    The windows are on the side that is doubled, so let them be the smaller one. Spark broadcasts them while they are
    small, and else splits the points of a bucket that holds very many.
    """
    if width <= timedelta(0):
        raise ValueError("a window must be longer than nothing")
    if whole_days and width % timedelta(days=1):
        raise ValueError("a window of whole days is some days long")
    require_columns(points, [point, *on], "table of points")
    require_columns(windows, [end, *on], "table of windows")
    shared = sorted(set(points.columns) & set(windows.columns) - set(on))
    if shared:
        raise ValueError(f"both tables have columns {', '.join(shared)}")
    zoned = [isinstance(type_of(df, column), T.TimestampType) for df, column in ((points, point), (windows, end))]
    timed = [isinstance(type_of(df, column), TIMESTAMP_TYPES) for df, column in ((points, point), (windows, end))]
    if all(timed) and zoned[0] != zoned[1]:
        raise ValueError("one of the times has a zone, the other has none")
    at, until = _micros(points, point, whole_days), _micros(windows, end, whole_days)
    size = F.lit(width // timedelta(microseconds=1)).cast("bigint")
    of_points = points.withColumn(AT, at).withColumn(BUCKET, _bucket(F.col(AT), size))
    last = _bucket(F.col(UNTIL), size)
    of_windows = windows.withColumn(UNTIL, until).withColumn(BUCKET, F.explode(F.array(last - 1, last)))
    inside = (F.col(AT) <= F.col(UNTIL)) & (F.col(AT) > F.col(UNTIL) - size)
    joined = of_points.join(of_windows, [*on, BUCKET]).filter(inside)
    return joined.select(*points.columns, *[name for name in windows.columns if name not in on])
