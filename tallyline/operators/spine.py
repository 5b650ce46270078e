"""The report days, and joining them to trades and keys.

Days are attached by exploding an array of dates on each row. There is no join, so nothing is
compared pairwise and no side has to be broadcast. Measures meet the keys as timelines, one row per key, and
are spelled out together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.report_days import close_day, days_between, report_days
from tallyline.operators.accounts import ACCOUNT, account_currencies, closed_trades, valid_trades
from tallyline.operators.intervals import window_join
from tallyline.sources.staging import stage
from tallyline.spec import ReportSpec

KEY = [*ACCOUNT, "symbol"]


def date_series(first_and_last: DataFrame) -> DataFrame:
    """One row ``dt_report`` per day between the two dates of each given row, both included."""
    first, last = (F.col(name) for name in first_and_last.columns)
    return first_and_last.select(F.explode(days_between(first, last)).alias("dt_report"))


def close_day_series(trades: DataFrame) -> DataFrame:
    """Every day from the first to the last close day of the trades, gaps included."""
    day = close_day()
    return date_series(trades.agg(F.min(day).alias("first"), F.max(day).alias("last")))


def on_days(rows: DataFrame, days: Column) -> DataFrame:
    """Repeat each row for each of its days, as ``dt_report``."""
    return rows.select(F.explode(days).alias("dt_report"), "*")


def combined_data(joined_trades: DataFrame, spec: ReportSpec) -> DataFrame:
    """Every trade on every report day."""
    return on_days(joined_trades, report_days(spec))


def daily_digests(joined_trades: DataFrame, by: Sequence[str], measures: Mapping[str, Column], spec: ReportSpec) -> DataFrame:
    """What the trades seen on each report day add up to, by ``by``: every trade from its close day on, and never a pair of a day and a trade.

    ``measures`` are aggregates by name: least values are named ``first_..``, greatest ones ``last_..``, all others are sums or counts. The trades are summed per close day first, the days before the report as one;
    running over a key's days the same measures of these sums give its state after each, which holds until its next day.
    """
    seen_from = F.greatest(close_day(), spec.first_day()).alias("from_day")
    daily = joined_trades.filter(close_day() <= spec.last_day()).groupBy(*by, seen_from).agg(*[m.alias(name) for name, m in measures.items()])
    per_key = Window.partitionBy(*by).orderBy("from_day")
    so_far = per_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_day = F.coalesce(F.date_sub(F.lead("from_day").over(per_key), 1), spec.last_day()).alias("to_day")
    again = {name: F.min if name.startswith("first_") else F.max if name.startswith("last_") else F.sum for name in measures}
    states = daily.select(*by, "from_day", to_day, *[again[name](name).over(so_far).alias(name) for name in measures])
    return states.select(F.explode(F.sequence("from_day", "to_day")).alias("dt_report"), *by, *measures)


def key_currencies(trades: DataFrame, users: DataFrame) -> DataFrame:
    """The distinct (login, server, symbol, currency) that have a valid trade."""
    keys = closed_trades(valid_trades(trades)).select(*KEY).distinct()
    return keys.join(account_currencies(users), ACCOUNT).select(*KEY, "currency")


def report_grid(trades: DataFrame, users: DataFrame, spec: ReportSpec) -> DataFrame:
    """Every report day for every (login, server, symbol, currency) with a valid trade."""
    return on_days(key_currencies(trades, users), report_days(spec))


def range_join(joined_trades: DataFrame, spec: ReportSpec) -> DataFrame:
    """Pairs of report day and trade where the trade closed in the rolling window of the day.

    A trade meets the days of its two buckets at most, whatever the length of the window (``operators.intervals``).
    """
    spine = joined_trades.sparkSession.range(1).select(F.explode(report_days(spec)).alias("dt_report"))
    width = timedelta(days=spec.window_days)
    return window_join(joined_trades, spine, "close_time", "dt_report", width, whole_days=True).select("dt_report", *joined_trades.columns)


def attach(grid: DataFrame, measure: DataFrame, keys: list[str]) -> DataFrame:
    """Left outer join of a measure to the grid. A null key matches nothing.

    The measure is written first. Read back it has no partitioning of its own, so both sides are
    shuffled for the join, which lets Spark split the grid rows of a key that has very many.
    """
    return grid.join(stage(measure, "measure"), keys, "left")


def aligned(measures: Mapping[str, DataFrame], on: Sequence[str], spec: ReportSpec) -> DataFrame:
    """Several measures on one timeline: a row per key with ``stretches`` of days over which none of them changes.

    Each measure has the columns ``on``, ``from_day``, ``to_day`` and one named as it is, and at most one value of a key on a day.
    The timelines of a key are cut at the union of their change points, between which every measure holds the value it last began
    with, or null after its end. Days outside the report are cut off. A null in ``on`` is no key. All measures are shuffled once, by key.
    """
    first, end = spec.first_day(), spec.last_day()

    def changes(name: str, measure: DataFrame) -> DataFrame:
        begins = F.struct(F.greatest("from_day", first).alias("day"), F.struct(F.lit(True).alias("begins"), F.col(name).alias("value")).alias(name))
        ends = F.struct(
            F.date_add("to_day", 1).alias("day"),
            F.struct(F.lit(False).alias("begins"), F.lit(None).cast(measure.schema[name].dataType).alias("value")).alias(name),
        )
        inside = measure.filter((F.col("from_day") <= F.col("to_day")) & (F.col("to_day") >= first) & (F.col("from_day") <= end))
        return inside.dropna(subset=list(on)).select(*on, F.inline(F.array(begins, ends))).filter(F.col("day") <= end)

    points = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [changes(name, df) for name, df in measures.items()])
    # A stretch that begins on the day after another's end begins: true is the larger.
    per_day = points.repartition(*on).groupBy(*on, "day").agg(*[F.max(name).alias(name) for name in measures])
    per_key = Window.partitionBy(*on).orderBy("day")
    so_far = per_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = per_day.select(
        *on,
        F.col("day").alias("from_day"),
        F.coalesce(F.date_sub(F.lead("day").over(per_key), 1), end).alias("to_day"),
        *[F.last(name, ignorenulls=True).over(so_far).getField("value").alias(name) for name in measures],
    )
    return held.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("from_day", "to_day", *measures))).alias("stretches"))


def aligned_grid(keys: DataFrame, measures: Mapping[str, DataFrame], on: Sequence[str], spec: ReportSpec) -> DataFrame:
    """Every report day of every row of ``keys``, with the measures on that day, null where there are none.

    A left outer join of all measures at once: the keys meet the aligned timeline of their measures, one compact row, and only then are the days
    spelled out. The timelines are written, so that Spark may split the shuffled keys of one timeline that very many share.
    """
    timeline = stage(aligned(measures, on, spec), "aligned")
    whole = timeline.schema["stretches"].dataType
    joined = keys.join(timeline, list(on), "left")
    # Before its first change and without a timeline a key has no measure.
    opening = F.struct(
        spec.first_day().alias("from_day"),
        F.coalesce(F.date_sub(F.get("stretches", F.lit(0))["from_day"], 1), spec.last_day()).alias("to_day"),
        *[F.lit(None).cast(whole.elementType[name].dataType).alias(name) for name in measures],
    )
    covered = F.concat(F.array(opening), F.coalesce("stretches", F.array().cast(whole)))
    rows = joined.select(*keys.columns, F.inline(covered)).filter(F.col("from_day") <= F.col("to_day"))
    return rows.select(F.explode(F.sequence("from_day", "to_day")).alias("dt_report"), *keys.columns, *measures)


def daily_grid(keys: DataFrame, values: DataFrame, on: Sequence[str], column: str, name: str, spec: ReportSpec) -> DataFrame:
    """Every report day of every row of ``keys`` with the day's entry of the array ``column`` as ``name``; 0 where there is none.

    ``values`` must be a written table of one row per ``on``, such as ``ranking.rank_arrays`` makes. A null in ``on`` matches nothing.
    """
    joined = keys.join(values.select(*on, column), list(on), "left")
    entry = F.coalesce(F.get(column, F.datediff("dt_report", spec.first_day())), F.lit(0))
    return on_days(joined, report_days(spec)).select("dt_report", *keys.columns, entry.alias(name))
