"""Rolling, cumulative and calendar measures per (login, server, symbol).

A measure only changes on a day when a trade closes or leaves the rolling window. So the measures
are kept as *timelines*: per key, the stretches of report days over which nothing changes. Trades
are summed per close day first, running sums over the change points of a key follow, and the dense
day-by-day rows come last, by exploding the stretches. Only the sparse rows are shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.columns import require_columns, type_of
from tallyline.functions.exact_sums import merge, part_names, split
from tallyline.functions.report_days import close_day, in_month
from tallyline.operators.accounts import ACCOUNT, closed_trades, distinct_users, enabled_users, valid_trades
from tallyline.operators.spine import KEY
from tallyline.sources.staging import stage
from tallyline.spec import ReportSpec

def volume_or_zero(trades: DataFrame) -> Column:
    """Volume with null as 0: whole numbers as decimals, decimals as they are, floating point as doubles."""
    volume, data_type = F.col("volume"), type_of(trades, "volume")
    if isinstance(data_type, T.DecimalType):
        return F.coalesce(volume, F.lit(0).cast(data_type))
    if isinstance(data_type, T.IntegralType):
        return F.coalesce(volume, F.lit(0)).cast("decimal(20,0)")
    if isinstance(data_type, T.FractionalType):
        return F.coalesce(volume, F.lit(0.0)).cast("double")
    raise ValueError("column 'volume' holds no numbers")


def daily_activity(trades: DataFrame, users: DataFrame, spec: ReportSpec) -> DataFrame:
    """Valid trades of enabled accounts, summed per key and close day.

    Floating-point volumes are summed in parts (``functions.exact_sums``), so that no sum depends on the order of the trades.
    The sum comes before the join, so that neither a busy account nor a busy symbol reaches the
    shuffle as single trades. Close days that no window reaches fall together in one day before it,
    and those after the report in one day after it: a key has at most one row per day of the report
    plus a window's length. Trades of an account with several user rows count that many times.
    """
    require_columns(trades, [*KEY, "open_time", "close_time", "volume"], "trades table")
    require_columns(users, [*ACCOUNT, "currency", "enable"], "users table")
    valid = closed_trades(valid_trades(trades))
    valid = valid.withColumn("volume", volume_or_zero(valid))
    closed_on = close_day()
    day = F.least(
        F.greatest(closed_on, F.lit(spec.last_stale_day)),
        F.date_add(spec.last_day(), 1),
    )
    month = in_month(closed_on, spec)
    rows = valid.select(*KEY, day.alias("day"), *split(valid, "volume"), month.alias("in_month"), "close_time")
    parts = part_names(rows.columns, "volume")
    daily = rows.groupBy(*KEY, "day").agg(
        *[F.sum(name).alias(name) for name in parts],
        F.count("*").alias("trades"),
        *[
            F.sum(F.when(F.col("in_month"), F.col(name)).otherwise(F.lit(0).cast(type_of(rows, name)))).alias(f"month_{name}")
            for name in parts
        ],
        F.count_if("in_month").alias("month_trades"),
        F.min("close_time").alias("first_trade"),
    )
    # A daily row joins each user row of its account. The sums that follow add it as often, without a
    # product that would need more digits than its factors.
    accounts = stage(distinct_users(enabled_users(users)).select(*ACCOUNT), "accounts")
    return daily.join(accounts, ACCOUNT)


def change_points(activity: DataFrame, spec: ReportSpec) -> DataFrame:
    """The days on which the measures of a key change, with the amounts that enter on them.

    An activity row enters on its close day, or on the first report day if no window reaches it. It
    leaves the rolling window ``window_days`` after its close day; that point adds nothing.
    """
    start, end = spec.first_day(), spec.last_day()
    in_report = F.col("day") <= end
    in_some_window = in_report & (F.col("day") > F.lit(spec.last_stale_day))
    volumes, months = (part_names(activity.columns, name) for name in ("volume", "month_volume"))
    # What a point adds, from which column, and when.
    adds = (
        [(f"window_{name}", name, in_some_window) for name in [*volumes, "trades"]]
        + [(f"total_{name}", name, in_report) for name in [*volumes, "trades"]]
        + [(name, name, in_report) for name in [*months, "month_trades", "first_trade"]]
    )

    def nothing(name: str) -> Column:
        return F.lit(None if name == "first_trade" else 0).cast(type_of(activity, name))

    enters = F.struct(
        F.when(in_some_window, F.col("day")).otherwise(start).alias("day"),
        *[F.when(condition, F.col(source)).otherwise(nothing(source)).alias(name) for name, source, condition in adds],
    )
    leaves = F.struct(
        F.when(in_some_window, F.date_add("day", spec.window_days)).alias("day"),
        *[nothing(source).alias(name) for name, source, _ in adds],
    )
    return activity.select(*KEY, F.inline(F.array(enters, leaves))).filter(F.col("day") <= end)


def timelines(activity: DataFrame, spec: ReportSpec) -> DataFrame:
    """One row per key with its ``stretches``: days ``from_day`` to ``to_day`` and their measures.

    The stretches of a key cover the whole report range, so there are never more of them than days.
    """
    per_key = Window.partitionBy(*KEY).orderBy(F.unix_date("day"))
    so_far = per_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The days of the window are added up anew for every point: a decimal's digits would have to grow for a difference.
    in_window = per_key.rangeBetween(1 - spec.window_days, 0)
    # Partitioned before each row becomes two. Being explicit, this also leaves the account join free
    # to split an account that holds many keys.
    changes = change_points(activity.repartition(*KEY), spec)
    window_volume, total_volume, month_volume = (
        part_names(changes.columns, name) for name in ("window_volume", "total_volume", "month_volume")
    )
    rolling = [*window_volume, "window_trades"]
    growing = [*total_volume, "total_trades", *month_volume, "month_trades"]
    points = changes.select(
        *KEY,
        "day",
        F.lead("day").over(per_key).alias("next_day"),
        F.first("day").over(so_far).alias("first_day"),
        *[F.sum(name).over(in_window).alias(name) for name in rolling],
        *[F.sum(name).over(so_far).alias(name) for name in growing],
        F.min("first_trade").over(so_far).alias("first_trade"),
    )
    # Points before the report only matter by what holds on its first day.
    running = points.filter(F.col("next_day").isNull() | (F.col("next_day") > spec.first_day())).withColumn(
        "from_day", F.greatest("day", spec.first_day())
    )
    # Of the points of one day the last holds the sums of all.
    last_of_day = running.filter(F.col("next_day").isNull() | (F.col("next_day") > F.col("from_day")))
    to_day = F.coalesce(F.date_sub("next_day", 1), spec.last_day())
    # Sums of doubles are put together here. The parts of the rolling volume stay beside it, for sums over several keys.
    last_of_day = last_of_day.withColumns(
        {
            name: merge(parts)
            for name, parts in (("window_volume", window_volume), ("total_volume", total_volume), ("month_volume", month_volume))
        }
    )
    kept_parts = [name for name in window_volume if name != "window_volume"]
    sums = ["window_volume", "window_trades", "total_volume", "total_trades", "month_volume", "month_trades", *kept_parts]
    stretch = F.struct("from_day", to_day.alias("to_day"), *sums, "first_trade")
    before_first = F.struct(
        spec.first_day().alias("from_day"),
        F.date_sub("from_day", 1).alias("to_day"),
        *[F.lit(0).cast(type_of(last_of_day, name)).alias(name) for name in sums],
        F.lit(None).cast(type_of(last_of_day, "first_trade")).alias("first_trade"),
    )
    opens_late = (F.col("from_day") == F.col("first_day")) & (F.col("from_day") > spec.first_day())
    covered = F.when(opens_late, F.array(before_first, stretch)).otherwise(F.array(stretch))
    return (
        last_of_day.withColumn("covered", covered)
        .groupBy(*KEY)
        .agg(F.flatten(F.collect_list("covered")).alias("stretches"))
    )


def stretches(timeline: DataFrame) -> DataFrame:
    """Timelines as one row per key and stretch."""
    return timeline.select(*KEY, F.inline("stretches"))


def by_day(stretch_rows: DataFrame, *measures: str) -> DataFrame:
    """One row per key and report day of the given stretches."""
    days = F.sequence("from_day", "to_day")
    return stretch_rows.select(F.explode(days).alias("dt_report"), *KEY, *measures)


def measure_stretches(timeline: DataFrame, present: str, value: str, name: str) -> DataFrame:
    """One measure of the timelines, where it is present: the key, ``from_day``, ``to_day`` and the value as ``name``."""
    return stretches(timeline).filter(F.col(present) > 0).select(*KEY, "from_day", "to_day", F.col(value).alias(name))


def report_measures(timeline: DataFrame, spec: ReportSpec) -> dict[str, DataFrame]:
    """The four measures of the report per (login, server, symbol), as stretches of days, by their names in the report."""
    sources = {
        "sum_volume_prev_7d": ("window_trades", "window_volume"),
        "sum_volume_prev_all": ("total_trades", "total_volume"),
        spec.month_column: ("month_trades", "month_volume"),
        "date_first_trade": ("total_trades", "first_trade"),
    }
    return {name: measure_stretches(timeline, present, value, name) for name, (present, value) in sources.items()}


def _key_measure(timeline: DataFrame, present: str, value: str, name: str) -> DataFrame:
    return by_day(measure_stretches(timeline, present, value, name), name)


def rolling_volume(timeline: DataFrame) -> DataFrame:
    """Volume of the rolling window, on days with a trade in it."""
    return _key_measure(timeline, "window_trades", "window_volume", "sum_volume_prev_7d")


def cumulative_volume(timeline: DataFrame) -> DataFrame:
    """Volume of all trades so far, from the first one on."""
    return _key_measure(timeline, "total_trades", "total_volume", "sum_volume_prev_all")


def calendar_volume(timeline: DataFrame, spec: ReportSpec) -> DataFrame:
    """Volume so far inside the calendar range, from the first trade in it on."""
    return _key_measure(timeline, "month_trades", "month_volume", spec.month_column)


def first_trade(timeline: DataFrame) -> DataFrame:
    """The first close time so far, from the first trade on."""
    return _key_measure(timeline, "total_trades", "first_trade", "date_first_trade")
