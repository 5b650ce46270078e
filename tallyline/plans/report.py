"""The daily trading report.

The trades are scanned once, into one row per (login, server, symbol) that holds the timeline of
its measures. From those rows come the ranks, as one array per key, and the positions of the keys in
their order; every report day holds the same keys in the same order, so the number of a report row
follows from its day and the position of its key. Only at the end are the days spelled out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.report_days import close_day
from tallyline.operators.accounts import ACCOUNT, account_currencies, trades_with_users
from tallyline.operators.measures import daily_activity, timelines
from tallyline.operators.numbering import key_order, sorted_table, with_position
from tallyline.operators.ranking import rank_arrays
from tallyline.operators.spine import KEY, key_currencies
from tallyline.sources.staging import stage
from tallyline.spec import ReportSpec

ROWS_PER_TASK = 1_000_000
"""Report rows one task makes or sorts; a few hundred megabytes."""

ROWS_PER_FILE = 50_000
"""Keys of one task that writes the report, so rows of a file of one day."""

REPORT_KEY = [*KEY, "currency"]


@dataclass(frozen=True)
class ReportKeys:
    """The numbered keys of a report with their ranks, their timelines by ``key_id`` (None where the keys hold them), and their number."""

    keys: DataFrame
    timelines: DataFrame | None
    n_keys: int
    spec: ReportSpec
    days_before: int = 0
    """Days of the whole report before this part of it, whose rows are numbered first."""

    @property
    def n_rows(self) -> int:
        return self.n_keys * self.spec.n_days


def staged_timelines(trades: DataFrame, users: DataFrame, spec: ReportSpec) -> DataFrame:
    """The timelines of all keys as a written table, so that the trades are read only once.

    Being written, the number ``key_id`` that each key is given stays the same.
    """
    timeline = timelines(daily_activity(trades, users, spec), spec)
    return stage(timeline.withColumn("key_id", F.monotonically_increasing_id()), "timelines")


def report_keys(trades: DataFrame, users: DataFrame, spec: ReportSpec) -> ReportKeys:
    timeline = staged_timelines(trades, users, spec)
    named = timeline.select(*KEY, "key_id").join(account_currencies(users), ACCOUNT)
    placed = sorted_table(named, key_order(*REPORT_KEY), "report-keys")
    symbol_ranks, login_ranks = rank_arrays(timeline, spec)
    keys = (
        with_position(placed)
        .join(symbol_ranks, ["login_hash", "symbol"], "left")
        .join(login_ranks, ["login_hash"], "left")
    )
    return ReportKeys(keys, timeline.select("key_id", "stretches"), placed.count(), spec)


def _tasks(report: ReportKeys) -> int:
    """Enough that no task has more than ``ROWS_PER_TASK`` rows; while tasks are idle, more of a tenth of that."""
    idle = report.keys.sparkSession.sparkContext.defaultParallelism
    return max(1, ceil(report.n_rows / ROWS_PER_TASK), min(idle, ceil(10 * report.n_rows / ROWS_PER_TASK)))


def _with_timelines(report: ReportKeys) -> DataFrame:
    """The compact keys, spread by the rows they are about to become and not by their size."""
    tasks = _tasks(report)
    keys, by_key = report.keys.repartition(tasks, "key_id"), report.timelines.repartition(tasks, "key_id")
    return keys.join(by_key, "key_id")


def keys_in_order(report: ReportKeys) -> DataFrame:
    """The compact keys in ranges of position, each range one partition.

    A partition becomes a file per day, so it has as many keys as a file should have rows,
    or fewer while there are idle tasks.
    """
    idle = report.keys.sparkSession.sparkContext.defaultParallelism
    tasks = max(ceil(report.n_keys / ROWS_PER_FILE), min(_tasks(report), idle), 1)
    per_task = max(1, ceil(report.n_keys / tasks))
    part = F.expr(f"cast(({report.n_keys} - position) div {per_task} as int)")
    return report.keys.join(report.timelines, "key_id").repartitionById(tasks, part)


def days_of_keys(report: ReportKeys, keys: DataFrame) -> DataFrame:
    """The rows of the report for the given keys, without the columns that repeat another."""
    spec = report.spec
    has_symbol = F.col("symbol").isNotNull()
    first = spec.first_day()

    def volume(name: str) -> Column:
        return F.when(has_symbol, F.col(name)).otherwise(F.lit(0)).cast("double").alias(name)

    # What a stretch holds is put into its last form before it becomes days: a decimal is a double once, not once a day.
    stretches = keys.select("position", *REPORT_KEY, "symbol_ranks", "login_ranks", F.inline("stretches")).select(
        "position",
        *REPORT_KEY,
        "symbol_ranks",
        "login_ranks",
        F.datediff("from_day", first).alias("from_index"),
        F.datediff("to_day", first).alias("to_index"),
        *[volume(name) for name in ("window_volume", "total_volume", "month_volume")],
        F.when(has_symbol, F.col("first_trade")).alias("first_trade"),
    )
    rows = stretches.select("*", F.explode(F.sequence("from_index", "to_index")).alias("day_index"))
    day_index = F.col("day_index")

    def rank(name: str) -> Column:
        return F.coalesce(F.get(name, day_index), F.lit(0))

    return rows.select(
        ((day_index.cast("long") + report.days_before) * report.n_keys + F.col("position")).alias("row_number"),
        F.date_add(first, day_index).alias("day"),
        *REPORT_KEY,
        F.col("window_volume").alias("sum_volume_prev_7d"),
        F.col("total_volume").alias("sum_volume_prev_all"),
        rank("symbol_ranks").alias("rank_volume_symbol_prev_7d"),
        rank("login_ranks").alias("rank_count_prev_7d"),
        F.col("month_volume").alias(spec.month_column),
        F.col("first_trade").alias("date_first_trade"),
    )


def presented(rows: DataFrame, spec: ReportSpec) -> DataFrame:
    """The thirteen columns of the report. Its days are spelled out once, not on every row."""
    names = F.array(*[F.lit(str(spec.start + timedelta(days=i))) for i in range(spec.n_days)])
    return rows.select(
        F.col("row_number").alias("id"),
        F.get(names, F.datediff("day", spec.first_day())).alias("dt_report"),
        *REPORT_KEY,
        "sum_volume_prev_7d",
        "sum_volume_prev_all",
        "rank_volume_symbol_prev_7d",
        "rank_count_prev_7d",
        spec.month_column,
        "date_first_trade",
        "row_number",
    )


def _descending(report: ReportKeys, rows: DataFrame) -> DataFrame:
    """The rows in ranges of descending row number, each range one partition.

    The numbers run from 1 to the number of rows, so the ranges are known and need no sampling pass.
    """
    n_rows, tasks = report.n_rows, _tasks(report)
    per_task = ceil(n_rows / tasks) if n_rows else 1
    last = n_rows + report.days_before * report.n_keys
    part = F.expr(f"cast(({last} - row_number) div {per_task} as int)")
    return rows.repartitionById(tasks, part)


def report_rows(trades: DataFrame, users: DataFrame, spec: ReportSpec | None = None) -> DataFrame:
    """All report rows, numbered but in no particular order.

    Calling it already reads the trades and writes the tables that the report is made of; only the
    days are spelled out later.
    """
    report = report_keys(trades, users, spec or ReportSpec())
    return presented(days_of_keys(report, _with_timelines(report)), report.spec)


def trading_report(trades: DataFrame, users: DataFrame, spec: ReportSpec | None = None) -> DataFrame:
    """The report, the highest row number first.

    Calling it runs the same jobs as ``report_rows``. Its order over all rows costs a shuffle of all
    rows; ``write_report`` gives the same rows in order without one.
    """
    report = report_keys(trades, users, spec or ReportSpec())
    rows = _descending(report, days_of_keys(report, _with_timelines(report)))
    return presented(rows.sortWithinPartitions(F.col("row_number").desc()), report.spec)


def rows_to_write(
    trades: DataFrame, users: DataFrame, spec: ReportSpec | None = None, since: date | None = None
) -> DataFrame:
    """The report by day, and by descending row number within a day and partition; with ``since`` only from that day on.

    The compact keys are shuffled by their position, and the days spelled out after that: the rows of a
    day and partition are numbered without a gap, and no row of the report is shuffled.
    """
    whole = spec or ReportSpec()
    part = replace(whole, start=max(since or whole.start, whole.start))
    report = replace(report_keys(trades, users, part), days_before=(part.start - whole.start).days)
    rows = presented(days_of_keys(report, keys_in_order(report)), report.spec)
    return rows.sortWithinPartitions("dt_report", F.col("row_number").desc())


def write_report(trades: DataFrame, users: DataFrame, path: str, spec: ReportSpec | None = None) -> None:
    """Write the report as parquet, one directory per report day, a run of descending row numbers in each file."""
    rows_to_write(trades, users, spec).write.partitionBy("dt_report").parquet(path)


def first_changed_day(late: DataFrame, users: DataFrame, path: str, spec: ReportSpec | None = None) -> date | None:
    """The first day of a written report that changes when the trades ``late`` are added; None if none does.

    A trade shows on its close day and on all days after it: in the sums so far, and for a window's length in the ranks of everyone. Days before the
    first close day hold the same trades as ever. A key that the report does not have yet, whenever its trade closed, is a row of every day and moves the
    numbers of the others, so that then every day changes. The keys are read from one day of the report, which lists them all.
    """
    whole = spec or ReportSpec()
    keys = key_currencies(late, users)
    stored = late.sparkSession.read.parquet(path)
    of_day = stored.filter(F.col("dt_report") == F.lit(whole.start)).select(*[F.col(name).alias(f"{name}__stored") for name in REPORT_KEY])
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"{name}__stored")) for name in REPORT_KEY])
    is_new = keys.join(of_day, same, "left_anti").limit(1).select(F.lit(True).alias("is_new"))
    # Of the trades that count: valid ones of enabled accounts.
    first = trades_with_users(late, users).agg(F.min(close_day()).alias("first"))
    found = first.select("first", F.lit(False).alias("is_new")).unionByName(is_new, allowMissingColumns=True)
    first_day, any_new = found.agg(F.min("first"), F.bool_or("is_new")).first()
    if any_new:
        return whole.start
    if first_day is None or first_day > whole.end:
        return None
    return max(first_day, whole.start)


def refresh_report(
    trades: DataFrame, late: DataFrame, users: DataFrame, path: str, spec: ReportSpec | None = None, everything: bool = False
) -> date | None:
    """Bring a written report up to date with ``late`` trades. ``trades`` are those that it was written from, ``users`` the same as then.

    The days that change are written anew, all their rows, and replace those of the report directory by directory; the others are not touched.
    Returns the first day that was written, or None. A run that fails before it replaces directories changes nothing; one that fails while it does may leave
    some days new and some old, and is to be repeated with ``everything``, which writes all days.
    """
    since = (spec or ReportSpec()).start if everything else first_changed_day(late, users, path, spec)
    if since is not None:
        rows = rows_to_write(trades.unionByName(late), users, spec, since)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt_report").parquet(path)
    return since
