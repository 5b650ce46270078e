"""The report stored as what it is made of: one row per key, with its timeline and ranks.

The rows of a report repeat a key every day. Stored compactly a key is one row, and days are spelled out by whoever reads
them: only those that are asked for, of the accounts that are asked for. The keys are stored in their order, so that the files
and row groups of other logins are passed over by their statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.plans.report import REPORT_KEY, ReportKeys, days_of_keys, keys_in_order, presented, report_keys
from tallyline.spec import ReportSpec


def write_compact(trades: DataFrame, users: DataFrame, path: str, spec: ReportSpec | None = None) -> None:
    """Store the report compactly below ``path``: ``keys``, in the order of the report, and ``spec``, one row of its ranges and size."""
    report = report_keys(trades, users, spec or ReportSpec())
    columns = ["position", *REPORT_KEY, "symbol_ranks", "login_ranks", "stretches"]
    keys_in_order(report).select(*columns).sortWithinPartitions("position").write.parquet(f"{path}/keys")
    told = {**asdict(report.spec), "n_keys": report.n_keys}
    trades.sparkSession.range(1).select(*[F.lit(value).alias(name) for name, value in told.items()]).coalesce(1).write.parquet(f"{path}/spec")


def stored_report(spark: SparkSession, path: str) -> ReportKeys:
    """The compact report below ``path``, nothing of it spelled out."""
    told = spark.read.parquet(f"{path}/spec").first().asDict()
    n_keys = told.pop("n_keys")
    return ReportKeys(spark.read.parquet(f"{path}/keys"), None, n_keys, ReportSpec(**told))


def read_compact(
    spark: SparkSession,
    path: str,
    first: date | None = None,
    last: date | None = None,
    logins: Sequence[str] | None = None,
) -> DataFrame:
    """The thirteen columns of the report, in no particular order, for the days from ``first`` to ``last`` and the given logins.

    By default all days, or all logins. Numbers and ranks are those of the whole report. Days outside it have no rows; filters on the
    key columns that are put on the result reach the files too.
    """
    report = stored_report(spark, path)
    spec = report.spec
    begin, end = max(first or spec.start, spec.start), min(last or spec.end, spec.end)
    keys = report.keys if logins is None else report.keys.filter(F.col("login_hash").isin(list(logins)))
    if begin > end:
        keys = keys.limit(0)
    asked = F.transform(
        F.filter("stretches", lambda s: (s["from_day"] <= F.lit(end)) & (s["to_day"] >= F.lit(begin))),
        lambda s: s.withField("from_day", F.greatest(s["from_day"], F.lit(begin))).withField("to_day", F.least(s["to_day"], F.lit(end))),
    )
    return presented(days_of_keys(report, keys.withColumn("stretches", asked)), spec)
