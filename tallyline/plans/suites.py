"""The check suites of the users and trades tables, as report rows.

A suite is one aggregation for all row-level checks and missing values, plus one pass for the duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators import checks
from tallyline.operators.accounts import ACCOUNT
from tallyline.operators.checks import Check
from tallyline.operators.duplicates import duplicate_counts
from tallyline.operators.foreign_keys import check_foreign_key, foreign_key_mismatches
from tallyline.sources.staging import stage

# The columns the suites require, and the logical key of a trade.
USERS_MANDATORY = ["login_hash", "server_hash", "country_hash", "currency", "enable"]
TRADES_KEY = ["login_hash", "ticket_hash", "server_hash", "open_time"]
TRADES_MANDATORY = [
    "login_hash",
    "ticket_hash",
    "server_hash",
    "symbol",
    "digits",
    "cmd",
    "volume",
    "open_time",
    "open_price",
    "contractsize",
]
REPORT_COLUMNS = ["suite", "seq", "check", "columns", "passed", "bad_rows"]


@dataclass(frozen=True)
class Suite:
    """The checks of one table: its duplicates by some keys, rules for its rows, and columns that must be filled."""

    name: str
    table: DataFrame
    duplicate_keys: Sequence[Sequence[str] | None]
    rules: Sequence[Check]
    mandatory: Sequence[str]

    def row_metrics(self) -> list[Column]:
        """Aggregates: the rows that break each rule, and those without a value in each mandatory column."""
        return [*checks.broken_counts(self.rules), *checks.missing_counts(self.table, self.mandatory)]

    def totals(self) -> DataFrame:
        """One row, from one pass: the ``row_metrics``."""
        return self.table.agg(*self.row_metrics())

    def _numbered(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(self.name).alias("suite"), (F.col("place") + 1).alias("seq"), "row.*")

    def _rule_rows(self, totals: DataFrame) -> DataFrame:
        rule_rows = [checks.result_of(rule, F.col(f"c{i}")) for i, rule in enumerate(self.rules)]
        placed = totals.select(F.posexplode(F.array(*rule_rows)).alias("place", "row"))
        return placed.withColumn("place", F.col("place") + len(self.duplicate_keys))

    def row_verdicts(self, totals: DataFrame) -> DataFrame:
        """The verdicts of the row-level checks alone, numbered as among all."""
        return self._numbered(self._rule_rows(totals))

    def verdicts(self, totals: DataFrame) -> DataFrame:
        """Duplicate checks first, then the row-level ones; ``seq`` counts from 1."""
        copies = duplicate_counts(self.table, self.duplicate_keys)
        duplicate_rows = [
            checks.report_row(
                "duplicates", self.table.columns if key is None else key, F.col(f"n{i}") == 0, F.col(f"n{i}")
            )
            for i, key in enumerate(self.duplicate_keys)
        ]
        rows = copies.select(F.posexplode(F.array(*duplicate_rows)).alias("place", "row"))
        return self._numbered(rows.union(self._rule_rows(totals)))

    def null_status(self, totals: DataFrame) -> DataFrame:
        """``(suite, column, has_null, null_rows)`` for each mandatory column."""
        return checks.missing_rows(totals, self.mandatory).select(F.lit(self.name).alias("suite"), "*")


def users_rules(users: DataFrame) -> Suite:
    """The suite of a users table."""
    rules = [checks.binary(users, "enable"), checks.mandatory(users, USERS_MANDATORY)]
    return Suite("users", users, [None], rules, USERS_MANDATORY)


def trades_rules(trades: DataFrame) -> Suite:
    """The suite of a trades table."""
    rules = [
        checks.numerical(trades, "digits"),
        checks.numerical(trades, "cmd"),
        checks.numerical(trades, "volume"),
        checks.binary(trades, "cmd"),
        checks.timestamp(trades, "open_time"),
        checks.timestamp(trades, "close_time"),
        checks.mandatory(trades, TRADES_MANDATORY),
        checks.greater_than(trades, "volume"),
        checks.greater_than(trades, "close_time", "open_time"),
    ]
    return Suite("trades", trades, [None, TRADES_KEY], rules, TRADES_MANDATORY)


def users_suite(users: DataFrame) -> DataFrame:
    suite = users_rules(users)
    return suite.verdicts(suite.totals())


def trades_suite(trades: DataFrame) -> DataFrame:
    suite = trades_rules(trades)
    return suite.verdicts(suite.totals())


def users_null_status(users: DataFrame) -> DataFrame:
    """Which mandatory columns of the users have missing values, and how many."""
    suite = users_rules(users)
    return suite.null_status(suite.totals())


def trades_null_status(trades: DataFrame) -> DataFrame:
    """Which mandatory columns of the trades have missing values, and how many."""
    suite = trades_rules(trades)
    return suite.null_status(suite.totals())


def cross_reference(trades: DataFrame, users: DataFrame) -> DataFrame:
    result = check_foreign_key(trades, ACCOUNT, users, ACCOUNT)
    return result.select(F.lit("cross_reference").alias("suite"), F.lit(1).alias("seq"), "*")


def full_report(users: DataFrame, trades: DataFrame) -> DataFrame:
    """All suites, ordered by suite and check. Calling it already reads the tables once, to find what may be duplicate."""
    rows = users_suite(users).union(trades_suite(trades)).union(cross_reference(trades, users))
    return rows.orderBy("suite", "seq")


def write_full_report(users: DataFrame, trades: DataFrame, path: str) -> None:
    """Write the whole check run as parquet: ``verdicts``, ``null_status`` and ``unknown_accounts`` below ``path``.

    Verdicts and missing values come from the same pass over each table.
    """
    suites = [users_rules(users), trades_rules(trades)]
    totals = [stage(suite.totals(), f"{suite.name}-totals") for suite in suites]
    verdicts, null_status = (
        [view(suite, row) for suite, row in zip(suites, totals)] for view in (Suite.verdicts, Suite.null_status)
    )
    unknown = stage(foreign_key_mismatches(trades, ACCOUNT, users, ACCOUNT), "unknown-accounts")
    n_unknown = unknown.agg(F.count("*").alias("n"))
    crossed = checks.verdict(n_unknown, "foreign key", ACCOUNT, F.col("n"))
    crossed = crossed.select(F.lit("cross_reference").alias("suite"), F.lit(1).alias("seq"), "*")
    verdicts[0].union(verdicts[1]).union(crossed).coalesce(1).write.parquet(f"{path}/verdicts")
    null_status[0].union(null_status[1]).coalesce(1).write.parquet(f"{path}/null_status")
    unknown.write.parquet(f"{path}/unknown_accounts")
