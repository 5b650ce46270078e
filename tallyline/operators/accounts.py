"""Joining trades to their accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import require_columns

ACCOUNT = ["login_hash", "server_hash"]


def distinct_users(users: DataFrame) -> DataFrame:
    """Users without whole-row copies."""
    return users.distinct()


def enabled_users(users: DataFrame) -> DataFrame:
    require_columns(users, ["enable"], "users table")
    return users.filter(F.col("enable") == 1)


def closed_trades(trades: DataFrame) -> DataFrame:
    """Trades that have a close time."""
    return trades.filter(F.col("close_time").isNotNull())


def valid_trades(trades: DataFrame) -> DataFrame:
    """Trades closed after they were opened; a trade without either time is dropped."""
    return trades.filter(F.col("open_time") < F.col("close_time"))


def account_currencies(users: DataFrame) -> DataFrame:
    """The distinct currencies of each enabled account."""
    return enabled_users(users).select(*ACCOUNT, "currency").distinct()


def trades_with_users(trades: DataFrame, users: DataFrame) -> DataFrame:
    """Every valid trade of an enabled account, with the currency of the account.

    A plain equi-join: Spark broadcasts the accounts when they turn out small enough, and else
    splits the shuffle partitions of accounts that hold too many trades.
    """
    require_columns(trades, [*ACCOUNT, "open_time", "close_time"], "trades table")
    require_columns(users, [*ACCOUNT, "currency"], "users table")
    accounts = distinct_users(enabled_users(users)).select(*ACCOUNT, "currency")
    return closed_trades(valid_trades(trades)).join(accounts, ACCOUNT).select(*trades.columns, "currency")
