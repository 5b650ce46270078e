"""Small users and trades tables for tests."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tallyline.sources.tables import TRADES_SCHEMA, USERS_SCHEMA


def at(day: str, time: str = "12:00:00") -> datetime:
    return datetime.fromisoformat(f"{day} {time}")


def user(login: str, server: str = "s1", currency: str | None = "USD", enable: int = 1, country: str = "c1") -> tuple:
    return (login, server, country, currency, enable)


def trade(
    login: str | None,
    closed: datetime | None,
    volume: float | str | None = 1,
    symbol: str | None = "EURUSD",
    server: str | None = "s1",
    opened: datetime = datetime(2000, 1, 1),
    ticket: str = "t",
) -> tuple:
    amount = None if volume is None else Decimal(str(volume))
    return (login, ticket, server, symbol, 5, 1, amount, opened, 1.25, 100000, closed)


def users_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, USERS_SCHEMA)


def trades_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, TRADES_SCHEMA)
