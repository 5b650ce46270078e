"""Account and trade tables derived from the star-schema tables under ``sf_dir``.

``FIXTURES.md`` describes them. Rows that appear more than once come from exploding a list of
copies, so each source table is read once and as a whole.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.sources.tables import load_table

# Currency of the accounts of each region, by region key.
REGION_CURRENCY = ("USD", "EUR", "JPY", "GBP", "AUD")

LEAST_RANGES, ROWS_PER_RANGE = 7, 1_000_000
"""Ranges of prices, and about so many rows in each, which one task sorts in memory."""


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir}/{name}.parquet")


def _login(customer: str) -> Column:
    return F.md5(F.expr(f"cast({customer} div 3 as string)"))


def _server(customer: str) -> Column:
    return F.md5(F.concat(F.lit("s"), F.expr(f"cast({customer} % 3 as string)")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per customer, with some whole-row copies and some accounts in two currencies.

    The accounts of one customer in fifty are filed under another login, so their trades have no
    matching account.
    """
    customer = _source(spark, sf_dir, "customer")
    nation = _source(spark, sf_dir, "nation")
    home_currency = F.element_at(F.array(*[F.lit(c) for c in REGION_CURRENCY]), F.col("n_regionkey") + 1)
    key = F.col("c_custkey")
    currencies = F.concat(
        F.array(home_currency),
        F.when(key % 10 == 0, F.array(home_currency)).otherwise(F.array().cast("array<string>")),
        F.when(key % 97 == 0, F.array(F.lit("CHF"))).otherwise(F.array().cast("array<string>")),
    )
    moved_login = F.md5(F.concat(F.lit("moved-"), key.cast("string")))
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.when(key % 50 == 7, moved_login).otherwise(_login("c_custkey")).alias("login_hash"),
        _server("c_custkey").alias("server_hash"),
        F.when(F.col("c_nationkey") != 24, F.md5("n_name")).alias("country_hash"),
        F.explode(currencies).alias("currency"),
        F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("enable"),
    )


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense trades with a time of day, and a few whole-row copies (trades E)."""
    event = F.col("event_id")
    copies = F.sequence(F.lit(1), F.when(event % 100 == 0, 2).otherwise(1))
    lead_minutes = (event % 7 - 1).cast("int")
    return (
        _source(spark, sf_dir, "events")
        .withColumn("copy", F.explode(copies))
        .select(
            _login("user_id").alias("login_hash"),
            F.md5(event.cast("string")).alias("ticket_hash"),
            _server("user_id").alias("server_hash"),
            F.when(event % 41 != 0, F.col("event_type")).alias("symbol"),
            (event % 4).cast("int").alias("digits"),
            F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("cmd"),
            F.col("value").cast("decimal(18,2)").alias("volume"),
            (F.col("ts") - F.make_dt_interval(mins=lead_minutes)).alias("open_time"),
            F.col("value").alias("open_price"),
            F.lit(100000).cast("bigint").alias("contractsize"),
            F.when(event % 29 != 0, F.col("ts")).alias("close_time"),
        )
    )


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _source(spark, sf_dir, "lineitem")
    orders = _source(spark, sf_dir, "orders")
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)


def _trades_of(line_items: DataFrame) -> DataFrame:
    ticket = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    closed_at = F.col("l_shipdate") + F.make_dt_interval(hours=(F.col("l_partkey") % 24).cast("int"))
    return line_items.select(
        _login("o_custkey").alias("login_hash"),
        F.md5(ticket).alias("ticket_hash"),
        _server("o_custkey").alias("server_hash"),
        F.when(F.col("l_partkey") % 41 != 0, F.concat("l_returnflag", "l_linestatus")).alias("symbol"),
        (F.col("l_linenumber") % 4).alias("digits"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("cmd"),
        (F.col("l_quantity") - 1).cast("decimal(18,2)").alias("volume"),
        F.col("o_orderdate").alias("open_time"),
        F.col("l_extendedprice").alias("open_price"),
        F.lit(100000).cast("bigint").alias("contractsize"),
        F.when(F.col("l_linenumber") != 7, closed_at).alias("close_time"),
    )


def lineitem_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many sparse trades over several years (trades L)."""
    return _trades_of(_line_items(spark, sf_dir))


def lineitem_trades_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades L, dealt out by ranges of their price in ascending order, seven or more. The source rows are dealt, which are narrower than trades."""
    line_items = _line_items(spark, sf_dir)
    parts = max(LEAST_RANGES, ceil(_source(spark, sf_dir, "lineitem").count() / ROWS_PER_RANGE))
    return _trades_of(line_items.repartitionByRange(parts, "l_extendedprice"))
