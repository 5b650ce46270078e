"""The shape of the physical plans: what is shuffled, split, broadcast and read."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyline.operators import accounts, duplicates, measures, numbering, ranking, spine
from tallyline.plans import report, suites
from tallyline.sources import sample_tables
from tallyline.sources.staging import stage
from tallyline.sources.tables import load_table
from tallyline.spec import ReportSpec

SF_DIR = "/root/testdata/sf0.001"
SPEC = ReportSpec(date(2024, 1, 8), date(2024, 1, 25), date(2024, 1, 10), date(2024, 1, 16))


def executed_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skew_sensitive(spark):
    """No broadcasts, and partitions count as skewed at test size already."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture(scope="module")
def hot_tables(spark):
    """A third of the trades, of many symbols, belong to one account."""
    number = F.col("id")
    trades = spark.range(0, 100_000, numPartitions=16).select(
        F.when(number % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), (number % 500).cast("string"))).alias("login_hash"),
        F.md5(number.cast("string")).alias("ticket_hash"),
        F.lit("s1").alias("server_hash"),
        F.concat(F.lit("x"), (number % 20011).cast("string")).alias("symbol"),
        F.lit(5).alias("digits"),
        F.lit(1).alias("cmd"),
        (number % 100).cast("decimal(18,2)").alias("volume"),
        F.lit("2023-01-01").cast("timestamp_ntz").alias("open_time"),
        F.lit(1.5).alias("open_price"),
        F.lit(1).cast("bigint").alias("contractsize"),
        (F.lit("2024-01-05").cast("timestamp_ntz") + F.make_dt_interval((number % 20).cast("int"))).alias("close_time"),
    )
    trades = stage(trades, "hot-trades")
    users = trades.select("login_hash", "server_hash").distinct()
    users = users.select("*", F.lit("c").alias("country_hash"), F.lit("USD").alias("currency"), F.lit(1).alias("enable"))
    return trades, stage(users, "hot-users")


def test_a_hot_account_is_split_in_every_account_join(skew_sensitive, hot_tables):
    trades, users = hot_tables
    joined = accounts.trades_with_users(trades, users).select("ticket_hash", "currency")
    assert "SortMergeJoin(skew=true)" in executed_plan(joined)
    assert "SortMergeJoin(skew=true)" in executed_plan(measures.daily_activity(trades, users, SPEC))


def test_a_hot_login_is_split_when_ranks_are_joined(skew_sensitive, hot_tables):
    keys = report.report_keys(*hot_tables, SPEC)
    split = r"SortMergeJoin\(skew=true\) \[login_hash#\d+\], \[login_hash#\d+\], LeftOuter"
    assert re.search(split, executed_plan(keys.keys))
    rows = report.report_rows(*hot_tables, SPEC)
    assert rows.agg(F.max("row_number")).collect()[0][0] == rows.count() == keys.n_rows


def test_a_hot_key_is_split_when_duplicates_are_flagged(skew_sensitive, hot_tables):
    flagged = duplicates.flag_duplicates(hot_tables[0], ["login_hash"], "first", ["close_time"])
    assert "SortMergeJoin(skew=true)" in executed_plan(flagged.select("ticket_hash", "is_duplicate"))


def test_ties_of_a_third_of_the_rows_are_split(spark, skew_sensitive):
    number = F.col("id")
    rows = stage(
        spark.range(0, 200_000, numPartitions=16).select(
            F.lit(date(2024, 1, 8)).alias("dt_report"),
            F.md5(number.cast("string")).alias("login_hash"),
            F.when(number % 3 == 0, 1).otherwise(number % 5000).alias("trades"),
        ),
        "ties",
    )
    ranked = ranking.dense_rank_by_day(rows, "trades", "rank")
    assert "skew=true" in executed_plan(ranked)
    assert ranked.filter("rank <> 5000 - trades").count() == 0


def test_no_day_is_spelled_out_to_rank(spark, monkeypatch):
    """Steps and distinct values are shuffled, days are not: the only explode is that of the tasks' counts."""
    plans = {}
    monkeypatch.setattr(ranking, "stage", lambda df, label: plans.__setitem__(label, plan(df)) or stage(df, label))
    trades, users = sample_tables.event_trades(spark, SF_DIR), sample_tables.users(spark, SF_DIR)
    timeline = report.staged_timelines(trades, users, SPEC)
    ranking.rank_arrays(timeline, SPEC)
    assert set(plans) == {"contenders", "rank-values", "rank-offsets", "rank-arrays"}
    for label in ("contenders", "rank-values", "rank-arrays"):
        assert "sequence(" not in plans[label] and "explode" not in plans[label], label
    assert "Generate inline" in plans["contenders"] and "rangepartitioning(kind" in plans["rank-values"]


def test_measures_meet_the_keys_once_and_undivided_into_days(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(spine, "stage", lambda df, label: plans.__setitem__(label, plan(df)) or stage(df, label))
    trades, users = sample_tables.event_trades(spark, SF_DIR), sample_tables.users(spark, SF_DIR)
    timeline = report.staged_timelines(trades, users, SPEC)
    rows = spine.aligned_grid(spine.key_currencies(trades, users), measures.report_measures(timeline, SPEC), spine.KEY, SPEC)
    # Only the compact timelines are written, after one shuffle by key.
    assert list(plans) == ["aligned"]
    assert plans["aligned"].count("Exchange") == 1 and "explode" not in plans["aligned"]
    text = plan(rows)
    assert text.count("LeftOuter") == 1
    # The days come last, above every exchange.
    assert "Exchange" not in text[: text.index("Generate explode")]


def test_the_grid_is_numbered_without_being_sorted(spark, monkeypatch):
    trades, users = sample_tables.event_trades(spark, SF_DIR), sample_tables.users(spark, SF_DIR)
    keys = spine.key_currencies(trades, users)
    rows = numbering.numbered_grid(keys, numbering.key_order(*keys.columns), SPEC)
    text = plan(rows)
    assert "rangepartitioning" not in text and "Exchange" not in text[: text.index("Generate explode")]


def test_trades_are_summed_before_they_are_shuffled(spark):
    trades, users = sample_tables.event_trades(spark, SF_DIR), sample_tables.users(spark, SF_DIR)
    text = plan(measures.daily_activity(trades, users, SPEC))
    assert "partial_sum" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_report_has_no_cross_join_and_no_single_task_over_rows(spark, monkeypatch):
    monkeypatch.setattr(report, "ROWS_PER_TASK", 100)
    trades, users = sample_tables.event_trades(spark, SF_DIR), sample_tables.users(spark, SF_DIR)
    text = plan(report.trading_report(trades, users, SPEC))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # The only single partition holds the row counts of the partitions of the key sort.
    assert text.count("SinglePartition") == 1
    assert "RangePartitioning" not in text and "rangepartitioning" not in text


def test_report_is_in_descending_order(spark):
    trades, users = sample_tables.lineitem_trades(spark, SF_DIR), sample_tables.users(spark, SF_DIR)
    spec = ReportSpec(date(1995, 6, 1), date(1995, 9, 30), date(1995, 8, 1), date(1995, 8, 31))
    numbers = [row.row_number for row in report.trading_report(trades, users, spec).select("row_number").collect()]
    assert numbers == list(range(len(numbers), 0, -1))


def test_many_tasks_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(report, "ROWS_PER_TASK", 100)
    trades, users = sample_tables.event_trades(spark, SF_DIR), sample_tables.users(spark, SF_DIR)
    rows = report.trading_report(trades, users, SPEC)
    assert rows.rdd.getNumPartitions() == 14
    numbers = [row.row_number for row in rows.select("row_number").collect()]
    assert numbers == list(range(1332, 0, -1))


def test_only_needed_columns_are_read(spark):
    lineitem = load_table(spark, f"{SF_DIR}/lineitem.parquet")
    trades = lineitem.select(
        F.col("l_orderkey").cast("string").alias("login_hash"),
        F.lit("s").alias("server_hash"),
        F.col("l_returnflag").alias("symbol"),
        F.col("l_quantity").alias("volume"),
        (F.col("l_shipdate") - F.make_dt_interval(F.lit(1))).alias("open_time"),
        F.col("l_shipdate").alias("close_time"),
        F.col("l_tax").alias("open_price"),
    )
    users = sample_tables.users(spark, SF_DIR)
    text = plan(measures.daily_activity(trades, users, SPEC))
    (scan,) = [line for line in text.splitlines() if "FileScan" in line and "l_orderkey" in line]
    assert "l_tax" not in scan and "l_discount" not in scan
    assert "IsNotNull(l_shipdate)" in scan


def test_suite_counts_copies_of_suspects_only(spark):
    trades = sample_tables.event_trades(spark, SF_DIR)
    text = plan(suites.trades_suite(trades))
    assert "LeftSemi" in text
    assert text.count("key_hash__") > 0


def test_grid_days_need_no_join(spark):
    trades, users = sample_tables.event_trades(spark, SF_DIR), sample_tables.users(spark, SF_DIR)
    text = plan(spine.report_grid(trades, users, SPEC))
    assert "Generate explode" in text
    assert "NestedLoop" not in text
