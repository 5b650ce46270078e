
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, time, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle_queries import ORACLE_SQL
from tallyline.functions import report_days
from tallyline.operators import (
    accounts,
    checks,
    duplicates,
    foreign_keys,
    intervals,
    measures,
    numbering,
    ranking,
    spine,
)
from tallyline.plans import compact, gate, report, suites
from tallyline.sources import sample_tables, tables
from tallyline.sources.staging import shared_folder, stage
from tallyline.spec import ReportSpec

try:
    import corpus_pipeline
    from tallyline.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    # Only when the subpackage or the pipeline is left out; a fault inside them is not passed over.
    if missing.name not in ("corpus_pipeline", "tallyline.llm"):
        raise
    corpus_pipeline = llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

SMALLEST = "/root/testdata/sf0.001"

# Report ranges inside the days that the two trade tables cover.
EVENT_REPORT = ReportSpec(date(2024, 1, 8), date(2024, 1, 25), date(2024, 1, 10), date(2024, 1, 16))
LINEITEM_REPORT = ReportSpec(date(2001, 6, 1), date(2001, 9, 30), date(2001, 8, 1), date(2001, 8, 31))

TRADE_DAY = ["dt_report", "ticket_hash", "login_hash", "server_hash", "symbol", "close_time"]


def _run_query_by_position(spark: SparkSession, sf: str) -> DataFrame:
    return tables.run_query(
        spark,
        "select symbol, count(*) as trades, max(close_time) as last_close from {trades} "
        "where close_time >= ? and coalesce(symbol, ?) <> ? group by symbol",
        [datetime(2024, 1, 10), "none", "login"],
        trades=sample_tables.event_trades(spark, sf),
    )


def _on_users(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(sample_tables.users(spark, sf))


def _on_trades(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(sample_tables.event_trades(spark, sf))


def _on_lineitem_trades(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(sample_tables.lineitem_trades(spark, sf))


def _on_both(query: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(sample_tables.event_trades(spark, sf), sample_tables.users(spark, sf))


def _on_both_lineitem(query: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(sample_tables.lineitem_trades(spark, sf), sample_tables.users(spark, sf))


def _joined(trades: DataFrame, users: DataFrame) -> DataFrame:
    return accounts.trades_with_users(trades, users)


def _timeline(trades: DataFrame, users: DataFrame) -> DataFrame:
    return report.staged_timelines(trades, users, EVENT_REPORT)


def _plain(query: Query) -> Query:
    """The query with decimals as doubles and dates as text, which every client reads alike."""
    simpler = {"decimal": "double", "date": "string"}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = query(spark, sf)
        kinds = {field.name: field.dataType.typeName() for field in df.schema}
        return df.withColumns({name: F.col(name).cast(simpler[kind]) for name, kind in kinds.items() if kind in simpler})

    return run


# Scans and sources


def _days_with_trade_counts(trades: DataFrame) -> DataFrame:
    per_day = trades.groupBy(report_days.close_day().alias("dt_report")).agg(F.count("*").alias("trades"))
    counted = spine.attach(spine.close_day_series(trades), per_day, ["dt_report"])
    return counted.select("dt_report", F.coalesce("trades", F.lit(0)).alias("trades"))


def _run_query(spark: SparkSession, sf: str) -> DataFrame:
    return tables.run_query(
        spark,
        "select login_hash, server_hash, count(*) as trades, cast(sum(volume) as double) as volume "
        "from {trades} where cmd = :cmd and volume > :least group by login_hash, server_hash",
        {"cmd": 1, "least": 10},
        trades=sample_tables.event_trades(spark, sf),
    )


# Predicates and range joins


def _trade_days(days: Callable) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def query(trades: DataFrame, users: DataFrame) -> DataFrame:
        return spine.on_days(_joined(trades, users), days(report_days.close_day(), EVENT_REPORT))

    return query


def _rolling_trade_days(trades: DataFrame, users: DataFrame) -> DataFrame:
    return _trade_days(report_days.rolling_days)(trades, users).select(*TRADE_DAY, "currency")


def _trade_totals() -> dict[str, Column]:
    return {
        "trades": F.count("*"),
        "volume": F.sum("volume"),
        "first_ticket": F.min("ticket_hash"),
        "last_ticket": F.max("ticket_hash"),
        "first_close": F.min("close_time"),
        "last_close": F.max("close_time"),
    }


DIGEST = ["login_hash", "symbol", "currency"]


def _combined(trades: DataFrame, users: DataFrame) -> DataFrame:
    """All pairs of a day and a trade, summed up: the same on every day, so that the pairs are never made."""
    totals = _joined(trades, users).groupBy(*DIGEST).agg(*[m.alias(name) for name, m in _trade_totals().items()])
    return spine.combined_data(totals, EVENT_REPORT).withColumn("volume", F.col("volume").cast("double"))


def _cumulative(trades: DataFrame, users: DataFrame) -> DataFrame:
    """The pairs of a day and a trade closed by then, summed up."""
    rows = spine.daily_digests(_joined(trades, users), DIGEST, _trade_totals(), EVENT_REPORT)
    return rows.withColumn("volume", F.col("volume").cast("double"))


def _calendar(trades: DataFrame, users: DataFrame) -> DataFrame:
    """As ``_cumulative``, of the trades closed inside the calendar range."""
    inside = _joined(trades, users).filter(report_days.in_month(report_days.close_day(), EVENT_REPORT))
    rows = spine.daily_digests(inside, DIGEST, _trade_totals(), EVENT_REPORT)
    return rows.withColumn("volume", F.col("volume").cast("double"))


def _range_join(trades: DataFrame, users: DataFrame) -> DataFrame:
    pairs = spine.range_join(_joined(trades, users), EVENT_REPORT)
    return pairs.groupBy("dt_report", "symbol").agg(
        F.count("*").alias("trades"), F.sum("volume").cast("double").alias("volume")
    )


def _range_join_90d(trades: DataFrame, users: DataFrame) -> DataFrame:
    pairs = spine.range_join(_joined(trades, users), replace(LINEITEM_REPORT, window_days=90))
    return pairs.groupBy("dt_report", "currency").agg(
        F.count("*").alias("trades"),
        F.sum("volume").cast("double").alias("volume"),
        F.min("close_time").alias("first_close"),
        F.max("close_time").alias("last_close"),
    )


def _window_join_36h(trades: DataFrame, users: DataFrame) -> DataFrame:
    """The 36 hours up to every sixth hour of the report, by symbol: to the second, not by whole days."""
    start, end = (datetime.combine(day, time()) for day in (EVENT_REPORT.start, EVENT_REPORT.end))
    joined = _joined(trades, users).select("symbol", "volume", "close_time")
    moments = intervals.instants(trades.sparkSession.range(1), start, end, timedelta(hours=6)).drop("id")
    pairs = intervals.window_join(joined, moments, "close_time", "instant", timedelta(hours=36))
    return pairs.groupBy("instant", "symbol").agg(
        F.count("*").alias("trades"),
        F.sum("volume").cast("double").alias("volume"),
        F.min("close_time").alias("first_close"),
        F.max("close_time").alias("last_close"),
    )


def _account_window_36h(trades: DataFrame, users: DataFrame) -> DataFrame:
    """For every opening of an enabled account's trade, what the account closed in the 36 hours up to it."""
    joined = _joined(trades, users).select(*accounts.ACCOUNT, "volume", "close_time")
    openings = trades.select(*accounts.ACCOUNT, F.col("open_time").alias("opened")).distinct()
    pairs = intervals.window_join(joined, openings, "close_time", "opened", timedelta(hours=36), accounts.ACCOUNT)
    return pairs.groupBy(*accounts.ACCOUNT, "opened").agg(F.count("*").alias("trades"), F.sum("volume").cast("double").alias("volume"))


def _report_scalars(trades: DataFrame) -> DataFrame:
    day = report_days.close_day()
    return trades.select(
        "ticket_hash",
        F.coalesce("volume", F.lit(0)).cast("double").alias("volume_or_zero"),
        F.coalesce(F.when(F.col("cmd") == 1, F.col("volume")), F.lit(0)).cast("double").alias("cmd_volume_or_zero"),
        day.alias("close_day"),
        F.date_sub(day, EVENT_REPORT.window_days).alias("window_opens_after"),
        F.date_format(day, "yyyy-MM-dd").alias("close_day_text"),
        F.col("contractsize").cast("int").alias("contractsize_int"),
        F.col("close_time").cast("timestamp_ntz").alias("close_timestamp"),
        (day >= F.to_date(F.lit("2024-01-10"))).alias("on_or_after"),
        ((day <= F.to_date(F.lit("2024-01-16"))) & (F.col("volume") > 100)).alias("before_and_large"),
    )


# Report pieces


def _ranked(timeline: DataFrame, spec: ReportSpec = EVENT_REPORT) -> DataFrame:
    return ranking.rank_steps(stage(ranking.contender_steps(timeline, spec), "contenders"), spec)


def _rank_by_symbol(timeline: DataFrame) -> DataFrame:
    rows = ranking.ranks_by_day(_ranked(timeline), ranking.VOLUME, "rank_volume_symbol_prev_7d")
    return rows.drop("trades").withColumnRenamed("value", "sum_volume_symbol_prev_7d")


def _rank_by_login(timeline: DataFrame) -> DataFrame:
    rows = ranking.ranks_by_day(_ranked(timeline), ranking.COUNT, "rank_count_prev_7d")
    return rows.drop("value", "symbol").withColumnRenamed("trades", "sum_count_prev_7d")


def _volume_by_symbol(timeline: DataFrame) -> DataFrame:
    rows = ranking.steps_by_day(ranking.contender_steps(timeline, EVENT_REPORT), ranking.VOLUME)
    return rows.drop("trades").withColumnRenamed("value", "sum_volume_symbol_prev_7d")


def _count_by_login(timeline: DataFrame) -> DataFrame:
    rows = ranking.steps_by_day(ranking.contender_steps(timeline, EVENT_REPORT), ranking.COUNT)
    return rows.drop("value", "symbol").withColumnRenamed("trades", "sum_count_prev_7d")


def _joined_measures(trades: DataFrame, users: DataFrame) -> DataFrame:
    measured = measures.report_measures(_timeline(trades, users), EVENT_REPORT)
    rows = spine.aligned_grid(spine.key_currencies(trades, users), measured, spine.KEY, EVENT_REPORT)
    return rows.fillna(0, ["sum_volume_prev_7d", "sum_volume_prev_all", EVENT_REPORT.month_column])


def _joined_symbol_rank(trades: DataFrame, users: DataFrame) -> DataFrame:
    ranks, _ = ranking.rank_arrays(_timeline(trades, users), EVENT_REPORT)
    keys, on = spine.key_currencies(trades, users), ["login_hash", "symbol"]
    return spine.daily_grid(keys, ranks, on, "symbol_ranks", "rank_volume_symbol_prev_7d", EVENT_REPORT)


def _joined_login_rank(trades: DataFrame, users: DataFrame) -> DataFrame:
    _, ranks = ranking.rank_arrays(_timeline(trades, users), EVENT_REPORT)
    keys = spine.key_currencies(trades, users)
    return spine.daily_grid(keys, ranks, ["login_hash"], "login_ranks", "rank_count_prev_7d", EVENT_REPORT)


def _report_digest(trades: DataFrame, users: DataFrame) -> DataFrame:
    """The 122-day report, every row of it, summed up per day, symbol and currency."""
    month = LINEITEM_REPORT.month_column
    return (
        report.report_rows(trades, users, LINEITEM_REPORT)
        .groupBy("dt_report", "symbol", "currency")
        .agg(
            F.count("*").alias("report_rows"),
            F.sum("row_number").alias("row_numbers"),
            F.min("row_number").alias("first_row"),
            F.max("row_number").alias("last_row"),
            *[F.sum(name).alias(name) for name in ("sum_volume_prev_7d", "sum_volume_prev_all", month)],
            F.sum("rank_volume_symbol_prev_7d").alias("volume_ranks"),
            F.sum("rank_count_prev_7d").alias("count_ranks"),
            F.count("date_first_trade").alias("traded"),
            F.min("date_first_trade").alias("date_first_trade"),
        )
    )


# Every third trade that closed from this day on arrives late.
LATE_FROM = date(2024, 1, 19)


def _refreshed_report(trades: DataFrame, users: DataFrame) -> DataFrame:
    """The report of the trades that came in time, written, brought up to date with the late ones, and read again."""
    is_late = (report_days.close_day() >= F.lit(LATE_FROM)) & (F.pmod(F.xxhash64("ticket_hash"), F.lit(3)) == 0)
    is_late = F.coalesce(is_late, F.lit(False))
    path = f"{shared_folder(trades.sparkSession)}/report-{uuid.uuid4().hex}"
    in_time, late = trades.filter(~is_late), trades.filter(is_late)
    report.write_report(in_time, users, path, EVENT_REPORT)
    report.refresh_report(in_time, late, users, path, EVENT_REPORT)
    return trades.sparkSession.read.parquet(path)


def _compact_report(first: date | None, last: date | None, in_francs: bool) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The report, stored compactly and read again: some days of it, of all accounts or of those in Swiss francs."""

    def query(trades: DataFrame, users: DataFrame) -> DataFrame:
        spark = trades.sparkSession
        path = f"{shared_folder(spark)}/compact-{uuid.uuid4().hex}"
        compact.write_compact(trades, users, path, EVENT_REPORT)
        rows = compact.read_compact(spark, path, first, last)
        return rows.filter(F.col("currency") == "CHF") if in_francs else rows

    return query


def _numbered_grid(name: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def query(trades: DataFrame, users: DataFrame) -> DataFrame:
        return numbering.numbered_grid(spine.key_currencies(trades, users), numbering.key_order(*report.REPORT_KEY), EVENT_REPORT, name)

    return query


def _timeline_query(query: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_both(lambda trades, users: query(_timeline(trades, users)))


def _on_double_volumes(query: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """The dense trades with their prices for volumes: doubles whose plain sums depend on the order of addition."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        trades = sample_tables.event_trades(spark, sf)
        return query(trades.withColumn("volume", F.col("open_price")), sample_tables.users(spark, sf))

    return run


def _on_double_timeline(query: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_double_volumes(lambda trades, users: query(_timeline(trades, users)))


# Checks


def _flags(keep: duplicates.Keep) -> Query:
    return _on_lineitem_trades(
        lambda trades: duplicates.flag_duplicates(trades, suites.TRADES_KEY, keep, ["close_time"])
    )


def _dedup(keep: duplicates.Keep) -> Query:
    return _on_lineitem_trades(
        lambda trades: duplicates.drop_duplicates(trades, suites.TRADES_KEY, keep, ["close_time"])
    )


def _on_delivered(query: Callable[[DataFrame], DataFrame]) -> Query:
    """The trades as they arrive: in several files, the dearest last, rows in an order of their own."""
    rest = ["symbol", "digits", "cmd", "volume", "contractsize", "close_time"]
    names = ["open_price", *rest, "login_hash", "ticket_hash", "server_hash", "open_time"]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        order = [F.col(name).asc_nulls_first() for name in names]
        trades = sample_tables.lineitem_trades_by_price(spark, sf)
        return query(stage(trades.sortWithinPartitions(*order), "delivered", compression="zstd"))

    return run


def _texts(trades: DataFrame) -> DataFrame:
    """Trade columns as the text they may arrive as."""
    return trades.select(
        "symbol", *[F.col(name).cast("string").alias(name) for name in ("digits", "volume", "open_time", "close_time")]
    )


def _numerical_values(trades: DataFrame) -> DataFrame:
    texts = _texts(trades)
    return checks.run_checks(texts, [checks.numerical(texts, name, by_values=True) for name in texts.columns])


def _timestamp_values(trades: DataFrame) -> DataFrame:
    texts = _texts(trades)
    names = ["symbol", "open_time", "close_time"]
    return checks.run_checks(texts, [checks.timestamp(texts, name, by_values=True) for name in names])


def _check_all(check: Callable[..., checks.Check], *columns: str) -> Query:
    return _on_trades(lambda trades: checks.run_checks(trades, [check(trades, name) for name in columns]))


# A stored table of the trades opened before the one time, and a delivery of those opened from the other on: two days come again.
LOADED_UNTIL, DELIVERED_FROM = datetime(2024, 1, 17), datetime(2024, 1, 15)


def _gated_delivery(trades: DataFrame, users: DataFrame) -> DataFrame:
    opened = F.col("open_time")
    return gate.gate_trades(trades.filter(opened >= F.lit(DELIVERED_FROM)), users, trades.filter(opened < F.lit(LOADED_UNTIL)))


def _load_verdicts(trades: DataFrame, users: DataFrame) -> DataFrame:
    """Row-level verdicts of a whole load, from the pass that writes it."""
    path = f"{shared_folder(trades.sparkSession)}/load-{uuid.uuid4().hex}"
    return gate.load_trades(trades, users, path).verdicts


def _load_nulls(trades: DataFrame, users: DataFrame) -> DataFrame:
    path = f"{shared_folder(trades.sparkSession)}/load-{uuid.uuid4().hex}"
    return gate.load_trades(trades, users, path).null_status


def _rejected_text(gated: DataFrame) -> DataFrame:
    return gate.rejected(gated).withColumn("broken_rules", F.array_join("broken_rules", "; "))


def queries() -> dict[str, Query]:
    """Every operator and report, over the whole tables it reads."""
    named = {
        # Scans and sources
        "scan_users": _on_users(lambda users: users),
        "scan_trades": _on_trades(lambda trades: trades),
        "scan_lineitem_trades": _on_lineitem_trades(lambda trades: trades),
        "run_query_params": _run_query,
        "run_query_params_by_position": _run_query_by_position,
        "date_series": _on_trades(_days_with_trade_counts),
        # Filters and predicates
        "enabled_users": _on_users(accounts.enabled_users),
        "valid_trades": _on_trades(accounts.valid_trades),
        "closed_trades": _on_trades(accounts.closed_trades),
        "rolling_predicate": _on_both(_rolling_trade_days),
        "cumulative_predicate": _on_both(_cumulative),
        "calendar_predicate": _on_both(_calendar),
        "report_scalars": _on_trades(_report_scalars),
        # Joins
        "distinct_users": _on_users(accounts.distinct_users),
        "trades_with_users": _on_both(_joined),
        "combined_data": _on_both(_combined),
        "range_join_7d": _on_both(_range_join),
        "range_join_90d": _on_both_lineitem(_range_join_90d),
        "window_join_36h": _on_both(_window_join_36h),
        "account_window_join_36h": _on_both(_account_window_36h),
        "spine_left_join": _on_both(_joined_measures),
        "rank_join_symbol": _on_both(_joined_symbol_rank),
        "rank_join_login": _on_both(_joined_login_rank),
        # Grid and measures
        "report_grid": _on_both(lambda t, u: spine.report_grid(t, u, EVENT_REPORT)),
        "sum_volume_prev_7d": _timeline_query(measures.rolling_volume),
        "sum_volume_prev_all": _timeline_query(measures.cumulative_volume),
        "sum_volume_symbol_prev_7d": _timeline_query(_volume_by_symbol),
        "sum_volume_prev_7d_double": _on_double_timeline(measures.rolling_volume),
        "sum_volume_prev_all_double": _on_double_timeline(measures.cumulative_volume),
        "sum_volume_symbol_prev_7d_double": _on_double_timeline(_volume_by_symbol),
        "sum_count_prev_7d": _timeline_query(_count_by_login),
        "sum_volume_month": _timeline_query(lambda tl: measures.calendar_volume(tl, EVENT_REPORT)),
        "date_first_trade": _timeline_query(measures.first_trade),
        # Ranks and numbers
        "rank_volume_symbol_prev_7d": _timeline_query(_rank_by_symbol),
        "rank_volume_symbol_prev_7d_double": _on_double_timeline(_rank_by_symbol),
        "rank_count_prev_7d": _timeline_query(_rank_by_login),
        "report_row_number": _on_both(_numbered_grid("row_number")),
        "report_serial_id": _on_both(_numbered_grid("id")),
        # The report
        "trading_report": _on_both(lambda t, u: report.trading_report(t, u, EVENT_REPORT)),
        "compact_report": _on_both(_compact_report(None, None, False)),
        "compact_report_day": _on_both(_compact_report(date(2024, 1, 20), date(2024, 1, 20), False)),
        "compact_report_week_chf": _on_both(_compact_report(date(2024, 1, 12), date(2024, 1, 18), True)),
        "trading_report_refreshed": _on_both(_refreshed_report),
        "trading_report_double": _on_double_volumes(lambda t, u: report.trading_report(t, u, EVENT_REPORT)),
        "trading_report_122d_digest": _on_both_lineitem(_report_digest),
        # Duplicates
        "dup_count_all": _on_trades(duplicates.duplicate_count),
        "dup_count_subset": _on_users(lambda users: duplicates.duplicate_count(users, accounts.ACCOUNT)),
        "dup_count_keep_none": _on_lineitem_trades(
            lambda trades: duplicates.duplicate_count(trades, suites.TRADES_KEY, keep=False)
        ),
        "dup_flags_first": _flags("first"),
        "dup_flags_last": _flags("last"),
        "dup_flags_keep_none": _flags(False),
        "dup_flags_first_arrival": _on_delivered(
            lambda trades: duplicates.flag_duplicates(trades, suites.TRADES_KEY, "first")
        ),
        "dedup_drop_last_arrival": _on_delivered(
            lambda trades: duplicates.drop_duplicates(trades, suites.TRADES_KEY, "last")
        ),
        "dedup_drop_first": _dedup("first"),
        "dedup_drop_last": _dedup("last"),
        "dedup_drop_keep_none": _dedup(False),
        "dedup_whole_rows": _on_trades(duplicates.drop_duplicates),
        # Checks
        "check_binary": _check_all(checks.binary, "cmd", "digits", "symbol"),
        "check_numerical": _check_all(checks.numerical, "digits", "cmd", "volume", "symbol"),
        "check_numerical_values": _on_trades(_numerical_values),
        "check_timestamp": _check_all(checks.timestamp, "open_time", "close_time", "symbol"),
        "check_timestamp_values": _on_trades(_timestamp_values),
        "check_mandatory": _on_trades(lambda t: checks.mandatory_status(t, suites.TRADES_MANDATORY)),
        "check_mandatory_all_columns": _on_users(checks.mandatory_status),
        "check_gt_zero": _on_lineitem_trades(
            lambda t: checks.run_checks(t, [checks.greater_than(t, "volume"), checks.greater_than(t, "open_price")])
        ),
        "check_gt_column": _on_trades(
            lambda t: checks.run_checks(t, [checks.greater_than(t, "close_time", "open_time")])
        ),
        "fk_check": _on_both(lambda t, u: foreign_keys.check_foreign_key(t, accounts.ACCOUNT, u, accounts.ACCOUNT)),
        "fk_mismatches": _on_both_lineitem(
            lambda t, u: foreign_keys.foreign_key_mismatches(t, accounts.ACCOUNT, u, accounts.ACCOUNT)
        ),
        # Suites and gate
        "qa_users_suite": _on_users(suites.users_suite),
        "qa_trades_suite": _on_lineitem_trades(suites.trades_suite),
        "qa_users_nulls": _on_users(suites.users_null_status),
        "qa_trades_nulls": _on_lineitem_trades(suites.trades_null_status),
        "qa_cross_reference":_on_both(suites.cross_reference),
        "qa_full_report": _on_both(lambda t, u: suites.full_report(u, t)),
        "preload_accepted": _on_both(lambda t, u: gate.accepted(gate.gate_trades(t, u))),
        "preload_rejected": _on_both(lambda t, u: _rejected_text(gate.gate_trades(t, u))),
        "preload_new_accepted": _on_both(lambda t, u: gate.accepted(_gated_delivery(t, u))),
        "preload_new_rejected": _on_both(lambda t, u: _rejected_text(_gated_delivery(t, u))),
        "load_verdicts": _on_both_lineitem(_load_verdicts),
        "load_nulls": _on_both(_load_nulls),
        "preload_users_accepted": _on_users(lambda users: gate.accepted(gate.gate_users(users))),
        "preload_users_rejected": _on_users(lambda users: _rejected_text(gate.gate_users(users))),
    }
    plain = {name: _plain(query) for name, query in named.items()}
    if llm_queries:
        plain |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return plain


def oracle_sql() -> dict[str, str]:
    """The SQL whose result each query must equal, as multisets of rows."""
    return ORACLE_SQL | (llm_queries.oracle_sql() if llm_queries else {})


def entry(spark: SparkSession) -> DataFrame:
    """The trading report on the smallest tables."""
    return queries()["trading_report"](spark, SMALLEST)
