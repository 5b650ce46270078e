"""DuckDB SQL for every query, written in the plainest form: windows, pairwise date joins, EXCEPT.

None of the plans under ``tallyline`` is repeated here, so agreement of the two says something.
"""

from __future__ import annotations

from collections.abc import Callable

USERS = """
users AS (
  SELECT
    CASE WHEN c_custkey % 50 = 7 THEN md5('moved-' || CAST(c_custkey AS VARCHAR))
         ELSE md5(CAST(c_custkey // 3 AS VARCHAR)) END AS login_hash,
    md5('s' || CAST(c_custkey % 3 AS VARCHAR)) AS server_hash,
    CASE WHEN c_nationkey <> 24 THEN md5(n_name) END AS country_hash,
    unnest([home]
      || CASE WHEN c_custkey % 10 = 0 THEN [home] ELSE [] END
      || CASE WHEN c_custkey % 97 = 0 THEN ['CHF'] ELSE [] END) AS currency,
    CAST(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS INTEGER) AS enable
  FROM (
    SELECT customer.*, n_name,
      CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'JPY' WHEN 3 THEN 'GBP' ELSE 'AUD' END AS home
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  )
)"""

EVENT_TRADES = """
trades AS (
  SELECT
    md5(CAST(user_id // 3 AS VARCHAR)) AS login_hash,
    md5(CAST(event_id AS VARCHAR)) AS ticket_hash,
    md5('s' || CAST(user_id % 3 AS VARCHAR)) AS server_hash,
    CASE WHEN event_id % 41 <> 0 THEN event_type END AS symbol,
    CAST(event_id % 4 AS INTEGER) AS digits,
    CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS INTEGER) AS cmd,
    CAST(value AS DECIMAL(18,2)) AS volume,
    ts - to_minutes(event_id % 7 - 1) AS open_time,
    value AS open_price,
    CAST(100000 AS BIGINT) AS contractsize,
    CASE WHEN event_id % 29 <> 0 THEN ts END AS close_time
  FROM (
    SELECT events.*, unnest(range(CASE WHEN event_id % 100 = 0 THEN 2 ELSE 1 END)) AS copy FROM events
  )
)"""

LINEITEM_TRADES = """
trades AS (
  SELECT
    md5(CAST(o_custkey // 3 AS VARCHAR)) AS login_hash,
    md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)) AS ticket_hash,
    md5('s' || CAST(o_custkey % 3 AS VARCHAR)) AS server_hash,
    CASE WHEN l_partkey % 41 <> 0 THEN l_returnflag || l_linestatus END AS symbol,
    CAST(l_linenumber % 4 AS INTEGER) AS digits,
    CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS cmd,
    CAST(l_quantity - 1 AS DECIMAL(18,2)) AS volume,
    o_orderdate AS open_time,
    l_extendedprice AS open_price,
    CAST(100000 AS BIGINT) AS contractsize,
    CASE WHEN l_linenumber <> 7 THEN l_shipdate + to_hours(l_partkey % 24) END AS close_time
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

JOINED = """
joined AS (
  SELECT trades.*, u.currency
  FROM trades
  JOIN (SELECT DISTINCT * FROM users) AS u
    ON trades.login_hash = u.login_hash AND trades.server_hash = u.server_hash
  WHERE u.enable = 1 AND trades.open_time < trades.close_time
)"""

EVENT_RANGE = ("2024-01-08", "2024-01-25", "2024-01-10", "2024-01-16", "sum_volume_2024_01")
LINEITEM_RANGE = ("2001-06-01", "2001-09-30", "2001-08-01", "2001-08-31", "sum_volume_2001_08")


def days(report_range: tuple) -> str:
    return f"""
days AS (
  SELECT CAST(d AS DATE) AS dt_report
  FROM (SELECT unnest(generate_series(DATE '{report_range[0]}', DATE '{report_range[1]}', INTERVAL 1 DAY)) AS d)
)"""


GRID = """
grid AS (
  SELECT * FROM days, (SELECT DISTINCT login_hash, server_hash, symbol, currency FROM joined)
)"""

IN_WINDOW = "CAST(close_time AS DATE) BETWEEN dt_report - 6 AND dt_report"
SO_FAR = "CAST(close_time AS DATE) <= dt_report"


def in_month(report_range: tuple) -> str:
    return f"{SO_FAR} AND CAST(close_time AS DATE) BETWEEN DATE '{report_range[2]}' AND DATE '{report_range[3]}'"


def measure(keys: str, value: str, condition: str) -> str:
    return f"SELECT dt_report, {keys}, {value} FROM days JOIN joined ON {condition} GROUP BY ALL"


KEY = "login_hash, server_hash, symbol"
TOTAL = "CAST(coalesce(sum(volume), 0) AS DOUBLE)"
ROLLING = measure(KEY, f"{TOTAL} AS sum_volume_prev_7d", IN_WINDOW)
CUMULATIVE = measure(KEY, f"{TOTAL} AS sum_volume_prev_all", SO_FAR)
FIRST_TRADE = measure(KEY, "min(close_time) AS date_first_trade", SO_FAR)
BY_SYMBOL = measure("login_hash, symbol", f"{TOTAL} AS sum_volume_symbol_prev_7d", IN_WINDOW)
BY_LOGIN = measure("login_hash", "count(*) AS sum_count_prev_7d", IN_WINDOW)


def calendar(report_range: tuple) -> str:
    return measure(KEY, f"{TOTAL} AS {report_range[4]}", in_month(report_range))


def rank(rows: str, value: str, name: str) -> str:
    return f"""SELECT *, CAST(dense_rank() OVER (PARTITION BY dt_report ORDER BY {value} DESC) AS INTEGER) AS {name}
FROM ({rows})"""


RANK_BY_SYMBOL = rank(BY_SYMBOL, "sum_volume_symbol_prev_7d", "rank_volume_symbol_prev_7d")
RANK_BY_LOGIN = rank(BY_LOGIN, "sum_count_prev_7d", "rank_count_prev_7d")
NUMBER = """row_number() OVER (ORDER BY dt_report NULLS LAST, login_hash NULLS LAST, server_hash NULLS LAST,
  symbol NULLS LAST, currency NULLS LAST)"""


def with_tables(*tables: str) -> str:
    return "WITH " + ",".join(tables) + "\n"


def over_report(select: str, trades: str = EVENT_TRADES, report_range: tuple = EVENT_RANGE) -> str:
    return with_tables(USERS, trades, JOINED, days(report_range), GRID) + select


def summed(keys: str, name: str, condition: str) -> str:
    return measure(keys, f"{TOTAL} AS {name}", condition)


def attached(report_range: tuple, total: Callable[[str, str, str], str] = summed) -> str:
    month = report_range[4]
    return f"""SELECT dt_report, login_hash, server_hash, symbol, currency,
  coalesce(sum_volume_prev_7d, 0) AS sum_volume_prev_7d,
  coalesce(sum_volume_prev_all, 0) AS sum_volume_prev_all,
  coalesce({month}, 0) AS {month},
  date_first_trade
FROM grid
LEFT JOIN ({total(KEY, "sum_volume_prev_7d", IN_WINDOW)}) USING (dt_report, {KEY})
LEFT JOIN ({total(KEY, "sum_volume_prev_all", SO_FAR)}) USING (dt_report, {KEY})
LEFT JOIN ({total(KEY, month, in_month(report_range))}) USING (dt_report, {KEY})
LEFT JOIN ({FIRST_TRADE}) USING (dt_report, {KEY})"""


def report(trades: str, report_range: tuple, total: Callable[[str, str, str], str] = summed) -> str:
    by_symbol = rank(total("login_hash, symbol", "sum_volume_symbol_prev_7d", IN_WINDOW), "sum_volume_symbol_prev_7d", "rank_volume_symbol_prev_7d")
    select = f"""SELECT
  {NUMBER} AS id,
  strftime(dt_report, '%Y-%m-%d') AS dt_report,
  login_hash, server_hash, symbol, currency,
  sum_volume_prev_7d, sum_volume_prev_all,
  coalesce(rank_volume_symbol_prev_7d, 0) AS rank_volume_symbol_prev_7d,
  coalesce(rank_count_prev_7d, 0) AS rank_count_prev_7d,
  {report_range[4]},
  date_first_trade,
  {NUMBER} AS row_number
FROM ({attached(report_range, total)}) AS measured
LEFT JOIN ({by_symbol}) USING (dt_report, login_hash, symbol)
LEFT JOIN ({RANK_BY_LOGIN}) USING (dt_report, login_hash)
ORDER BY row_number DESC"""
    return over_report(select, trades, report_range)


# Fixed value: every price of the trades is a whole multiple of 2 to the minus 59.
SCALE = 59
DOUBLE_TRADES = EVENT_TRADES.replace("CAST(value AS DECIMAL(18,2)) AS volume", "value AS volume")


def exact_measure(keys: str, name: str, condition: str) -> str:
    """The sum of volumes that are doubles, as whole numbers, rounded once to the nearest double with ties to even."""
    return f"""SELECT dt_report, {keys},
  CAST(CAST(upper + CASE WHEN rest * 2 > size OR (rest * 2 = size AND size > 1 AND upper % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) AS DOUBLE)
    * pow(2.0, places - {SCALE}) AS {name}
FROM (
  SELECT *, whole >> places AS upper, CAST(1 AS HUGEINT) << places AS size, whole - ((whole >> places) << places) AS rest
  FROM (
    SELECT *, CAST(greatest(length(bin(whole)) - 53, 0) AS INTEGER) AS places
    FROM (SELECT dt_report, {keys}, sum(CAST(volume * {2.0**SCALE:.1f} AS HUGEINT)) AS whole FROM days JOIN joined ON {condition} GROUP BY ALL)
  )
)"""


def double_report(select: str) -> str:
    return over_report(select, DOUBLE_TRADES)


EXACT_BY_SYMBOL = exact_measure("login_hash, symbol", "sum_volume_symbol_prev_7d", IN_WINDOW)
EXACT_ROLLING = exact_measure(KEY, "sum_volume_prev_7d", IN_WINDOW)
EXACT_CUMULATIVE = exact_measure(KEY, "sum_volume_prev_all", SO_FAR)


def trade_days(condition: str) -> str:
    return over_report(f"""SELECT dt_report, ticket_hash, login_hash, server_hash, symbol, close_time, currency
FROM days JOIN joined ON {condition}""")


def digested(pairs: str) -> str:
    """The pairs of a day and a trade, summed up."""
    return over_report(f"""SELECT dt_report, login_hash, symbol, currency, count(*) AS trades,
  CAST(sum(volume) AS DOUBLE) AS volume, min(ticket_hash) AS first_ticket, max(ticket_hash) AS last_ticket,
  min(close_time) AS first_close, max(close_time) AS last_close
FROM {pairs} GROUP BY dt_report, login_hash, symbol, currency""")


WINDOW_TOTALS = """count(*) AS trades, CAST(sum(volume) AS DOUBLE) AS volume,
  min(close_time) AS first_close, max(close_time) AS last_close"""


def on_trades(select: str) -> str:
    return with_tables(EVENT_TRADES) + select


def on_lineitem_trades(select: str) -> str:
    return with_tables(LINEITEM_TRADES) + select


def on_users(select: str) -> str:
    return with_tables(USERS) + select


def on_both(select: str) -> str:
    return with_tables(USERS, EVENT_TRADES) + select


# The key and the columns of the tables, and the columns that must be filled.
TRADES_KEY = "login_hash, ticket_hash, server_hash, open_time"
ALL_TRADES = "login_hash, ticket_hash, server_hash, symbol, digits, cmd, volume, open_time, open_price, contractsize, close_time"
ALL_USERS = "login_hash, server_hash, country_hash, currency, enable"
FIRST_OF_KEY = (
    "close_time NULLS FIRST, symbol NULLS FIRST, digits NULLS FIRST, cmd NULLS FIRST, volume NULLS FIRST, "
    "open_price NULLS FIRST, contractsize NULLS FIRST"
)
LAST_OF_KEY = FIRST_OF_KEY.replace("NULLS FIRST", "DESC NULLS LAST")
ARRIVAL = "open_price, " + ", ".join(f"{name} NULLS FIRST" for name in ("symbol", "digits", "cmd", "volume", "contractsize", "close_time"))
ARRIVAL_LAST = ARRIVAL.replace("open_price", "open_price DESC").replace("NULLS FIRST", "DESC NULLS LAST")
DUPLICATE = {
    "first": f"row_number() OVER (PARTITION BY {TRADES_KEY} ORDER BY {FIRST_OF_KEY}) > 1",
    "last": f"row_number() OVER (PARTITION BY {TRADES_KEY} ORDER BY {LAST_OF_KEY}) > 1",
    "keep_none": f"count(*) OVER (PARTITION BY {TRADES_KEY}) > 1",
}


def copies(keys: str, table: str) -> str:
    """Rows beyond the first of each group."""
    return f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS bad FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys})"


def check(name: str, columns: str, bad_rows: str, passed: str = "bad = 0") -> str:
    """One report row; ``bad_rows`` is a query for one number ``bad``."""
    return f"""SELECT '{name}' AS "check", '{columns}' AS columns, {passed} AS passed, bad AS bad_rows FROM ({bad_rows})"""


def broken(table: str, rule: str) -> str:
    return f"SELECT count(*) AS bad FROM {table} WHERE {rule}"


def binary(table: str, column: str) -> str:
    return check("binary", column, broken(table, f"coalesce({column} NOT IN (0, 1), true)"))


def any_null(columns: str) -> str:
    return " OR ".join(f"{name} IS NULL" for name in columns.split(", "))


def mandatory(table: str, columns: str) -> str:
    return check("mandatory", columns.replace(", ", ","), broken(table, any_null(columns)))


def null_status(table: str, columns: str) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{name}' AS "column", count(*) > count({name}) AS has_null, count(*) - count({name}) AS null_rows FROM {table}"""
        for name in columns.split(", ")
    )


def typed(name: str, column: str) -> str:
    return check(name, column, "SELECT 0 AS bad")


def untyped(name: str, column: str) -> str:
    return check(name, column, f"SELECT count({column}) AS bad FROM trades", "false")


def greater_than_zero(table: str, column: str) -> str:
    return check("greater than zero", column, broken(table, f"coalesce(NOT {column} > 0, true)"))


CLOSED_AFTER_OPENED = check(
    "greater than", "close_time,open_time", broken("trades", "coalesce(NOT close_time > open_time, true)")
)
# The columns of a trade that must be filled.
TRADES_MANDATORY = "login_hash, ticket_hash, server_hash, symbol, digits, cmd, volume, open_time, open_price, contractsize"
MISMATCHES = "SELECT login_hash, server_hash FROM trades EXCEPT SELECT login_hash, server_hash FROM users"
FOREIGN_KEY = check("foreign key", "login_hash,server_hash", f"SELECT count(*) AS bad FROM ({MISMATCHES})")


def suite(name: str, results: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS suite, CAST({i} AS INTEGER) AS seq, * FROM ({result})" for i, result in enumerate(results, 1)
    )


USERS_SUITE = suite(
    "users",
    [
        check("duplicates", ALL_USERS.replace(", ", ","), copies(ALL_USERS, "users")),
        binary("users", "enable"),
        mandatory("users", ALL_USERS),
    ],
)
TRADES_SUITE = suite(
    "trades",
    [
        check("duplicates", ALL_TRADES.replace(", ", ","), copies(ALL_TRADES, "trades")),
        check("duplicates", TRADES_KEY.replace(", ", ","), copies(TRADES_KEY, "trades")),
        typed("numerical", "digits"),
        typed("numerical", "cmd"),
        typed("numerical", "volume"),
        binary("trades", "cmd"),
        typed("timestamp", "open_time"),
        typed("timestamp", "close_time"),
        mandatory("trades", TRADES_MANDATORY),
        greater_than_zero("trades", "volume"),
        CLOSED_AFTER_OPENED,
    ],
)
CROSS_REFERENCE = suite("cross_reference", [FOREIGN_KEY])


def value_check(name: str, column: str, sql_type: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return check(name, column, broken("trades", f"{column} IS NOT NULL AND TRY_CAST({text} AS {sql_type}) IS NULL"))


def rules(conditions: dict[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in conditions.items()) + ")"


TRADE_RULES = {f"{name} is missing": f"{name} IS NULL" for name in TRADES_MANDATORY.split(", ")} | {
    "cmd is not binary": "cmd NOT IN (0, 1)",
    "volume is not positive": "NOT volume > 0",
    "closed before opened": "NOT close_time > open_time",
    "account is unknown": "(login_hash, server_hash) IN (SELECT (login_hash, server_hash) FROM mismatches)",
    "duplicate": "is_duplicate",
}
USER_RULES = {f"{name} is missing": f"{name} IS NULL" for name in ALL_USERS.split(", ")} | {
    "enable is not binary": "enable NOT IN (0, 1)",
    "duplicate": "is_duplicate",
}
GATED_TRADES = f"""
mismatches AS ({MISMATCHES}),
flagged AS (SELECT *, {DUPLICATE["first"]} AS is_duplicate FROM trades),
gated AS (SELECT {ALL_TRADES}, {rules(TRADE_RULES)} AS broken_rules FROM flagged)"""
# The trades that are stored, and those that a delivery brings.
LOADED_UNTIL, DELIVERED_FROM = "2024-01-17", "2024-01-15"
NEW_TRADE_RULES = TRADE_RULES | {
    "already loaded": "EXISTS (SELECT 1 FROM stored WHERE "
    + " AND ".join(f"stored.{name} IS NOT DISTINCT FROM flagged.{name}" for name in TRADES_KEY.split(", "))
    + ")"
}
GATED_DELIVERY = f"""
stored AS (SELECT {TRADES_KEY} FROM trades WHERE open_time < TIMESTAMP '{LOADED_UNTIL}'),
delivered AS (SELECT * FROM trades WHERE open_time >= TIMESTAMP '{DELIVERED_FROM}'),
mismatches AS ({MISMATCHES.replace("FROM trades", "FROM delivered")}),
flagged AS (SELECT *, {DUPLICATE["first"]} AS is_duplicate FROM delivered),
gated AS (SELECT {ALL_TRADES}, {rules(NEW_TRADE_RULES)} AS broken_rules FROM flagged)"""
GATED_USERS = f"""
flagged AS (SELECT *, row_number() OVER (PARTITION BY {ALL_USERS}) > 1 AS is_duplicate FROM users),
gated AS (SELECT {ALL_USERS}, {rules(USER_RULES)} AS broken_rules FROM flagged)"""
ACCEPTED = "SELECT * EXCLUDE (broken_rules) FROM gated WHERE broken_rules = ''"
REJECTED = "SELECT * FROM gated WHERE broken_rules <> ''"

LINEITEM_REPORT = report(LINEITEM_TRADES, LINEITEM_RANGE)

TYPED_SQL = {
    # Scans and sources
    "scan_users": on_users("SELECT * FROM users"),
    "scan_trades": on_trades("SELECT * FROM trades"),
    "scan_lineitem_trades": on_lineitem_trades("SELECT * FROM trades"),
    "run_query_params": on_trades(
        "SELECT login_hash, server_hash, count(*) AS trades, CAST(sum(volume) AS DOUBLE) AS volume "
        "FROM trades WHERE cmd = 1 AND volume > 10 GROUP BY login_hash, server_hash"
    ),
    "run_query_params_by_position": on_trades(
        "SELECT symbol, count(*) AS trades, max(close_time) AS last_close FROM trades "
        "WHERE close_time >= TIMESTAMP '2024-01-10' AND coalesce(symbol, 'none') <> 'login' GROUP BY symbol"
    ),
    "date_series": on_trades("""SELECT d.dt_report, count(trades.ticket_hash) AS trades
FROM (
  SELECT CAST(unnest(generate_series(min(CAST(close_time AS DATE)), max(CAST(close_time AS DATE)), INTERVAL 1 DAY)) AS DATE)
    AS dt_report
  FROM trades
) AS d
LEFT JOIN trades ON CAST(trades.close_time AS DATE) = d.dt_report
GROUP BY d.dt_report"""),
    # Filters and predicates
    "enabled_users": on_users("SELECT * FROM users WHERE enable = 1"),
    "valid_trades": on_trades("SELECT * FROM trades WHERE open_time < close_time"),
    "closed_trades": on_trades("SELECT * FROM trades WHERE close_time IS NOT NULL"),
    "rolling_predicate": trade_days(IN_WINDOW),
    "cumulative_predicate": digested(f"days JOIN joined ON {SO_FAR}"),
    "calendar_predicate": digested(f"days JOIN joined ON {in_month(EVENT_RANGE)}"),
    "report_scalars": on_trades("""SELECT
  ticket_hash,
  CAST(coalesce(volume, 0) AS DOUBLE) AS volume_or_zero,
  CAST(coalesce(CASE WHEN cmd = 1 THEN volume END, 0) AS DOUBLE) AS cmd_volume_or_zero,
  CAST(close_time AS DATE) AS close_day,
  CAST(CAST(close_time AS DATE) - INTERVAL 7 DAY AS DATE) AS window_opens_after,
  strftime(close_time, '%Y-%m-%d') AS close_day_text,
  CAST(contractsize AS INTEGER) AS contractsize_int,
  CAST(close_time AS TIMESTAMP) AS close_timestamp,
  CAST(close_time AS DATE) >= DATE '2024-01-10' AS on_or_after,
  CAST(close_time AS DATE) <= DATE '2024-01-16' AND volume > 100 AS before_and_large
FROM trades"""),
    # Joins
    "distinct_users": on_users("SELECT DISTINCT * FROM users"),
    "trades_with_users": over_report("SELECT * FROM joined"),
    "combined_data": digested("days CROSS JOIN joined"),
    "range_join_7d": over_report(f"""SELECT dt_report, symbol, count(*) AS trades, CAST(sum(volume) AS DOUBLE) AS volume
FROM days JOIN joined ON {IN_WINDOW} GROUP BY dt_report, symbol"""),
    "range_join_90d": over_report(
        f"""SELECT dt_report, currency, {WINDOW_TOTALS} FROM days JOIN joined
ON CAST(close_time AS DATE) > dt_report - 90 AND CAST(close_time AS DATE) <= dt_report GROUP BY dt_report, currency""",
        LINEITEM_TRADES,
        LINEITEM_RANGE,
    ),
    "window_join_36h": over_report(f"""SELECT instant, symbol, {WINDOW_TOTALS}
FROM (
  SELECT unnest(generate_series(TIMESTAMP '{EVENT_RANGE[0]}', TIMESTAMP '{EVENT_RANGE[1]}', INTERVAL 6 HOUR)) AS instant
) JOIN joined ON close_time > instant - INTERVAL 36 HOUR AND close_time <= instant GROUP BY instant, symbol"""),
    "account_window_join_36h": over_report("""SELECT o.login_hash, o.server_hash, opened, count(*) AS trades, CAST(sum(volume) AS DOUBLE) AS volume
FROM (SELECT DISTINCT login_hash, server_hash, open_time AS opened FROM trades) AS o
JOIN joined ON o.login_hash = joined.login_hash AND o.server_hash = joined.server_hash
  AND close_time > opened - INTERVAL 36 HOUR AND close_time <= opened
GROUP BY o.login_hash, o.server_hash, opened"""),
    "spine_left_join": over_report(attached(EVENT_RANGE)),
    "rank_join_symbol": over_report(f"""SELECT grid.*, coalesce(rank_volume_symbol_prev_7d, 0) AS rank_volume_symbol_prev_7d
FROM grid LEFT JOIN ({RANK_BY_SYMBOL}) USING (dt_report, login_hash, symbol)"""),
    "rank_join_login": over_report(f"""SELECT grid.*, coalesce(rank_count_prev_7d, 0) AS rank_count_prev_7d
FROM grid LEFT JOIN ({RANK_BY_LOGIN}) USING (dt_report, login_hash)"""),
    # Grid and measures
    "report_grid": over_report("SELECT * FROM grid"),
    "sum_volume_prev_7d": over_report(ROLLING),
    "sum_volume_prev_all": over_report(CUMULATIVE),
    "sum_volume_symbol_prev_7d": over_report(BY_SYMBOL),
    "sum_volume_prev_7d_double": double_report(EXACT_ROLLING),
    "sum_volume_prev_all_double": double_report(EXACT_CUMULATIVE),
    "sum_volume_symbol_prev_7d_double": double_report(EXACT_BY_SYMBOL),
    "rank_volume_symbol_prev_7d_double": double_report(
        rank(EXACT_BY_SYMBOL, "sum_volume_symbol_prev_7d", "rank_volume_symbol_prev_7d")
    ),
    "trading_report_double": report(DOUBLE_TRADES, EVENT_RANGE, exact_measure),
    "sum_count_prev_7d": over_report(BY_LOGIN),
    "sum_volume_month": over_report(calendar(EVENT_RANGE)),
    "date_first_trade": over_report(FIRST_TRADE),
    # Ranks and numbers
    "rank_volume_symbol_prev_7d": over_report(RANK_BY_SYMBOL),
    "rank_count_prev_7d": over_report(RANK_BY_LOGIN),
    "report_row_number": over_report(f"SELECT *, {NUMBER} AS row_number FROM grid"),
    "report_serial_id": over_report(f"SELECT *, {NUMBER} AS id FROM grid"),
    # The report
    "trading_report": report(EVENT_TRADES, EVENT_RANGE),
    "compact_report": report(EVENT_TRADES, EVENT_RANGE),
    "compact_report_day": f"SELECT * FROM ({report(EVENT_TRADES, EVENT_RANGE)}) WHERE dt_report = '2024-01-20'",
    "compact_report_week_chf": f"""SELECT * FROM ({report(EVENT_TRADES, EVENT_RANGE)})
WHERE dt_report BETWEEN '2024-01-12' AND '2024-01-18' AND currency = 'CHF'""",
    "trading_report_refreshed": report(EVENT_TRADES, EVENT_RANGE),
    "trading_report_122d_digest": f"""SELECT dt_report, symbol, currency,
  count(*) AS report_rows,
  CAST(sum(row_number) AS BIGINT) AS row_numbers,
  min(row_number) AS first_row,
  max(row_number) AS last_row,
  sum(sum_volume_prev_7d) AS sum_volume_prev_7d,
  sum(sum_volume_prev_all) AS sum_volume_prev_all,
  sum({LINEITEM_RANGE[4]}) AS {LINEITEM_RANGE[4]},
  CAST(sum(rank_volume_symbol_prev_7d) AS BIGINT) AS volume_ranks,
  CAST(sum(rank_count_prev_7d) AS BIGINT) AS count_ranks,
  count(date_first_trade) AS traded,
  min(date_first_trade) AS date_first_trade
FROM ({LINEITEM_REPORT}) GROUP BY dt_report, symbol, currency""",
    # Duplicates
    "dup_count_all": on_trades(f"SELECT bad AS duplicates FROM ({copies(ALL_TRADES, 'trades')})"),
    "dup_count_subset": on_users(f"SELECT bad AS duplicates FROM ({copies('login_hash, server_hash', 'users')})"),
    "dup_count_keep_none": on_lineitem_trades(
        f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM trades GROUP BY {TRADES_KEY}) WHERE n > 1"""
    ),
    **{
        f"dup_flags_{keep}": on_lineitem_trades(f"SELECT *, {flag} AS is_duplicate FROM trades")
        for keep, flag in DUPLICATE.items()
    },
    **{
        f"dedup_drop_{keep}": on_lineitem_trades(f"SELECT * FROM trades QUALIFY NOT ({flag})")
        for keep, flag in DUPLICATE.items()
    },
    "dup_flags_first_arrival": on_lineitem_trades(
        f"SELECT *, row_number() OVER (PARTITION BY {TRADES_KEY} ORDER BY {ARRIVAL}) > 1 AS is_duplicate FROM trades"
    ),
    "dedup_drop_last_arrival": on_lineitem_trades(
        f"SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY {TRADES_KEY} ORDER BY {ARRIVAL_LAST}) = 1"
    ),
    "dedup_whole_rows": on_trades("SELECT DISTINCT * FROM trades"),
    # Checks
    "check_binary": on_trades(
        "\nUNION ALL ".join(
            [
                binary("trades", "cmd"),
                binary("trades", "digits"),
                check("binary", "symbol", "SELECT count(*) AS bad FROM trades"),
            ]
        )
    ),
    "check_numerical": on_trades(
        "\nUNION ALL ".join(
            [typed("numerical", name) for name in ("digits", "cmd", "volume")] + [untyped("numerical", "symbol")]
        )
    ),
    "check_numerical_values": on_trades(
        "\nUNION ALL ".join(
            value_check("numerical", name, "DOUBLE")
            for name in ("symbol", "digits", "volume", "open_time", "close_time")
        )
    ),
    "check_timestamp": on_trades(
        "\nUNION ALL ".join(
            [typed("timestamp", "open_time"), typed("timestamp", "close_time"), untyped("timestamp", "symbol")]
        )
    ),
    "check_timestamp_values": on_trades(
        "\nUNION ALL ".join(value_check("timestamp", name, "TIMESTAMP") for name in ("symbol", "open_time", "close_time"))
    ),
    "check_mandatory": on_trades(null_status("trades", TRADES_MANDATORY)),
    "check_mandatory_all_columns": on_users(null_status("users", ALL_USERS)),
    "check_gt_zero": on_lineitem_trades(
        greater_than_zero("trades", "volume") + "\nUNION ALL " + greater_than_zero("trades", "open_price")
    ),
    "check_gt_column": on_trades(CLOSED_AFTER_OPENED),
    "fk_check": on_both(FOREIGN_KEY),
    "fk_mismatches": with_tables(USERS, LINEITEM_TRADES) + MISMATCHES,
    # Suites and gate
    "qa_users_suite": on_users(USERS_SUITE),
    "qa_trades_suite": on_lineitem_trades(TRADES_SUITE),
    "qa_users_nulls": on_users(f"SELECT 'users' AS suite, * FROM ({null_status('users', ALL_USERS)})"),
    "qa_trades_nulls": on_lineitem_trades(
        f"SELECT 'trades' AS suite, * FROM ({null_status('trades', TRADES_MANDATORY)})"
    ),
    "qa_cross_reference": on_both(CROSS_REFERENCE),
    "qa_full_report": on_both(f"{USERS_SUITE}\nUNION ALL {TRADES_SUITE}\nUNION ALL {CROSS_REFERENCE}"),
    "preload_accepted": with_tables(USERS, EVENT_TRADES, GATED_TRADES) + ACCEPTED,
    "preload_rejected": with_tables(USERS, EVENT_TRADES, GATED_TRADES) + REJECTED,
    "preload_new_accepted": with_tables(USERS, EVENT_TRADES, GATED_DELIVERY) + ACCEPTED,
    "preload_new_rejected": with_tables(USERS, EVENT_TRADES, GATED_DELIVERY) + REJECTED,
    "load_verdicts": on_lineitem_trades(f"SELECT * FROM ({TRADES_SUITE}) WHERE seq > 2"),
    "load_nulls": on_trades(f"SELECT 'trades' AS suite, * FROM ({null_status('trades', TRADES_MANDATORY)})"),
    "preload_users_accepted": with_tables(USERS, GATED_USERS) + ACCEPTED,
    "preload_users_rejected": with_tables(USERS, GATED_USERS) + REJECTED,
}

# Columns that the queries return as doubles or text instead of decimals or dates.
DECIMALS = {
    "volume": [
        "scan_trades",
        "scan_lineitem_trades",
        "valid_trades",
        "closed_trades",
        "trades_with_users",
        *[f"dup_flags_{keep}" for keep in DUPLICATE],
        *[f"dedup_drop_{keep}" for keep in DUPLICATE],
        "dup_flags_first_arrival",
        "dedup_drop_last_arrival",
        "dedup_whole_rows",
        "preload_accepted",
        "preload_rejected",
        "preload_new_accepted",
        "preload_new_rejected",
    ]
}
DATES = {
    "dt_report": [
        "date_series",
        "rolling_predicate",
        "cumulative_predicate",
        "calendar_predicate",
        "combined_data",
        "range_join_7d",
        "range_join_90d",
        "spine_left_join",
        "rank_join_symbol",
        "rank_join_login",
        "report_grid",
        "sum_volume_prev_7d",
        "sum_volume_prev_all",
        "sum_volume_symbol_prev_7d",
        "sum_volume_prev_7d_double",
        "sum_volume_prev_all_double",
        "sum_volume_symbol_prev_7d_double",
        "rank_volume_symbol_prev_7d_double",
        "sum_count_prev_7d",
        "sum_volume_month",
        "date_first_trade",
        "rank_volume_symbol_prev_7d",
        "rank_count_prev_7d",
        "report_row_number",
        "report_serial_id",
    ],
    "close_day": ["report_scalars"],
    "window_opens_after": ["report_scalars"],
}


def plain(name: str, sql: str) -> str:
    casts = [f"CAST({c} AS DOUBLE) AS {c}" for c, queries in DECIMALS.items() if name in queries]
    casts += [f"CAST({c} AS VARCHAR) AS {c}" for c, queries in DATES.items() if name in queries]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM (\n{sql}\n)" if casts else sql


ORACLE_SQL = {name: plain(name, sql) for name, sql in TYPED_SQL.items()}
