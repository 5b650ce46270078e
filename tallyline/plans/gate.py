"""Validation before loading: rows that keep every rule are accepted, the others set aside."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyline.functions.columns import is_binary, is_greater, is_missing, require_columns
from tallyline.operators.accounts import ACCOUNT
from tallyline.operators.duplicates import flag_duplicates
from tallyline.operators.foreign_keys import foreign_key_mismatches
from tallyline.operators.loaded import keys_already_loaded
from tallyline.plans.suites import TRADES_KEY, TRADES_MANDATORY, USERS_MANDATORY, Suite, trades_rules, users_rules
from tallyline.sources.staging import stage

UNKNOWN_ACCOUNT = "unknown_account__"
LOADED = "already_loaded__"
STILL_OPEN = "still_open__"


def _broken_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules whose condition holds."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def gate_users(users: DataFrame) -> DataFrame:
    """Users with ``broken_rules``."""
    require_columns(users, USERS_MANDATORY, "users table")
    flagged = flag_duplicates(users)
    rules = {f"{name} is missing": is_missing(users, name) for name in USERS_MANDATORY}
    rules["enable is not binary"] = F.col("enable").isNotNull() & ~is_binary(users, "enable")
    rules["duplicate"] = F.col("is_duplicate")
    return flagged.select(*users.columns, _broken_rules(rules).alias("broken_rules"))


def _marked(rows: DataFrame, keys: list[str], found: DataFrame, mark: str) -> DataFrame:
    """The rows with ``mark``: whether their key is among the distinct keys ``found``. Null equals null."""
    named = found.select(*[F.col(name).alias(f"{mark}{name}") for name in keys], F.lit(True).alias(mark))
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"{mark}{name}")) for name in keys])
    return rows.join(named, same, "left").withColumn(mark, F.coalesce(mark, F.lit(False))).select(*rows.columns, mark)


def gate_trades(trades: DataFrame, users: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """Trades with ``broken_rules``.

    A trade without a close time is still open and breaks no rule by that. Of the trades with one
    key the one that closed first is kept, or an open one if none has closed. Account keys that no user has are found among distinct keys
    first; usually few, they are then broadcast to the trades. With the table of the trades that are ``loaded``, so are the keys that it
    holds already (``operators.loaded``).
    """
    require_columns(trades, [*TRADES_MANDATORY, "close_time"], "trades table")
    unknown = stage(foreign_key_mismatches(trades, ACCOUNT, users, ACCOUNT), "unknown-accounts")
    # An open trade sorts after every closed one.
    in_order = trades.withColumn(STILL_OPEN, F.col("close_time").isNull())
    flagged = flag_duplicates(in_order, TRADES_KEY, "first", order_by=[STILL_OPEN, "close_time"])
    checked = _marked(flagged, ACCOUNT, unknown, UNKNOWN_ACCOUNT)
    rules = {f"{name} is missing": is_missing(trades, name) for name in TRADES_MANDATORY}
    rules |= {
        "cmd is not binary": F.col("cmd").isNotNull() & ~is_binary(trades, "cmd"),
        "volume is not positive": F.col("volume").isNotNull() & ~is_greater(trades, "volume"),
        "closed before opened": F.col("close_time").isNotNull()
        & F.col("open_time").isNotNull()
        & ~is_greater(trades, "close_time", "open_time"),
        "account is unknown": F.col(UNKNOWN_ACCOUNT),
        "duplicate": F.col("is_duplicate"),
    }
    if loaded is not None:
        checked = _marked(checked, TRADES_KEY, keys_already_loaded(trades, loaded, TRADES_KEY), LOADED)
        rules["already loaded"] = F.col(LOADED)
    return checked.select(*trades.columns, _broken_rules(rules).alias("broken_rules"))


def accepted(gated: DataFrame) -> DataFrame:
    """Rows that break no rule, ready to load."""
    return gated.filter(F.size("broken_rules") == 0).drop("broken_rules")


def rejected(gated: DataFrame) -> DataFrame:
    """Rows that break a rule, with the names of the rules."""
    return gated.filter(F.size("broken_rules") > 0)


def write_gated(gated: DataFrame, path: str) -> None:
    """Write accepted and rejected rows in one pass, as directories ``accepted=true`` and ``accepted=false``.

    The files are compressed by zstd, which halves hashes spelled as text.
    """
    gated.withColumn("accepted", F.size("broken_rules") == 0).write.partitionBy("accepted").parquet(path, compression="zstd")


@dataclass(frozen=True)
class Load:
    """What a load wrote, and what it saw on the way: verdicts of the row-level checks and the missing values of each column."""

    accepted: int
    rejected: int
    verdicts: DataFrame
    null_status: DataFrame


def observed_load(gated: DataFrame, suite: Suite, path: str) -> Load:
    """Write gated rows as ``write_gated`` does, and check them in the same pass.

    The checks are metrics of the rows on their way to the files (``DataFrame.observe``), so that they cost no further scan. ``gated`` holds
    every row of the suite's table once. The verdicts are those of the suite without its duplicates, numbered alike.
    """
    seen = Observation()
    is_accepted = F.size("broken_rules") == 0
    metrics = [*suite.row_metrics(), F.count_if(is_accepted).alias("accepted"), F.count_if(~is_accepted).alias("rejected")]
    write_gated(gated.observe(seen, *metrics), path)
    counts = {name: int(n or 0) for name, n in seen.get.items()}
    spark = gated.sparkSession
    totals = spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in counts.items()])
    return Load(counts["accepted"], counts["rejected"], suite.row_verdicts(totals), suite.null_status(totals))


def load_trades(trades: DataFrame, users: DataFrame, path: str, loaded: DataFrame | None = None) -> Load:
    """Gate a delivery of trades, write both parts, and return the verdicts and missing values of the same pass."""
    return observed_load(gate_trades(trades, users, loaded), trades_rules(trades), path)


def load_users(users: DataFrame, path: str) -> Load:
    """As ``load_trades``, for users."""
    return observed_load(gate_users(users), users_rules(users), path)
