from __future__ import annotations

import random

import pytest

from tallyline.operators import loaded
from tallyline.plans import gate, suites
from tallyline.sources import sample_tables
from tests.test_plans import SF_DIR, plan
from tests.tables import at, trade, trades_table, user, users_table

USERS = [user("a"), user("b"), user("b"), user("c", country=None)]


def test_trades_are_accepted_or_named_what_they_break(spark):
    trades = [
        trade("a", at("2024-01-02"), ticket="good"),
        trade("a", None, ticket="open"),
        trade("a", at("2024-01-02"), symbol=None, ticket="no symbol"),
        trade("a", at("2024-01-02"), 0, ticket="no volume"),
        trade("a", at("1999-01-02"), ticket="time"),
        trade("x", at("2024-01-02"), ticket="stranger"),
        trade(None, at("2024-01-02"), None, ticket="nobody"),
        trade("b", at("2024-01-02"), 1, ticket="twice"),
        trade("b", at("2024-01-02"), 1, ticket="twice"),
        trade("b", at("2024-01-03"), 2, ticket="twice"),
    ]
    gated = gate.gate_trades(trades_table(spark, trades), users_table(spark, USERS))
    rows = {(r.ticket_hash, r.volume, r.close_time, tuple(r.broken_rules)) for r in gated.collect()}
    rules = sorted((ticket, broken) for ticket, _, _, broken in rows)
    assert rules == [
        ("good", ()),
        ("no symbol", ("symbol is missing",)),
        ("no volume", ("volume is not positive",)),
        ("nobody", ("login_hash is missing", "volume is missing", "account is unknown")),
        ("open", ()),
        ("stranger", ("account is unknown",)),
        ("time", ("closed before opened",)),
        ("twice", ()),
        ("twice", ("duplicate",)),
        ("twice", ("duplicate",)),
    ]
    assert gate.accepted(gated).columns == gated.columns[:-1]
    assert (gate.accepted(gated).count(), gate.rejected(gated).count()) == (3, 7)


def test_users(spark):
    gated = gate.gate_users(users_table(spark, [*USERS, user("d", enable=2)]))
    rules = sorted((r.login_hash, tuple(r.broken_rules)) for r in gated.collect())
    assert rules == [
        ("a", ()),
        ("b", ()),
        ("b", ("duplicate",)),
        ("c", ("country_hash is missing",)),
        ("d", ("enable is not binary",)),
    ]


def test_both_parts_are_written_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "users")
    gate.write_gated(gate.gate_users(users_table(spark, USERS)), path)
    assert spark.read.parquet(f"{path}/accepted=true").count() == 2
    assert spark.read.parquet(f"{path}/accepted=false").count() == 2


@pytest.mark.parametrize("bits", [loaded.MOST_BITS, 0])
def test_trades_that_are_loaded_already(spark, monkeypatch, bits):
    """With the filter of the incoming keys and, beyond its size, without."""
    monkeypatch.setattr(loaded, "MOST_BITS", bits)
    stored = [trade("a", at("2024-01-02"), 5, ticket="old"), trade("b", at("2024-01-02"), ticket=None), trade("a", None, ticket="open")]
    stored += [trade(f"l{i}", at("2024-01-02"), ticket=str(i)) for i in range(200)]
    incoming = [
        trade("a", at("2024-01-09"), 7, ticket="old"),
        trade("a", at("2024-01-02"), ticket="new"),
        trade("b", at("2024-01-02"), ticket="old"),
        trade("b", at("2024-01-02"), ticket=None),
        trade("a", at("2024-01-02"), ticket="open", opened=at("2001-01-01")),
        trade("a", at("2024-01-02"), ticket="open"),
        trade("l7", at("2024-01-02"), ticket="7"),
        trade("l7", at("2024-01-02"), ticket="8"),
    ]
    gated = gate.gate_trades(trades_table(spark, incoming), users_table(spark, USERS), trades_table(spark, stored))
    held = {(r.login_hash, r.ticket_hash, r.open_time.year) for r in gated.collect() if "already loaded" in r.broken_rules}
    assert held == {("a", "old", 2000), ("b", None, 2000), ("a", "open", 2000), ("l7", "7", 2000)}
    assert gated.count() == len(incoming)
    nothing = gate.gate_trades(trades_table(spark, incoming), users_table(spark, USERS), trades_table(spark, []))
    assert not [r for r in nothing.collect() if "already loaded" in r.broken_rules]


def test_loaded_keys_of_random_tables(spark):
    rng = random.Random(1)

    def rows(n):
        return [(rng.choice([None, *range(40)]), rng.choice(["x", "y", None])) for _ in range(n)]

    a, b = rows(60), rows(300)[:200]
    incoming = spark.createDataFrame(a, "n int, s string")
    stored = spark.createDataFrame([(None if n is None else n, s, 1) for n, s in b], "n long, s string, other int")
    found = [(r.n, r.s) for r in loaded.keys_already_loaded(incoming, stored, ["n", "s"]).collect()]
    assert sorted(found, key=str) == sorted(set(a) & set(b), key=str)
    wrong = spark.createDataFrame([("1", "x")], "n string, s string")
    with pytest.raises(ValueError):
        loaded.keys_already_loaded(incoming, wrong, ["n", "s"])


def test_only_key_columns_of_what_passes_the_filter_are_shuffled(spark, monkeypatch):
    plans = []
    stage = loaded.stage
    monkeypatch.setattr(loaded, "stage", lambda df, label: plans.append((label, plan(df))) or stage(df, label))
    trades = stage(sample_tables.event_trades(spark, SF_DIR), "stored")
    loaded.keys_already_loaded(trades.limit(20), trades, suites.TRADES_KEY)
    text = dict(plans)["loaded-keys"]
    (scan,) = [line for line in text.splitlines() if "FileScan" in line and "open_time" in line and "ticket_hash" in line and "stored-" in line]
    assert "volume" not in scan and "close_time" not in scan
    assert text.count("BroadcastHashJoin") >= loaded.HASHES


def test_a_load_reports_what_the_suite_does_without_another_scan(spark, tmp_path, monkeypatch):
    users = sample_tables.users(spark, SF_DIR)
    trades = sample_tables.lineitem_trades(spark, SF_DIR)
    result = gate.load_trades(trades, users, str(tmp_path / "trades"))
    expected = suites.trades_suite(trades)
    assert sorted(map(tuple, result.verdicts.collect())) == sorted(tuple(r) for r in expected.collect() if r.seq > 2)
    assert sorted(map(tuple, result.null_status.collect())) == sorted(map(tuple, suites.trades_null_status(trades).collect()))
    assert result.accepted == spark.read.parquet(str(tmp_path / "trades/accepted=true")).count()
    assert result.rejected == spark.read.parquet(str(tmp_path / "trades/accepted=false")).count()
    assert result.accepted + result.rejected == trades.count()
    for df in (result.verdicts, result.null_status):
        assert "FileScan" not in plan(df)
    of_users = gate.load_users(users, str(tmp_path / "users"))
    assert sorted(map(tuple, of_users.verdicts.collect())) == sorted(tuple(r) for r in suites.users_suite(users).collect() if r.seq > 1)


def test_the_pass_that_writes_is_the_pass_that_counts(spark, tmp_path):
    trades = trades_table(spark, [trade("a", at("2024-01-02"), ticket=str(i)) for i in range(10)])
    suite = suites.trades_rules(trades)
    gated = gate.gate_trades(trades, users_table(spark, USERS))
    text = plan(gated.observe("seen", *suite.row_metrics()))
    assert "CollectMetrics seen" in text
    assert text.count("CollectMetrics") == 1


def test_a_load_of_nothing(spark, tmp_path):
    result = gate.load_trades(trades_table(spark, []), users_table(spark, USERS), str(tmp_path / "trades"))
    assert (result.accepted, result.rejected) == (0, 0)
    assert all(r.passed and r.bad_rows == 0 for r in result.verdicts.collect())


def test_loads_are_written_compactly(spark, tmp_path):
    gate.write_gated(gate.gate_users(users_table(spark, USERS)), str(tmp_path / "gated"))
    files = [path.name for path in (tmp_path / "gated").rglob("*.parquet")]
    assert files and all(name.endswith(".zstd.parquet") for name in files)
