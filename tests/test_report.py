"""The report on small tables, against a brute-force report in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyline.plans import report
from tallyline.plans.report import report_rows, trading_report, write_report
from tallyline.sources.staging import stage
from tallyline.spec import ReportSpec
from tests.tables import at, trade, trades_table, user, users_table

SPEC = ReportSpec(date(2024, 1, 8), date(2024, 1, 25), date(2024, 1, 10), date(2024, 1, 16))


def brute_force(trades: list[tuple], users: list[tuple], spec: ReportSpec) -> list[tuple]:
    joined = []
    for login, _, server, symbol, _, _, volume, opened, _, _, closed in trades:
        for u_login, u_server, _, currency, enable in set(users):
            if enable == 1 and login is not None and (login, server) == (u_login, u_server):
                if closed is not None and opened < closed:
                    joined.append((login, server, symbol, currency, volume or Decimal(0), closed))
    keys = sorted({t[:4] for t in joined}, key=lambda k: [(x is None, x or "") for x in k])
    rows = []
    for n in range(spec.n_days):
        day = spec.start + timedelta(days=n)
        past = [t for t in joined if t[5].date() <= day]
        window = [t for t in past if t[5].date() > day - timedelta(days=spec.window_days)]
        by_symbol, by_login = defaultdict(Decimal), defaultdict(int)
        for t in window:
            by_symbol[t[0], t[2]] += t[4]
            by_login[t[0]] += 1

        def dense_rank(totals, key):
            return sorted(set(totals.values()), reverse=True).index(totals[key]) + 1 if key in totals else 0

        for login, server, symbol, currency in keys:
            mine = [t for t in past if t[:3] == (login, server, symbol)] if symbol is not None else []
            recent = [t for t in mine if t in window]
            month = [t for t in mine if spec.month_start <= t[5].date() <= spec.month_end]
            number = len(rows) + 1
            rows.append(
                (
                    number,
                    day.isoformat(),
                    login,
                    server,
                    symbol,
                    currency,
                    float(sum(t[4] for t in recent)),
                    float(sum(t[4] for t in mine)),
                    dense_rank(by_symbol, (login, symbol)) if symbol is not None else 0,
                    dense_rank(by_login, login),
                    float(sum(t[4] for t in month)),
                    min((t[5] for t in mine), default=None),
                    number,
                )
            )
    return rows


def random_tables(seed: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    logins, servers, symbols = ["l1", "l2", "l3", "l4"], ["s1", "s2"], ["EURUSD", "GBPUSD", None]
    users = [
        user(login, server, rng.choice(["USD", "EUR", None]), int(rng.random() < 0.85), rng.choice(["c1", "c2"]))
        for login in logins
        for server in servers
        for _ in range(rng.choice([0, 1, 1, 2, 3]))
    ]
    users += rng.sample(users, len(users) // 3)
    trades = [
        trade(
            rng.choice([*logins, "stranger", None]),
            rng.choice([None, *[at(f"2024-01-{rng.randint(1, 31):02d}", rng.choice(["00:00:00", "23:59:59"]))] * 9]),
            rng.choice([None, 0, 1, 2, 2, 3, "0.1", "0.2"]),
            rng.choice(symbols),
            rng.choice([*servers, None]),
            opened=rng.choice([at("2024-01-01"), at("2024-01-20")]),
        )
        for _ in range(120)
    ]
    return trades, users


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables(spark, seed):
    trades, users = random_tables(seed)
    expected = brute_force(trades, users, SPEC)
    assert len({row[4] for row in expected}) == 3
    rows = trading_report(trades_table(spark, trades), users_table(spark, users), SPEC).collect()
    assert [tuple(row) for row in rows] == expected[::-1]


@pytest.fixture(scope="module")
def by_day(spark):
    """The report of one table that holds the edge cases, as {(login, symbol, currency): {day: row}}."""
    users = [user(f"l{i}") for i in range(1, 9)] + [user("l9", enable=0), user("two", "s1", "EUR"), user("two", "s1", "CHF")]
    trades = [
        trade("l1", at("2024-01-10", "23:59:59"), 5),
        trade("l2", at("2024-01-02"), 4),
        trade("l3", at("2024-01-30"), 9),
        trade("l4", at("2024-01-12"), 5, symbol="A"),
        trade("l5", at("2024-01-16"), 7),
        trade("l6", at("2024-01-20"), None),
        trade("l7", at("2024-01-12"), 100, symbol=None),
        trade("l8", at("2024-01-12"), 1, opened=at("2024-01-12")),
        trade("l8", None, 1),
        trade("l9", at("2024-01-12"), 1),
        trade(None, at("2024-01-12"), 1),
        trade("l1", at("2024-01-12"), 1, server=None),
        trade("two", at("2024-01-12"), 3),
    ]
    result = defaultdict(dict)
    for row in report_rows(trades_table(spark, trades), users_table(spark, users), SPEC).collect():
        result[row.login_hash, row.symbol, row.currency][int(row.dt_report[-2:])] = row
    return result


def test_rolling_window_edges(by_day):
    days = by_day["l1", "EURUSD", "USD"]
    assert [days[d].sum_volume_prev_7d for d in (9, 10, 16, 17)] == [0, 5, 5, 0]
    assert [days[d].sum_volume_prev_all for d in (9, 10, 25)] == [0, 5, 5]


def test_trades_before_the_report_count(by_day):
    days = by_day["l2", "EURUSD", "USD"]
    assert [days[d].sum_volume_prev_7d for d in (8, 9)] == [4, 0]
    assert (days[8].sum_volume_prev_all, days[8].date_first_trade) == (4, at("2024-01-02"))


def test_trades_after_the_report_only_make_a_key(by_day):
    days = by_day["l3", "EURUSD", "USD"]
    assert len(days) == SPEC.n_days
    for row in days.values():
        assert (row.sum_volume_prev_all, row.rank_volume_symbol_prev_7d, row.rank_count_prev_7d) == (0, 0, 0)
        assert row.date_first_trade is None


def test_calendar_edges(by_day):
    first, last = by_day["l1", "EURUSD", "USD"], by_day["l5", "EURUSD", "USD"]
    assert [first[d].sum_volume_2024_01 for d in (9, 10, 25)] == [0, 5, 5]
    assert [last[d].sum_volume_2024_01 for d in (15, 16, 25)] == [0, 7, 7]
    assert by_day["l2", "EURUSD", "USD"][25].sum_volume_2024_01 == 0


def test_ranks(by_day):
    # On the 12th: 100 (no symbol), 6 (two currencies), 5 and 5.
    ranks = {key[0]: days[12].rank_volume_symbol_prev_7d for key, days in by_day.items()}
    assert ranks == {"l1": 3, "l2": 0, "l3": 0, "l4": 3, "l5": 0, "l6": 0, "l7": 0, "two": 2}


def test_null_volume_is_ranked(by_day):
    row = by_day["l6", "EURUSD", "USD"][22]
    assert (row.sum_volume_prev_7d, row.rank_volume_symbol_prev_7d > 0) == (0, True)


def test_null_symbol(by_day):
    row = by_day["l7", None, "USD"][12]
    assert (row.sum_volume_prev_7d, row.sum_volume_prev_all, row.rank_volume_symbol_prev_7d) == (0, 0, 0)
    assert row.date_first_trade is None
    assert row.rank_count_prev_7d == 2


def test_two_currencies(by_day):
    chf, eur = by_day["two", "EURUSD", "CHF"], by_day["two", "EURUSD", "EUR"]
    assert chf[12].sum_volume_prev_7d == eur[12].sum_volume_prev_7d == 6
    assert eur[12].row_number == chf[12].row_number + 1


def test_dropped_rows(by_day):
    assert not {"l8", "l9", None} & {key[0] for key in by_day}


def test_numbers_have_no_gaps(by_day):
    numbers = sorted(row.row_number for days in by_day.values() for row in days.values())
    assert numbers == list(range(1, len(numbers) + 1))


def test_sums_grow(by_day):
    for days in by_day.values():
        rows = [days[d] for d in sorted(days)]
        assert all(a.sum_volume_prev_all <= b.sum_volume_prev_all for a, b in zip(rows, rows[1:]))
        assert all(row.sum_volume_prev_7d <= row.sum_volume_prev_all for row in rows)


@pytest.mark.parametrize("kind", ["double", "bigint", "decimal(20,9)"])
def test_other_volume_types(spark, kind):
    trades = [trade("l1", at("2024-01-10"), 3), trade("l1", at("2024-01-11"), 4)]
    df = trades_table(spark, trades)
    users = users_table(spark, [user("l1"), user("l1", country="c2")])
    rows = report_rows(df.withColumn("volume", df.volume.cast(kind)), users, SPEC).collect()
    assert max(row.sum_volume_prev_7d for row in rows) == 14


def test_times_with_a_zone(spark):
    trades, users = random_tables(4)
    df = trades_table(spark, trades)
    zoned = df.withColumns({name: df[name].cast("timestamp") for name in ("open_time", "close_time")})
    rows = trading_report(zoned, users_table(spark, users), SPEC).collect()
    assert [tuple(row) for row in rows] == brute_force(trades, users, SPEC)[::-1]


def test_a_one_day_report_with_a_long_window(spark):
    trades, users = random_tables(5)
    spec = ReportSpec(date(2024, 1, 20), date(2024, 1, 20), date(2024, 1, 1), date(2024, 1, 31), window_days=15)
    rows = trading_report(trades_table(spark, trades), users_table(spark, users), spec).collect()
    assert [tuple(row) for row in rows] == brute_force(trades, users, spec)[::-1]


def test_a_report_of_no_trades_is_empty(spark):
    assert trading_report(trades_table(spark, []), users_table(spark, [user("l1")]), SPEC).collect() == []


def test_written_report(spark, tmp_path):
    trades, users = random_tables(3)
    path = str(tmp_path / "report")
    write_report(trades_table(spark, trades), users_table(spark, users), path, SPEC)
    written = spark.read.parquet(path)
    assert written.count() == len(brute_force(trades, users, SPEC))
    assert {p.name for p in (tmp_path / "report").glob("dt_report=*")} == {
        f"dt_report=2024-01-{d:02d}" for d in range(8, 26)
    }


def test_written_files_hold_runs_of_descending_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "ROWS_PER_FILE", 3)
    trades, users = random_tables(4)
    path = str(tmp_path / "report")
    write_report(trades_table(spark, trades), users_table(spark, users), path, SPEC)
    expected = brute_force(trades, users, SPEC)
    n_keys = len(expected) // SPEC.n_days
    numbers = []
    files = list((tmp_path / "report").glob("dt_report=*/*.parquet"))
    for file in files:
        of_file = pq.ParquetFile(file).read(["row_number"])["row_number"].to_pylist()
        assert of_file == list(range(of_file[0], of_file[0] - len(of_file), -1)) and len(of_file) <= 3
        numbers += of_file
    assert len(files) >= SPEC.n_days * n_keys // 3
    assert sorted(numbers) == list(range(1, len(expected) + 1))


def test_no_report_row_is_shuffled_to_be_written(spark):
    trades, users = random_tables(4)
    df = report.rows_to_write(trades_table(spark, trades), users_table(spark, users), SPEC)
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Sort" in above and "Exchange" not in above


def test_a_compact_report_spells_out_what_is_asked_for(spark, tmp_path):
    from tallyline.plans import compact

    trades, users = random_tables(8)
    path = str(tmp_path / "compact")
    compact.write_compact(trades_table(spark, trades), users_table(spark, users), path, SPEC)
    expected = brute_force(trades, users, SPEC)

    def read(first=None, last=None, logins=None):
        return sorted(map(tuple, compact.read_compact(spark, path, first, last, logins).collect()))

    assert read() == sorted(expected)
    assert read(date(2024, 1, 20), date(2024, 1, 20)) == sorted(r for r in expected if r[1] == "2024-01-20")
    assert read(date(2024, 1, 23), date(2024, 3, 1), ["l1", "l3", "nobody"]) == sorted(
        r for r in expected if r[1] >= "2024-01-23" and r[2] in ("l1", "l3")
    )
    assert read(date(2024, 2, 1)) == read(logins=[]) == read(date(2024, 1, 9), date(2024, 1, 8)) == []
    # A key is stored once, and one day of one login opens the files with a filter and makes that day alone.
    assert spark.read.parquet(f"{path}/keys").count() == len(expected) // SPEC.n_days
    one = compact.read_compact(spark, path, date(2024, 1, 20), date(2024, 1, 20), ["l1"])
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(login_hash), EqualTo(login_hash,l1)]" in text or "In(login_hash" in text
    assert "Exchange" not in text


def stamps(path):
    return {p: p.stat().st_mtime_ns for p in path.glob("dt_report=*/*.parquet")}


@pytest.mark.parametrize(
    ("late", "since"),
    [
        ([trade("l1", at("2024-01-14"), 3, symbol="GBPUSD"), trade("l1", at("2024-01-20"), "0.1")], 14),
        ([trade("l1", at("2024-01-02"), 3)], 8),
        ([trade("l1", at("2024-01-26"), 3), trade("gone", at("2024-01-09"), 3), trade("l1", None, 1), trade("l1", at("1999-01-01"), 1)], None),
        ([trade("l2", at("2024-02-20"), 3)], 8),
        ([trade("l1", at("2024-01-25", "23:59:59"), 3, symbol=None)], 25),
    ],
)
def test_a_report_is_brought_up_to_date(spark, tmp_path, late, since):
    users = [user("l1"), user("l2"), user("l3"), user("gone", enable=0)]
    trades = [trade(login, at(f"2024-01-{d:02d}"), d, symbol) for login in ("l1", "l3") for d in (5, 12, 19) for symbol in ("EURUSD", "GBPUSD", None)]
    path, before, after = tmp_path / "report", trades_table(spark, trades), trades_table(spark, late)
    write_report(before, users_table(spark, users), str(path), SPEC)
    written = stamps(path)
    first = report.refresh_report(before, after, users_table(spark, users), str(path), SPEC)
    assert first == (since and date(2024, 1, since))
    expected = brute_force(trades + late, users, SPEC)
    columns = trading_report(before, users_table(spark, users), SPEC).columns
    rows = spark.read.parquet(str(path)).withColumn("dt_report", F.col("dt_report").cast("string")).select(*columns).collect()
    assert sorted(map(tuple, rows)) == sorted(expected)
    # Days before the first are the very same files.
    now = stamps(path)
    assert {p: t for p, t in now.items() if p in written} == {
        p: t for p, t in written.items() if since is None or int(p.parent.name[-2:]) < since
    }


def test_an_empty_report_is_written(spark, tmp_path):
    write_report(trades_table(spark, []), users_table(spark, [user("l1")]), str(tmp_path / "report"), SPEC)
    assert not list((tmp_path / "report").glob("dt_report=*"))


def test_default_ranges():
    spec = ReportSpec()
    assert (spec.n_days, spec.month_column) == (122, "sum_volume_2020_08")
    with pytest.raises(ValueError):
        ReportSpec(start=date(2024, 1, 2), end=date(2024, 1, 1))


@pytest.mark.parametrize("kind", ["double", "decimal(38,18)", "decimal(38,30)"])
def test_small_volumes_keep_their_places(spark, kind):
    from tallyline.operators import measures

    trades = spark.sql(
        f"select 'l' login_hash, 's' server_hash, 'x' symbol, cast('4e-7' as {kind}) volume, "
        "timestamp'2020-06-10 01:00:00' open_time, timestamp'2020-06-10 02:00:00' close_time from range(10)"
    )
    users = spark.sql("select 'l' login_hash, 's' server_hash, 'USD' currency, 1 enable")
    spec = ReportSpec()
    timeline = measures.timelines(measures.daily_activity(trades, users, spec), spec)
    rows = measures.rolling_volume(timeline).collect()
    assert len(rows) == 7 and all(float(r.sum_volume_prev_7d) == pytest.approx(4e-6) for r in rows)


def test_equal_amounts_of_doubles_share_a_rank(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ when they are added as doubles one after the other."""
    amounts = ["0.1", "0.2", "0.3"]
    rows = [trade("l1", at(f"2024-01-{10 + i}"), v) for i, v in enumerate(amounts)] + [trade("l2", at(f"2024-01-{10 + i}"), v) for i, v in enumerate(amounts[::-1])]
    rows += [trade("l3", at("2024-01-12"), v, server=s) for v, s in zip(amounts, ["s1", "s2", "s1"])]
    users = users_table(spark, [user(login, server) for login in ("l1", "l2", "l3") for server in ("s1", "s2")])
    df = trades_table(spark, rows)
    df = df.withColumn("volume", df.volume.cast("double"))
    found = {r.login_hash: r for r in report_rows(df, users, SPEC).filter("dt_report = '2024-01-12' and server_hash = 's1'").collect()}
    assert {found[login].sum_volume_prev_7d for login in ("l1", "l2")} == {0.6}
    assert {r.rank_volume_symbol_prev_7d for r in found.values()} == {1}


def test_reports_of_doubles_do_not_depend_on_the_partitions(spark):
    rng = random.Random(6)
    trades, users = random_tables(6)
    df = trades_table(spark, trades).withColumn("volume", F.rand(3) * F.pow(F.lit(2.0), F.floor(F.rand(4) * 60) - 30))
    df = stage(df, "double-trades")
    orders = [df.repartition(1), df.repartition(5, "ticket_hash", "volume"), df.orderBy(F.rand(rng.randint(0, 9)))]
    results = [[tuple(r) for r in trading_report(one, users_table(spark, users), SPEC).collect()] for one in orders]
    assert results[0] == results[1] == results[2] != []


@pytest.mark.parametrize("days", [1, 64, 130])
def test_ranks_of_ranges_around_the_bits_of_a_number(spark, days):
    trades, users = random_tables(7)
    spec = ReportSpec(date(2024, 1, 3), date(2024, 1, 3) + timedelta(days=days - 1), date(2024, 1, 10), date(2024, 1, 16), window_days=9)
    rows = trading_report(trades_table(spark, trades), users_table(spark, users), spec).collect()
    assert [tuple(row) for row in rows] == brute_force(trades, users, spec)[::-1]


def test_ranks_are_counted_on_from_task_to_task(spark, monkeypatch):
    from tallyline.operators import ranking

    monkeypatch.setattr(ranking, "_CELLS", 40)
    rng = random.Random(2)
    first = date(2024, 1, 8)
    steps = []
    for login in range(300):
        day = rng.randint(0, 5)
        while day < SPEC.n_days:
            last = min(day + rng.randint(0, 4), SPEC.n_days - 1)
            kind = rng.choice(["volume", "count"])
            steps.append((kind, f"l{login}-{kind}", "x", first + timedelta(days=day), first + timedelta(days=last), 1, float(rng.randint(-20, 40))))
            day = last + 1 + rng.randint(0, 3)
    df = stage(spark.createDataFrame(steps, "kind string, login_hash string, symbol string, from_day date, to_day date, trades long, value double"), "steps")
    found = {(r.kind, r.login_hash, r.from_day): r.ranks for r in ranking.rank_steps(df, SPEC).collect()}
    on_day = defaultdict(set)
    for kind, _, _, a, b, _, value in steps:
        for n in range((b - a).days + 1):
            on_day[kind, a + timedelta(days=n)].add(value)
    assert len(found) == len(steps)
    for kind, login, _, a, b, _, value in steps:
        expected = [sum(v >= value for v in on_day[kind, a + timedelta(days=n)]) for n in range((b - a).days + 1)]
        assert found[kind, login, a] == expected


def test_digests_equal_the_pairs_they_spare(spark):
    from tallyline.functions import report_days
    from tallyline.operators import accounts, spine

    trades, users = random_tables(9)
    joined = accounts.trades_with_users(trades_table(spark, trades), users_table(spark, users))
    totals = {"n": F.count("*"), "volume": F.sum("volume"), "first_close": F.min("close_time"), "last_close": F.max("close_time")}
    by, day = ["login_hash", "symbol"], report_days.close_day()
    for days, rows in (
        (report_days.cumulative_days(day, SPEC), joined),
        (report_days.calendar_days(day, SPEC), joined.filter(report_days.in_month(day, SPEC))),
    ):
        pairs = spine.on_days(joined, days).groupBy("dt_report", *by).agg(*[m.alias(name) for name, m in totals.items()])
        digests = spine.daily_digests(rows, by, totals, SPEC)
        assert sorted(map(str, digests.select(*pairs.columns).collect())) == sorted(map(str, pairs.collect())) != []


def test_numbers_over_any_table(spark):
    from tallyline.operators import numbering

    rng = random.Random(3)
    rows = [(rng.choice([None, *range(30)]), i) for i in range(200)]
    numbered = numbering.with_row_number(spark.createDataFrame(rows, "a int, b int").repartition(5), numbering.key_order("a", "b"))
    expected = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.a, r.b) for r in sorted(numbered.collect(), key=lambda r: r.row_number)] == expected


def test_nan_shows_in_its_window_and_leaves_with_it(spark):
    from tallyline.operators import measures

    trades = spark.sql(
        "select 'l' login_hash, 's' server_hash, 'x' symbol, v volume, d - interval 1 hour open_time, d close_time "
        "from values (double('NaN'), timestamp'2020-06-10 02:00:00'), (1e23, timestamp'2020-06-15 02:00:00') t(v, d)"
    )
    users = spark.sql("select 'l' login_hash, 's' server_hash, 'USD' currency, 1 enable")
    spec = ReportSpec()
    timeline = measures.timelines(measures.daily_activity(trades, users, spec), spec)
    rows = {r.dt_report.day: r.sum_volume_prev_7d for r in measures.rolling_volume(timeline).collect()}
    assert all(rows[d] != rows[d] for d in range(10, 17)) and all(rows[d] == 1e23 for d in range(17, 22))


def test_days_are_spelled_out_from_finished_stretches(spark):
    """On every row of the report nothing is put into another type: volumes are, per stretch, and days are named once."""
    trades = trades_table(spark, [trade("A", at("2024-01-09"), "1.50"), trade("A", at("2024-01-25"), symbol=None)])
    rows = report_rows(trades, users_table(spark, [user("A")]), SPEC)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    after, before = plan.split("Generate explode(", 1)
    assert "as string)" not in after and "as double)" not in after
    assert "as double)" in before
    names = sorted({r.dt_report for r in rows.collect()})
    assert names == [str(SPEC.start + timedelta(days=i)) for i in range(SPEC.n_days)]
