from __future__ import annotations

import tempfile
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyline.operators.spine import close_day_series
from tallyline.plans import suites
from tallyline.sources import sample_tables, staging, tables
from tests.tables import at, trade, trades_table, user, users_table

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("format", ["parquet", "orc", "csv", "json"])
def test_a_table_reads_back_from_any_format(spark, tmp_path, format):
    trades = trades_table(spark, [trade("a", at("2024-01-02"), "1.25"), trade(None, None, None, symbol=None)])
    path = str(tmp_path / format)
    trades.write.format(format).save(path)
    schema = None if format in tables.SELF_DESCRIBING else tables.TRADES_SCHEMA
    read = tables.load_table(spark, path, format, schema)
    assert read.schema == trades.schema
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, trades.collect()), key=str)


def test_text_formats_need_a_schema(spark):
    with pytest.raises(ValueError, match="csv"):
        tables.load_table(spark, "/nowhere", "csv")


def test_sample_tables_have_the_declared_types(spark):
    users = sample_tables.users(spark, SF_DIR)
    for trades in (sample_tables.event_trades(spark, SF_DIR), sample_tables.lineitem_trades(spark, SF_DIR)):
        expected = spark.createDataFrame([], tables.TRADES_SCHEMA)
        assert trades.dtypes == expected.dtypes
    assert users.dtypes == spark.createDataFrame([], tables.USERS_SCHEMA).dtypes


def test_query_parameters_are_values(spark):
    df = users_table(spark, [user("a' or '1'='1"), user("b")])
    result = tables.run_query(spark, "select * from {t} where login_hash = :login", {"login": "a' or '1'='1"}, t=df)
    assert [r.login_hash for r in result.collect()] == ["a' or '1'='1"]
    assert tables.run_query(spark, "select count(*) as n from {t}", t=df).collect()[0].n == 2


def test_parameters_by_position(spark):
    df = spark.sql("select * from values (1, 'a'), (2, 'b') t(n, s)")
    rows = tables.run_query(spark, "select n from {t} where s = ? or n = ?", ["b' or '1'='1", 1], t=df).collect()
    assert [r.n for r in rows] == [1]
    with pytest.raises(ValueError):
        tables.run_query(spark, "select n from {t} where s = ?", "b", t=df)


def test_a_failing_query_raises(spark):
    with pytest.raises(PySparkException):
        tables.run_query(spark, "select nope from nowhere")


def test_every_day_of_a_range_is_there(spark):
    days = close_day_series(trades_table(spark, [trade("a", at("2020-06-01")), trade("a", at("2020-09-30"))]))
    assert days.count() == 122
    assert close_day_series(trades_table(spark, [])).count() == 0


def test_the_shared_folder_comes_from_the_session(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert staging.shared_folder(spark) == folder
    staged = staging.stage(spark.range(10).toDF("n"), "numbers")
    assert all(path.startswith(f"file://{folder}/numbers-") for path in staged.inputFiles())
    assert staged.count() == 10


def test_suites_report_known_verdicts(spark):
    users = sample_tables.users(spark, "/root/testdata/sf0.01")
    trades = sample_tables.event_trades(spark, "/root/testdata/sf0.01")
    rows = suites.full_report(users, trades).collect()
    assert [(r.suite, r.seq) for r in rows] == (
        [("cross_reference", 1)] + [("trades", i) for i in range(1, 12)] + [("users", i) for i in range(1, 4)]
    )
    verdicts = {(r.suite, r.seq): (r.passed, r.bad_rows) for r in rows}
    assert verdicts["cross_reference", 1] == (False, 3)
    assert verdicts["users", 1] == (False, 150)
    assert verdicts["users", 2] == (True, 0)
    assert not verdicts["users", 3][0]
    assert verdicts["trades", 1] == verdicts["trades", 2] == (False, 100)
    assert [verdicts["trades", i][0] for i in range(3, 12)] == [True] * 6 + [False, True, False]


class _Session:
    """Just the settings of a session."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = settings

    def get(self, name, default=None):
        return self.settings.get(name.removeprefix("spark.").replace(".", "_"), default)


def test_without_a_shared_folder_only_local_spark_may_use_its_own():
    assert staging.shared_folder(_Session(master="yarn", checkpoint_dir="hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(_Session(master="yarn"))
    assert staging.shared_folder(_Session(master="local[2]")).startswith(tempfile.gettempdir())


def test_database_reads_are_cut_into_ranges(monkeypatch):
    options = {}

    class Reader:
        def format(self, name):
            options["format"] = name
            return self

        def options(self, **values):
            options.update(values)
            return self

        def load(self):
            return "table"

    class Spark:
        read = Reader()

    loaded = tables.load_jdbc_table(Spark(), "jdbc:x", "trades", "id", 0, 1000, 16, fetchsize="10000")
    assert loaded == "table"
    assert options == {
        "format": "jdbc",
        "url": "jdbc:x",
        "dbtable": "trades",
        "partitionColumn": "id",
        "lowerBound": "0",
        "upperBound": "1000",
        "numPartitions": "16",
        "fetchsize": "10000",
    }


def test_hash_buckets_choose_every_row_once(spark):
    rows = spark.sql("select explode(array(-7, -1, 0, 1, 2, 3, 100, null)) as h")
    conditions = tables.hash_buckets("h", 3)
    assert len(conditions) == 3
    assert sorted(r.h is None or r.h for c in conditions for r in rows.filter(c).collect()) == sorted(
        [-7, -1, 0, 1, 2, 3, 100, True]
    )
    with pytest.raises(ValueError):
        tables.hash_buckets("h", 0)


def test_database_reads_by_conditions_and_of_a_query():
    calls = []

    class Reader:
        def jdbc(self, url, table, **given):
            calls.append((url, table, given))
            return "parts"

        def format(self, name):
            calls.append(name)
            return self

        def options(self, **given):
            calls.append(given)
            return self

        def load(self):
            return "result"

    class Spark:
        read = Reader()

    assert tables.load_jdbc_parts(Spark(), "jdbc:x", "users", ["a = 0", "a = 1"], fetchsize=1000) == "parts"
    assert calls == [("jdbc:x", "users", {"predicates": ["a = 0", "a = 1"], "properties": {"fetchsize": "1000"}})]
    with pytest.raises(ValueError):
        tables.load_jdbc_parts(Spark(), "jdbc:x", "users", [])
    calls.clear()
    assert tables.load_jdbc_query(Spark(), "jdbc:x", "select 1", fetchsize="10") == "result"
    assert calls == ["jdbc", {"url": "jdbc:x", "query": "select 1", "fetchsize": "10"}]


def test_a_written_check_run_holds_what_the_suites_say(spark, tmp_path):
    users = sample_tables.users(spark, "/root/testdata/sf0.001")
    trades = sample_tables.event_trades(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "checks")
    suites.write_full_report(users, trades, path)
    written = spark.read.parquet(f"{path}/verdicts")
    assert sorted(written.collect()) == sorted(suites.full_report(users, trades).collect())
    nulls = spark.read.parquet(f"{path}/null_status")
    expected = suites.users_null_status(users).union(suites.trades_null_status(trades))
    assert sorted(nulls.collect()) == sorted(expected.collect()) and nulls.count() == 15
    unknown = spark.read.parquet(f"{path}/unknown_accounts").count()
    assert unknown == written.filter("suite = 'cross_reference'").first().bad_rows


def test_trades_are_dealt_by_price_as_source_rows(spark, monkeypatch):
    """The same rows as undealt, in as many ranges as their number asks for; hashes are spelled out after the shuffle."""
    monkeypatch.setattr(sample_tables, "ROWS_PER_RANGE", 500)
    dealt = sample_tables.lineitem_trades_by_price(spark, SF_DIR)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "md5" in plan[: plan.index("rangepartitioning")] and "md5" not in plan[plan.index("rangepartitioning") :]
    rows = dealt.select("*", F.spark_partition_id().alias("part")).collect()
    undealt = sample_tables.lineitem_trades(spark, SF_DIR).collect()
    assert Counter(tuple(r)[:-1] for r in rows) == Counter(map(tuple, undealt))
    by_part = {}
    for row in rows:
        by_part.setdefault(row.part, []).append(row.open_price)
    parts = [by_part[part] for part in sorted(by_part)]
    assert len(parts) > 7 and all(max(a) < min(b) for a, b in zip(parts, parts[1:]))
