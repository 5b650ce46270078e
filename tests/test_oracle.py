"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tests.compare import differences, oracle_rows

QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()
WITHOUT_SQL = {name for name in QUERIES if name.startswith("op")} | {"pipeline"}
SF_DIR = entry_module.SMALLEST


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), oracle_rows(SF_DIR, ORACLE[name])) == ""


def test_long_report_row_by_row(spark):
    from oracle_queries import LINEITEM_RANGE, LINEITEM_TRADES, report
    from tallyline.plans.report import report_rows
    from tallyline.sources import sample_tables

    rows = report_rows(
        sample_tables.lineitem_trades(spark, SF_DIR), sample_tables.users(spark, SF_DIR), entry_module.LINEITEM_REPORT
    )
    assert differences(rows, oracle_rows(SF_DIR, report(LINEITEM_TRADES, LINEITEM_RANGE))) == ""


def test_entry_has_a_stable_schema(spark):
    assert entry_module.entry(spark).columns == [
        "id",
        "dt_report",
        "login_hash",
        "server_hash",
        "symbol",
        "currency",
        "sum_volume_prev_7d",
        "sum_volume_prev_all",
        "rank_volume_symbol_prev_7d",
        "rank_count_prev_7d",
        "sum_volume_2024_01",
        "date_first_trade",
        "row_number",
    ]
