"""Running the oracle SQL, and comparing its rows with those of a DataFrame."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame


def oracle_rows(sf_dir: str, sql: str) -> pd.DataFrame:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection.execute(sql).fetch_df()


def _multiset(rows: pd.DataFrame) -> Counter:
    texts = {}
    for name in sorted(rows.columns):
        column = rows[name]
        if pd.api.types.is_datetime64_any_dtype(column):
            texts[name] = column.astype("datetime64[us]").astype("int64")
        elif pd.api.types.is_bool_dtype(column) or not pd.api.types.is_numeric_dtype(column):
            texts[name] = column.map(lambda v: "" if pd.isna(v) else f"={v}")
        else:
            texts[name] = column.astype(float).map(repr)
    return Counter(zip(*texts.values()))


def differences(result: DataFrame, expected: pd.DataFrame, limit: int = 3) -> str:
    """An empty text when both hold the same multiset of rows, else what differs."""
    actual = result.toPandas()
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} against {sorted(expected.columns)}"
    ours, theirs = _multiset(actual), _multiset(expected)
    if ours == theirs:
        return ""
    extra, absent = list((ours - theirs).items())[:limit], list((theirs - ours).items())[:limit]
    return f"{ours.total()} rows against {theirs.total()}; extra {extra}; absent {absent}"
