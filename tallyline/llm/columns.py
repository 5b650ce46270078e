"""Columns of a given table under names that cannot clash with an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def numbered(df: DataFrame, *columns: str) -> tuple:
    """The table with its columns named ``c0``, ``c1`` and so on, followed by the new names of ``columns``. ``toDF`` gives the old names back."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), *[names[df.columns.index(name)] for name in columns]
