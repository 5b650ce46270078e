"""Key tuples of one table that are absent from another."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import comparable, require_columns, type_of
from tallyline.operators.checks import verdict


def foreign_key_mismatches(
    child: DataFrame, child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """The distinct key tuples of ``child`` that ``parent`` lacks. Null equals null.

    Both sides are reduced to distinct keys before they meet, so a key shared by many rows is one
    row in the join.
    """
    require_columns(child, child_columns, "child table")
    require_columns(parent, parent_columns, "parent table")
    if not child_columns or len(child_columns) != len(parent_columns):
        raise ValueError("a foreign key needs as many child columns as parent columns")
    for c, p in zip(child_columns, parent_columns):
        if not comparable(type_of(child, c), type_of(parent, p)):
            raise ValueError(f"child column {c!r} and parent column {p!r} hold different kinds of values")
    child_keys = child.select(*child_columns).distinct()
    names = [f"parent_{i}" for i in range(len(parent_columns))]
    parent_keys = parent.select(*[F.col(p).alias(n) for p, n in zip(parent_columns, names)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(child_columns, names)])
    return child_keys.join(parent_keys, same, "left_anti")


def check_foreign_key(
    child: DataFrame, child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """One verdict row; ``bad_rows`` counts the distinct mismatched key tuples."""
    mismatches = foreign_key_mismatches(child, child_columns, parent, parent_columns)
    return verdict(mismatches.agg(F.count("*").alias("bad")), "foreign key", child_columns, F.col("bad"))
