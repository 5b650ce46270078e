"""Positions in a total order, without passing the rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.sources.staging import stage
from tallyline.spec import ReportSpec

# Fixed value: monotonically_increasing_id keeps the partition number above its 33 lowest bits.
ROW_BITS = 33
PLACE, PART, OFFSET = "place__", "part__", "offset__"


def key_order(*columns: str) -> list[Column]:
    """Ascending order with nulls last."""
    return [F.col(name).asc_nulls_last() for name in columns]


def sorted_table(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Write the rows in a total order without ties, with their place inside their partition.

    The rows are range-partitioned, so tasks share the work evenly whatever the values are. As the
    places are stored, a lost task cannot change them.
    """
    return stage(rows.orderBy(*order).withColumn(PLACE, F.monotonically_increasing_id()), label)


def with_position(placed: DataFrame) -> DataFrame:
    """The rows of a ``sorted_table`` with their ``position``, 1 to n.

    Only the number of rows in the partitions before is missing: one small sum per partition of the
    sort, which is broadcast.
    """
    part = F.shiftright(PLACE, ROW_BITS)
    inside = F.col(PLACE).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias(PART))
        .agg(F.count("*").alias("size"))
        .select(PART, F.coalesce(F.sum("size").over(before), F.lit(0)).alias(OFFSET))
    )
    return (
        placed.withColumn(PART, part)
        .join(F.broadcast(offsets), PART)
        .withColumn("position", F.col(OFFSET) + inside + 1)
        .drop(PART, OFFSET, PLACE)
    )


def with_row_number(rows: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """``row_number`` over the whole table."""
    return with_position(sorted_table(rows, order, "numbered")).withColumnRenamed("position", name)


def numbered_grid(keys: DataFrame, order: list[Column], spec: ReportSpec, name: str = "row_number") -> DataFrame:
    """Every report day of every key, numbered by day and then in ``order``, which must tell all keys apart.

    Every day lists the same keys, so a row's number follows from its day and the position of its key: only the keys are sorted and written.
    """
    placed = sorted_table(keys, order, "numbered-keys")
    n_keys = placed.count()
    day = F.explode(F.sequence(spec.first_day(), spec.last_day())).alias("dt_report")
    number = F.datediff("dt_report", spec.first_day()).cast("long") * n_keys + F.col("position")
    return with_position(placed).select(day, *keys.columns, "position").select("dt_report", *keys.columns, number.alias(name))
