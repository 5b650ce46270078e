"""Column-level predicates used by the checks. None of them ever returns null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMESTAMP_TYPES = (T.TimestampType, T.TimestampNTZType)
# How a database spells numbers and the dates that times begin with.
NUMBER = r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|[+-]?Infinity)$"
FULL_DATE = r"^\d{4}-\d{1,2}-\d{1,2}"
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def require_columns(df: DataFrame, columns: Iterable[str], table: str = "table") -> None:
    """Raise ``ValueError`` naming every column that ``df`` lacks."""
    absent = [name for name in columns if name not in df.columns]
    if absent:
        raise ValueError(f"the {table} has no column {', '.join(map(repr, absent))}")


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_numeric_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def is_timestamp_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, TIMESTAMP_TYPES)


def _family(data_type: T.DataType) -> str:
    if is_numeric_type(data_type):
        return "number"
    if is_timestamp_type(data_type) or isinstance(data_type, T.DateType):
        return "time"
    return data_type.typeName()


def comparable(left: T.DataType, right: T.DataType) -> bool:
    """Whether two types hold values of one kind, so that comparing them needs no parsing of text."""
    return _family(left) == _family(right)


def _number(df: DataFrame, column: str) -> Column:
    value = F.col(column)
    return value.cast("int") if isinstance(type_of(df, column), T.BooleanType) else value


def _is_nan(df: DataFrame, column: str) -> Column:
    return F.isnan(column) if isinstance(type_of(df, column), FLOAT_TYPES) else F.lit(False)


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating-point column."""
    return F.col(column).isNull() | F.coalesce(_is_nan(df, column), F.lit(False))


def is_binary(df: DataFrame, column: str) -> Column:
    """The value equals 0 or 1. Null does not, and neither does any text."""
    if not is_numeric_type(type_of(df, column)):
        return F.lit(False)
    return F.coalesce(_number(df, column).isin(0, 1), F.lit(False))


def is_greater(df: DataFrame, column: str, other: str | None = None) -> Column:
    """``column`` exceeds ``other``, or zero without one. Comparing a null or NaN yields False."""
    if other is None:
        if not is_numeric_type(type_of(df, column)):
            raise ValueError(f"column {column!r} holds no numbers to compare with zero")
        holds, nan = _number(df, column) > 0, _is_nan(df, column)
    else:
        if not comparable(type_of(df, column), type_of(df, other)):
            raise ValueError(f"columns {column!r} and {other!r} hold different kinds of values")
        holds = _number(df, column) > _number(df, other)
        nan = _is_nan(df, column) | _is_nan(df, other)
    return F.coalesce(holds & ~nan, F.lit(False))


def is_not_number(df: DataFrame, column: str) -> Column:
    """A present value that cannot be read as a number."""
    data_type = type_of(df, column)
    if is_numeric_type(data_type):
        return F.lit(False)
    if isinstance(data_type, T.StringType):
        text = F.trim(column)
        reads = text.rlike(NUMBER) & text.try_cast("double").isNotNull()
        return F.col(column).isNotNull() & ~reads
    return F.col(column).isNotNull()


def is_not_timestamp(df: DataFrame, column: str) -> Column:
    """A present value that cannot be read as a point in time."""
    data_type = type_of(df, column)
    if is_timestamp_type(data_type):
        return F.lit(False)
    if isinstance(data_type, (T.StringType, T.DateType)):
        text = F.trim(F.col(column).cast("string"))
        reads = text.rlike(FULL_DATE) & text.try_cast("timestamp_ntz").isNotNull()
        return F.col(column).isNotNull() & ~reads
    return F.col(column).isNotNull()
