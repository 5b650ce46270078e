"""Reading tables, and running parameterised SQL over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The columns of the two tables.
USERS_SCHEMA = "login_hash string, server_hash string, country_hash string, currency string, enable int"
TRADES_SCHEMA = (
    "login_hash string, ticket_hash string, server_hash string, symbol string, digits int, cmd int, "
    "volume decimal(18,2), open_time timestamp_ntz, open_price double, contractsize bigint, "
    "close_time timestamp_ntz"
)

SELF_DESCRIBING = ("parquet", "orc")


def load_table(
    spark: SparkSession,
    location: str,
    format: str = "parquet",
    schema: str | StructType | None = None,
    **options: Any,
) -> DataFrame:
    """Read files of any format Spark knows. Text formats need a declared schema, so that no pass
    over the data is spent on guessing one."""
    if schema is None and format not in SELF_DESCRIBING:
        raise ValueError(f"reading {format} needs a declared schema")
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(location)


def load_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower_bound: Any,
    upper_bound: Any,
    num_partitions: int,
    **options: Any,
) -> DataFrame:
    """Read a database table in ``num_partitions`` parallel ranges of ``partition_column``.

    The bounds only set where the ranges are cut: rows outside them are read too. Filters and column
    choices made on the result are pushed down to the database.
    """
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(num_partitions),
            **options,
        )
        .load()
    )


def hash_buckets(expression: str, buckets: int) -> list[str]:
    """Conditions that together choose every row once, for tables that have only text to be cut by.

    ``expression`` is SQL of the database that gives a whole number for a row, such as a hash of
    its key; rows where it is null are in the first bucket.
    """
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    of_row = f"mod(abs(mod({expression}, {buckets})) + {buckets}, {buckets})"
    return [f"{of_row} = {i}" if i else f"({of_row} = 0 or ({expression}) is null)" for i in range(buckets)]


def load_jdbc_parts(spark: SparkSession, url: str, table: str, predicates: Sequence[str], **options: Any) -> DataFrame:
    """Read a database table with one task for each condition in ``predicates``.

    The conditions must choose every row once, as those of ``hash_buckets`` do.
    """
    if not predicates:
        raise ValueError("at least one condition is needed")
    properties = {name: str(value) for name, value in options.items()}
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=properties)


def load_jdbc_query(spark: SparkSession, url: str, query: str, **options: Any) -> DataFrame:
    """The result of a query that the database runs, read by one task. For results that are small."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def run_query(
    spark: SparkSession,
    query: str,
    params: Mapping[str, Any] | Sequence[Any] | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """Run SQL over the given tables, written ``{table}`` in the text, with parameters by name, ``:name``, or by position, ``?``.

    Values are bound as literals, never pasted into the text. A failing query raises.
    """
    if isinstance(params, str):
        raise ValueError("parameters by position are a list of values")
    by_name = params is None or isinstance(params, Mapping)
    return spark.sql(query, args=dict(params or {}) if by_name else list(params), **tables)
