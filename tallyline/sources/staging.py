"""Intermediate tables written once to the cluster's shared folder.

A job that needs the same intermediate rows several times writes them as parquet and reads them
back. The files outlive any executor, cut the lineage, and their size is known, by which
Spark decides whether a table is broadcast. Whoever runs the cluster owns the retention of
that folder, as with checkpoints.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyline-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only when Spark runs locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder()


def stage(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, by default in Spark's usual compression, and return the written table."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
