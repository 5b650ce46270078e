"""Connected components of a table of links, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.sources.staging import stage


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum("a"), F.sum("b")).first())


def _to_smallest(links: DataFrame, source: str, small: str) -> DataFrame:
    """Each link's ``other`` end with the smallest neighbour of its ``source`` end.

    The smallest is an aggregate that is joined back, so that a node with very many links is split by Spark.
    """
    least = links.groupBy(F.col(source).alias("node")).agg(F.least(F.min("b"), F.min("a")).alias(small))
    return links.join(least, F.col(source) == F.col("node"))


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``(a, b)``, the component being its smallest node.

    Alternates two steps until nothing changes: every larger neighbour of a node is linked to the
    node's smallest neighbour, then every smaller one. The links end as stars. Each round is written, which cuts the lineage.
    """
    # Every link from its larger end a to its smaller end b.
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    links = stage(links, "links")
    before = _digest(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            _to_smallest(both, "a", "least").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        ).filter("a > b").distinct()
        joined = _to_smallest(large, "a", "least")
        small = (
            joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(joined.select("a", F.col("least").alias("b")))
            .filter("a > b")
            .distinct()
        )
        links = stage(small, "links")
        after = _digest(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
