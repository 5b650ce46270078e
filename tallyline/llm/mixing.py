"""Mixing sources to target weights by capped water-filling.

Each source gets its weight's share of a budget of words. A source whose share exceeds the words
of its largest number of epochs is clamped there, and the excess goes to the others by weight, until
no share is above its cap. Documents are then taken in the order of a seeded hash: all of them as many
whole times as fit into the target, the first ones once more, and of one document only a part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.columns import numbered
from tallyline.llm.text import SPACED_WORD, or_empty
from tallyline.sources.staging import stage

# The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
BINS = 4096
"""Bins of the hash order of a source. Sums over bins find the bin in which the target is met; only its rows are sorted."""


@dataclass(frozen=True)
class Mix:
    """The written sizes of the rows, and the plan: one row per source."""

    sizes: DataFrame
    plan: DataFrame


def n_words(text: Column) -> Column:
    return F.regexp_count(or_empty(text), F.lit(SPACED_WORD)).cast("long")


def draw(seed: int, id_col: str) -> Column:
    """The place of a row in the order of its source, by its id alone."""
    return F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(id_col))


def _bin(order: Column) -> Column:
    return F.pmod(F.shiftright(order, 40), F.lit(BINS))


def _in_order(order: Column) -> Column:
    """The bin first, then the hash."""
    return F.struct(_bin(order).alias("bin"), order.alias("draw"))


def targets(source_sizes: DataFrame, budget: float, max_epochs: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size`` with the ``target`` of each source: water-filling in closed form.

    The sources are few, one row each. Ordered by cap per weight, the clamped ones come first:
    source k is clamped when its cap is no more than its share of what the ones before it leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    total = Window.partitionBy()
    rows = source_sizes.withColumn("weight", F.element_at(cycle, place.cast("int"))).select(
        "*",
        (F.col("source_size") * max_epochs).alias("cap"),
        (F.sum("source_size").over(total) * budget).alias("budget"),
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(onward)
    clamped = rows.select("*", level.alias("level"), F.row_number().over(by_level).alias("nth")).withColumn(
        "clamped", F.col("cap") <= F.col("level") * F.col("weight")
    )
    # The level at the first source that is not clamped holds for all from there on.
    water = F.min(F.when(~F.col("clamped"), F.struct("nth", "level"))).over(total)
    return clamped.withColumn("water", water["level"]).select(
        "source",
        "source_size",
        F.when(F.col("clamped") | F.col("water").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("water") * F.col("weight")))
        .alias("target"),
    )


def plan_mix(
    docs: DataFrame,
    budget: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """Sizes and plan of a mix. Writes two tables on the way.

    A null source is a source of its own, the last. A null or empty text has size 0 and is taken as
    the others, at no cost. Rows with one id are taken alike, so that reruns agree. An empty
    table gives an empty plan.
    """
    sizes = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            draw(seed, id_col).alias("draw"),
        ),
        "sizes",
    )
    bins = stage(sizes.groupBy("source", _bin(F.col("draw")).alias("bin")).agg(F.sum("size").alias("size")), "bins")
    of_sources = targets(bins.groupBy("source").agg(F.sum("size").alias("source_size")), budget, max_epochs, weights)
    rates = of_sources.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target")) / F.col("source_size"))).otherwise(0)
    ).withColumn("more", (F.round("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    rates = stage(rates, "rates")

    so_far = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        bins.join(F.broadcast(rates.select(F.col("source").alias("s"), "more")), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("sum", F.sum("size").over(so_far))
        .filter((F.col("sum") > F.col("more")) & (F.col("sum") - F.col("size") <= F.col("more")))
        .groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("more") - F.col("sum") + F.col("size")).alias("left"))).alias("edge"))
        .select(F.col("source").alias("s"), F.col("edge.bin").alias("edge_bin"), F.col("edge.left").alias("left"))
    )
    in_edge = sizes.join(
        F.broadcast(edge), F.col("source").eqNullSafe(F.col("s")) & (_bin(F.col("draw")) == F.col("edge_bin"))
    )
    per_draw = in_edge.groupBy("source", "draw", "left").agg(F.sum("size").alias("size"))
    up_to = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        per_draw.withColumn("sum", F.sum("size").over(up_to))
        .filter(F.col("sum") > F.col("left"))
        .withColumn("part", (F.col("left") - F.col("sum") + F.col("size")) / F.col("size"))
        .groupBy("source")
        .agg(F.min(F.struct("draw", "part")).alias("last"))
        .select(F.col("source").alias("s"), F.col("last.draw").alias("last_draw"), F.col("last.part").alias("part"))
    )
    plan = rates.join(F.broadcast(last), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return Mix(sizes, stage(plan, "mix-plan"))


def with_plan(rows: DataFrame, plan: DataFrame, source_col: str, order: Column) -> DataFrame:
    """Rows with ``epochs``, the whole times they are taken, and ``part``, what is taken of them besides."""
    of_source = plan.select(
        F.col("source").alias("plan_source__"),
        F.col("source_size").alias("source_size__"),
        F.col("target").alias("target__"),
        F.col("epochs").alias("epochs__"),
        F.col("more").alias("more__"),
        F.col("last_draw").alias("last_draw__"),
        F.col("part").alias("edge_part__"),
    )
    joined = rows.join(of_source, F.col(source_col).eqNullSafe(F.col("plan_source__")))
    at, edge = _in_order(order), _in_order(F.col("last_draw__"))
    part = (
        F.when(F.col("last_draw__").isNull() | (F.col("more__") <= 0), F.lit(0.0))
        .when(at < edge, F.lit(1.0))
        .when(at == edge, F.col("edge_part__"))
        .otherwise(F.lit(0.0))
    )
    return joined.withColumn("part__", part)


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    rows = with_plan(mix.sizes, mix.plan, "source", F.col("draw"))
    taken = F.col("epochs__") * F.col("size") + F.round(F.col("part__") * F.col("size"))
    return rows.select(
        "doc_id",
        "size",
        F.col("source_size__").cast("long").alias("source_size"),
        F.col("target__").cast("double").alias("target"),
        taken.cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, mix: Mix, seed: int = 11, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them whole; the one that is cut counts when at least half is taken."""
    given, own_id, source = numbered(docs, id_col, source_col)
    rows = with_plan(given, mix.plan, source, draw(seed, own_id))
    copies = (F.col("epochs__") + F.when(F.col("part__") >= 0.5, 1).otherwise(0)).cast("int")
    # At most the epochs of the cap and one more, whatever the data.
    return rows.withColumn("copies__", copies).filter(F.col("copies__") > 0).select(
        *given.columns, F.explode(F.array_repeat(F.lit(1), F.col("copies__"))).alias("copy__")
    ).select(*given.columns).toDF(*docs.columns)
