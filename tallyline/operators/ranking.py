"""Dense ranks per report day.

The dense rank of a value is its position among the distinct values of its day. Only distinct
values are sorted, spread over all tasks, and the ranks are joined back to the rows. A day is never
one task's work, and a value shared by many rows is sorted once.

What is ranked for the report are step functions: the totals of a login and symbol, or of a login, change on few
days. They stay steps, from one day to another, until the report is spelled out. A distinct value is sorted once with the set
of days on which anyone has it, as bits; counting the sets in the order of the values gives the value's rank on every one of its days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.columns import type_of
from tallyline.functions.exact_sums import merge, part_names
from tallyline.operators.measures import stretches
from tallyline.operators.numbering import sorted_table, with_position
from tallyline.sources.staging import stage
from tallyline.spec import ReportSpec

VOLUME, COUNT = "volume", "count"
STEP_KEY = ["kind", "login_hash", "symbol"]
WORD = 64
"""Days that one number holds as bits."""
_CELLS = 1 << 20
"""Values times days that a task counts at once."""


def value_ranks(values: DataFrame, partition: list[str], value: str) -> DataFrame:
    """The dense rank of each distinct ``value`` inside its partition, the largest first.

    ``partition`` must have few distinct values (days, here): their first positions are broadcast.
    """
    order = [F.col(name).asc() for name in partition] + [F.col(value).desc()]
    placed = sorted_table(values.select(*partition, value).distinct(), order, "ranks")
    positions = with_position(placed)
    firsts = positions.groupBy(*partition).agg(F.min("position").alias("first_position"))
    rank = (F.col("position") - F.col("first_position") + 1).cast("int")
    return positions.join(F.broadcast(firsts), partition).select(*partition, value, rank.alias("rank"))


def dense_rank_by_day(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Rows with the dense rank of ``value`` within ``dt_report``, the largest value first."""
    ranks = value_ranks(rows, ["dt_report"], value)
    return rows.join(ranks.withColumnRenamed("rank", name), ["dt_report", value])


def contender_steps(timeline: DataFrame, spec: ReportSpec) -> DataFrame:
    """What is ranked for the report: ``kind, login_hash, symbol, from_day, to_day, trades, value``.

    Per stretch of days, the rolling volume of each (login, symbol) and the rolling trade count of each login, over all
    servers, where there is a trade in the window. Both are summed in one pass: what a key's stretch adds on its first day it takes away on the day
    after its last. Decimals and parts of doubles are whole numbers underneath, so nothing remains of what was taken away.
    """
    active = stretches(timeline).filter(F.col("window_trades") > 0)
    parts = part_names([name for name in active.columns if name != "window_volume"], "window_volume")
    amounts = [*parts, "window_trades"]
    begins = F.struct(F.col("from_day").alias("day"), *amounts)
    ends = F.struct(F.date_add("to_day", 1).alias("day"), *[(-F.col(name)).cast(type_of(active, name)).alias(name) for name in amounts])
    events = active.select("login_hash", "symbol", F.inline(F.array(begins, ends))).filter(F.col("day") <= spec.last_day())
    by_symbol = F.struct(F.lit(VOLUME).alias("kind"), "symbol")
    by_login = F.struct(F.lit(COUNT).alias("kind"), F.lit(None).cast("string").alias("symbol"))
    of_kind = events.select("login_hash", "day", *amounts, F.inline(F.array(by_symbol, by_login)))
    # Summed within each task before the shuffle, so that a login of very many keys arrives as a few rows per task and day.
    changes = of_kind.groupBy(*STEP_KEY, "day").agg(*[F.sum(name).alias(name) for name in amounts])
    per_key = Window.partitionBy(*STEP_KEY).orderBy("day")
    so_far = per_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = changes.select(
        *STEP_KEY,
        F.col("day").alias("from_day"),
        F.coalesce(F.date_sub(F.lead("day").over(per_key), 1), spec.last_day()).alias("to_day"),
        *[F.sum(name).over(so_far).alias(name) for name in amounts],
    ).filter(F.col("window_trades") > 0)
    volume = merge(parts)
    amount = type_of(steps.select(volume.alias("volume")), "volume")
    value = F.when(F.col("kind") == VOLUME, volume).otherwise(F.col("window_trades").cast(amount))
    return steps.select(*STEP_KEY, "from_day", "to_day", F.col("window_trades").alias("trades"), value.alias("value"))


def _day_bits(spec: ReportSpec) -> list[Column]:
    """The days ``from_day`` to ``to_day`` as bits of as many numbers as the report has 64 days."""
    first, last = (F.datediff(name, spec.first_day()) for name in ("from_day", "to_day"))
    words = []
    for w in range(-(-spec.n_days // WORD)):
        lo, hi = F.greatest(first - WORD * w, F.lit(0)), F.least(last - WORD * w, F.lit(WORD - 1))
        up, down = F.call_function("shiftleft", F.lit(-1).cast("bigint"), lo), F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), WORD - 1 - hi)
        words.append(F.when(lo <= hi, up.bitwiseAND(down)).otherwise(F.lit(0).cast("bigint")).alias(f"days{w}"))
    return words


def _days_before(words: list[str], day: Column) -> Column:
    """How many of the days in the bits come before the day with this number."""
    count = F.lit(0)
    for w, name in enumerate(words):
        below = F.least(F.greatest(day - WORD * w, F.lit(0)), F.lit(WORD))
        mask = F.when(below == 0, F.lit(0).cast("bigint")).otherwise(
            F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.least(WORD - below, F.lit(WORD - 1)))
        )
        count = count + F.bit_count(F.col(name).bitwiseAND(mask))
    return count


def _day_counter(n_days: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For sorted values: their ranks on each of their days, counted from the first row of the task and kind.

    A row without a value at the end of each kind holds the counts that the tasks after this one go on from. The function it returns
    needs nothing of this package where it runs.
    """

    def count_days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, kind = TaskContext.get().partitionId(), [f"days{w}" for w in range(-(-n_days // WORD))], None
        counted = np.zeros(n_days, np.int64)

        def rows(kinds: list, values: pa.Array | None, words: np.ndarray, ranks: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
            n = len(kinds)
            values = pa.nulls(n, batch["value"].type) if values is None else values
            columns = [pa.array([part] * n, pa.int32()), pa.array(kinds, pa.string()), values]
            columns += [pa.array(words[:, w]) for w in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, ranks], names=["part", "kind", "value", *names, "ranks"])

        def total(batch: pa.RecordBatch) -> pa.RecordBatch:
            ranks = pa.ListArray.from_arrays(pa.array([0, n_days], pa.int32()), pa.array(counted))
            return rows([kind], None, np.zeros((1, len(names)), np.int64), ranks, batch)

        at_once = max(1, _CELLS // n_days)
        batch = None
        for whole in batches:
            for start in range(0, len(whole), at_once):
                batch = whole.slice(start, at_once)
                kinds = batch["kind"].to_pylist()
                edges = [0, *[i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]], len(kinds)]
                for lo, hi in zip(edges, edges[1:]):
                    if kind is not None and kind != kinds[lo]:
                        yield total(batch)
                        counted = np.zeros(n_days, np.int64)
                    kind = kinds[lo]
                    words = np.stack([batch[name].to_numpy()[lo:hi] for name in names], axis=1)
                    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, :n_days].astype(bool)
                    counts = counted + bits.cumsum(axis=0)
                    counted = counts[-1]
                    ends = np.concatenate([[0], bits.sum(axis=1).cumsum()]).astype(np.int32)
                    ranks = pa.ListArray.from_arrays(pa.array(ends), pa.array(counts[bits]))
                    yield rows(kinds[lo:hi], batch["value"].slice(lo, hi - lo), words, ranks, batch)
        if batch is not None:
            yield total(batch)

    return count_days


def rank_steps(steps: DataFrame, spec: ReportSpec) -> DataFrame:
    """Contender steps with ``ranks``: the dense rank among those of their kind on each of their days, the largest value first.

    ``steps`` must be a written table. No step is spelled out into days: each distinct value travels once, with its days as bits, and
    a step takes its own days out of the ranks of its value.
    """
    words = [f"days{w}" for w in range(-(-spec.n_days // WORD))]
    distinct = steps.select("kind", "value", *_day_bits(spec)).groupBy("kind", "value").agg(*[F.bit_or(name).alias(name) for name in words])
    ordered = distinct.select("kind", "value", *words).orderBy(F.col("kind").asc(), F.col("value").desc())
    value_type = type_of(steps, "value").simpleString()
    spelled = ", ".join(f"{name} long" for name in words)
    counted = stage(
        ordered.mapInArrow(_day_counter(spec.n_days), f"part int, kind string, value {value_type}, {spelled}, ranks array<long>"),
        "rank-values",
    )
    # One row per task of the sort and kind, of one number per day: what the tasks before have counted.
    before = Window.partitionBy("kind", "day").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    gone_before = (
        counted.filter(F.col("value").isNull())
        .select("part", "kind", F.posexplode("ranks").alias("day", "n"))
        .select("part", "kind", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
        .groupBy("part", "kind")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "n"))), lambda d: d["n"]).alias("offsets"))
    )
    of_value = counted.filter(F.col("value").isNotNull()).join(F.broadcast(stage(gone_before, "rank-offsets")), ["part", "kind"])
    # Both sides are plain shuffles: Spark may split the steps of a value that very many have.
    joined = steps.join(of_value.drop("part"), ["kind", "value"])
    first, last = (F.datediff(name, spec.first_day()) for name in ("from_day", "to_day"))
    length = last - first + 1
    own = F.slice("ranks", _days_before(words, first) + 1, length)
    ranks = F.zip_with(own, F.slice("offsets", first + 1, length), lambda a, b: (a + b).cast("int"))
    return joined.select(*steps.columns, ranks.alias("step_ranks")).withColumnRenamed("step_ranks", "ranks")


def ranks_by_day(ranked: DataFrame, kind: str, name: str) -> DataFrame:
    """The ranked steps of one kind spelled out: ``dt_report``, the key, ``trades``, ``value`` and the rank."""
    rows = ranked.filter(F.col("kind") == kind).select("login_hash", "symbol", "from_day", "trades", "value", F.posexplode("ranks").alias("day", name))
    return rows.select(F.date_add("from_day", F.col("day")).alias("dt_report"), "login_hash", "symbol", "trades", "value", name)


def steps_by_day(steps: DataFrame, kind: str) -> DataFrame:
    """The steps of one kind spelled out: ``dt_report``, the key, ``trades`` and ``value``."""
    days = F.explode(F.sequence("from_day", "to_day")).alias("dt_report")
    return steps.filter(F.col("kind") == kind).select(days, "login_hash", "symbol", "trades", "value")


def ranks_per_key(ranked: DataFrame, keys: list[str], spec: ReportSpec) -> DataFrame:
    """One row per key with the array of its ``ranks``, one entry per report day up to the last it has.

    Days without a rank hold 0. A key has one step per day at most, so an array is no longer than the
    report range.
    """
    day = F.datediff("from_day", spec.first_day())
    known = F.sort_array(F.collect_list(F.struct(day.alias("day"), "ranks")))

    def with_gap(step: Column, i: Column) -> Column:
        before = F.get("known", i - 1)
        end = F.coalesce(before["day"] + F.size(before["ranks"]), F.lit(0))
        return F.concat(F.array_repeat(F.lit(0), (step["day"] - end).cast("int")), step["ranks"])

    return ranked.groupBy(*keys).agg(known.alias("known")).select(*keys, F.flatten(F.transform("known", with_gap)).alias("ranks"))


def rank_arrays(timeline: DataFrame, spec: ReportSpec) -> tuple[DataFrame, DataFrame]:
    """The ranks per day of each (login, symbol) by volume, as ``symbol_ranks``, and of each login by trade count, as ``login_ranks``."""
    ranked = rank_steps(stage(contender_steps(timeline, spec), "contenders"), spec)
    # Written, so that Spark may split the shuffled keys of a login that has many.
    ranks = stage(ranks_per_key(ranked, STEP_KEY, spec), "rank-arrays")
    of_volume, of_count = ranks.filter(F.col("kind") == VOLUME), ranks.filter(F.col("kind") == COUNT)
    return (
        of_volume.select("login_hash", "symbol", F.col("ranks").alias("symbol_ranks")),
        of_count.select("login_hash", F.col("ranks").alias("login_ranks")),
    )
