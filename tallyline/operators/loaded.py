"""Which keys of a delivery a stored table already holds.

The stored table is the large one. A Bloom filter of the incoming keys, built in Spark and broadcast, passes over its key
columns alone; what it lets through, the rows that are there and a few others, is compared by value. Nothing else of the
stored table is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import comparable, require_columns, type_of
from tallyline.sources.staging import stage

BITS_PER_KEY, HASHES = 12, 3
"""About one key in two hundred passes by chance."""
MOST_BITS = 1 << 26
"""Bits of the largest filter that is broadcast: a million numbers of 64 bits, 16 MB. Deliveries of more than some five million keys are
compared without a filter, with the same result."""
WORD = 64


def _bits(columns: Sequence[str], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(bits)) for seed in range(HASHES)]


def _mask(bit: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod({bit}, {WORD}) as int))")


def key_filter(keys: DataFrame, bits: int) -> DataFrame:
    """The filter of the keys as 64-bit words ``(word, mask)``. Words without a bit are left out."""
    set_bits = keys.select(F.explode(F.array(*_bits(keys.columns, bits))).alias("bit"))
    return set_bits.groupBy(F.expr(f"bit div {WORD}").alias("word")).agg(F.bit_or(_mask("bit")).alias("mask"))


def might_be_among(rows: DataFrame, columns: Sequence[str], words: DataFrame, bits: int) -> DataFrame:
    """The rows whose key sets only bits of the filter: all that are among its keys, and a few others."""
    kept = rows
    for i, bit in enumerate(_bits(columns, bits)):
        part = F.broadcast(words.select(F.col("word").alias(f"word{i}__"), F.col("mask").alias(f"mask{i}__")))
        kept = kept.withColumn(f"bit{i}__", bit).join(part, F.expr(f"bit{i}__ div {WORD} = word{i}__"))
        kept = kept.filter(F.col(f"mask{i}__").bitwiseAND(_mask(f"bit{i}__")) != 0).select(*rows.columns)
    return kept


def keys_already_loaded(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of ``incoming`` that ``stored`` has too, as a written table. Null equals null."""
    require_columns(incoming, keys, "delivery")
    require_columns(stored, keys, "stored table")
    for name in keys:
        if not comparable(type_of(incoming, name), type_of(stored, name)):
            raise ValueError(f"column {name!r} holds different kinds of values in the two tables")
    # Of one type on both sides, so that equal values have equal hashes.
    common = incoming.select(*keys).limit(0).union(stored.select(*keys).limit(0)).schema
    in_common = [F.col(field.name).cast(field.dataType).alias(field.name) for field in common]
    wanted = stage(incoming.select(*in_common).distinct(), "incoming-keys")
    bits = max(WORD, BITS_PER_KEY * wanted.count())
    candidates = stored.select(*in_common)
    if bits <= MOST_BITS:
        candidates = might_be_among(candidates, keys, stage(key_filter(wanted, bits), "key-filter"), bits)
    held = candidates.select(*[F.col(name).alias(f"{name}__held") for name in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"{name}__held")) for name in keys])
    return stage(wanted.join(held, same, "left_semi"), "loaded-keys")
