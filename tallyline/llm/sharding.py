"""Consistent placement of rows by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. The shards take
turns, each claiming the first slot of its order that is still free, until the table is full. A row
goes to the shard that owns the slot of its key. Taking a shard away moves hardly any other row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.columns import numbered

SLOTS = 65_537
"""Slots of the table: a prime, and a bound on what is broadcast."""


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(seed: str, shard: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{shard}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the index of the shard that owns it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime no smaller than the number of shards")
    place = [_number("offset", shard) % slots for shard in shards]
    step = [_number("skip", shard) % (slots - 1) + 1 for shard in shards]
    owner = [-1] * slots
    free = slots
    while free:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            owner[place[i]] = i
            free -= 1
            if not free:
                break
    return owner


def place_rows(
    rows: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS, shard_col: str = "shard"
) -> DataFrame:
    """All rows and columns, with ``slot`` and the name of the row's ``shard``.

    Placement depends on the key columns alone, and nulls are values like others: rows with equal
    keys share a shard. Columns of the two new names are replaced, after their values have served if they are keys. The rows are not shuffled.
    """
    table = rows.sparkSession.createDataFrame(
        [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, slots))], f"slot int, {shard_col} string"
    )
    # The hash of a null column is that of the columns before it; its place in the list tells it apart.
    given, *own_keys = numbered(rows, *keys)
    key = F.xxhash64(*[x for name in own_keys for x in (F.col(name).isNull(), F.col(name))])
    slotted = given.withColumn("slot", F.pmod(key, F.lit(slots)).cast("int"))
    kept = [F.col(new).alias(old) for new, old in zip(given.columns, rows.columns) if old not in ("slot", shard_col)]
    return slotted.join(F.broadcast(table), "slot").select(*kept, "slot", shard_col)


def write_shards(placed: DataFrame, path: str, pieces: int = 8, shard_col: str = "shard") -> None:
    """Write one directory per shard, in up to ``pieces`` files each, so that a large shard is not one task's work."""
    piece = F.pmod(F.xxhash64(F.lit("piece"), *placed.columns), F.lit(pieces))
    placed.repartition(shard_col, piece).write.partitionBy(shard_col).parquet(path)
