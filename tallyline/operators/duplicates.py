"""Counting, flagging and dropping duplicate rows.

Rows are duplicates when they agree on the key columns; null agrees with null. Most rows of a large
table have no duplicate, so a first pass over the key columns alone counts 8-byte key hashes. Rows
with a hash met once are settled. The others, *suspects*, are compared by their real values, so the
results are exact whatever the hashes do. Where suspects are many, a bitmap of their hashes, of
bounded size, is broadcast: it settles most other rows where they are, and whatever it lets through
is shuffled once, by key. Keys of very many rows are told from the others by the counts of their hashes;
their copies are counted before they are shuffled, however many they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Literal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.columns import require_columns
from tallyline.sources.staging import stage

Keep = Literal["first", "last"] | bool

PIECE = 100_000
"""Most copies of one row that one task spells out at a time."""

HOT = 10_000
"""Most rows with one key hash that one task compares."""

FEW_HASHES = 100_000
"""So many suspect hashes meet the rows by value; beyond, rows are sorted out by the bitmap first."""

BITS_PER_HASH, MOST_BITS = 8, 1 << 26
"""The bitmap has a million numbers of 64 bits at most, 16 MB. A fuller one lets more rows through, with the same result."""
WORD = 64

KEY_HASH = "key_hash__"
COPIES = "copies__"
COPY = "copy__"
PIECE_NO = "piece__"
GROUP_SIZE = "group_size__"
ARRIVAL = "arrival__"
SURVIVOR = "survivor__"


def _key_columns(df: DataFrame, subset: Sequence[str] | None) -> list[str]:
    if subset is None:
        return df.columns
    if not subset:
        raise ValueError("the list of key columns is empty")
    require_columns(df, subset)
    return list(subset)


def _check_keep(keep: Keep) -> None:
    if keep not in ("first", "last", False) or keep is True:
        raise ValueError("keep must be 'first', 'last' or False")


def _hashed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn(KEY_HASH, F.xxhash64(*columns))


def _in_bitmap(bits: int) -> tuple[Column, Column]:
    """The word of the bitmap that has the bit of a row's hash, and the word's mask with that bit alone."""
    return F.expr(f"pmod({KEY_HASH}, {bits}) div {WORD}"), F.expr(f"shiftleft(1L, cast(pmod({KEY_HASH}, {WORD}) as int))")


@dataclass(frozen=True)
class Suspects:
    """The hashes of ``keys`` that several rows have, as a written table with their counts, and what was learnt of them."""

    keys: list[str]
    hashes: DataFrame
    words: DataFrame | None
    """The bitmap as ``(word, mask)``, None where the hashes are few."""
    bits: int
    any_hot: bool

    def _meeting(self, rows: DataFrame, hashes: DataFrame, how: str) -> DataFrame:
        return rows.join(hashes.select(KEY_HASH), KEY_HASH, how)

    def hot(self, df: DataFrame) -> DataFrame | None:
        """The rows whose hash more than ``HOT`` rows have; None where no hash is so frequent."""
        if not self.any_hot:
            return None
        hot_hashes = self.hashes.filter(F.col("count") > HOT)
        return self._meeting(_hashed(df, self.keys), hot_hashes, "left_semi").select(*df.columns)

    def _by_bitmap(self, df: DataFrame) -> tuple[DataFrame, Column]:
        word, mask = _in_bitmap(self.bits)
        marked = _hashed(df, self.keys).join(F.broadcast(self.words), word == F.col("word__"), "left")
        return marked, F.coalesce(F.col("mask__").bitwiseAND(mask) != 0, F.lit(False))

    def few(self, df: DataFrame) -> DataFrame:
        """The rows that may have a duplicate and are not hot."""
        if self.words is None:
            hashes = self.hashes.filter(F.col("count") <= HOT) if self.any_hot else self.hashes
            return self._meeting(_hashed(df, self.keys), hashes, "left_semi").select(*df.columns)
        marked, may_repeat = self._by_bitmap(df)
        rows = marked.filter(may_repeat)
        if self.any_hot:
            rows = self._meeting(rows, self.hashes.filter(F.col("count") > HOT), "left_anti")
        return rows.select(*df.columns)

    def settled(self, df: DataFrame) -> DataFrame:
        """The rows that are neither hot nor among the few: they have no duplicate."""
        if self.words is None:
            return self.none(df)
        marked, may_repeat = self._by_bitmap(df)
        return marked.filter(~may_repeat).select(*df.columns)

    def all(self, df: DataFrame) -> DataFrame:
        """Hot or not, by value: for copies, which are counted before they are shuffled."""
        return self._meeting(_hashed(df, self.keys), self.hashes, "left_semi").select(*df.columns)

    def none(self, df: DataFrame) -> DataFrame:
        return self._meeting(_hashed(df, self.keys), self.hashes, "left_anti").select(*df.columns)


def _suspects(df: DataFrame, keys: Sequence[str]) -> Suspects:
    """Hashes of the keys that occur more than once; written, so that Spark knows their size."""
    counted = df.select(F.xxhash64(*keys).alias(KEY_HASH)).groupBy(KEY_HASH).count()
    hashes = stage(counted.filter(F.col("count") > 1), "suspects")
    n, most = hashes.agg(F.count("*"), F.max("count")).first()
    bits, words = WORD, None
    if n > FEW_HASHES:
        while bits < min(BITS_PER_HASH * n, MOST_BITS):
            bits *= 2
        word, mask = _in_bitmap(bits)
        words = stage(hashes.groupBy(word.alias("word__")).agg(F.bit_or(mask).alias("mask__")), "suspect-bits")
    return Suspects(list(keys), hashes, words, bits, (most or 0) > HOT)


def _flagged_in_group(size: Column, keep: Keep) -> Column:
    """How many rows of a group of ``size`` equal rows are flagged."""
    return F.when(size > 1, size).otherwise(0) if keep is False else size - 1


def duplicate_counts(
    df: DataFrame, subsets: Sequence[Sequence[str] | None], keep: Keep = "first"
) -> DataFrame:
    """How many rows are flagged as duplicates for each key, as columns ``n0, n1, ..`` of one row.

    Every key must contain the one after it, so that all are counted in one pass: groups of a key
    are made of groups of the key before.
    """
    _check_keep(keep)
    keys = [_key_columns(df, subset) for subset in subsets]
    for wide, narrow in zip(keys, keys[1:]):
        if not set(narrow) <= set(wide):
            raise ValueError("every list of key columns must contain the one after it")
    narrowest = keys[-1]
    suspects = _suspects(df, narrowest)
    wide = df.select(*keys[0])
    # One shuffle by the narrowest key brings the rows of every wider key together.
    few, hot = suspects.few(wide).repartition(*narrowest), suspects.hot(wide)
    counts = _counts_of(few, keys, keep)
    if hot is not None:
        counts = counts.unionByName(_counts_of(hot, keys, keep))
    return counts.agg(*[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in counts.columns])


def _counts_of(groups: DataFrame, keys: list[list[str]], keep: Keep) -> DataFrame:
    """The counts ``n0, n1, ..`` of each group of the narrowest key."""
    size: Column = F.count("*")
    counts: list[str] = []
    for i, key in enumerate(keys):
        groups = groups.groupBy(*key).agg(size.alias(GROUP_SIZE), *[F.sum(name).alias(name) for name in counts])
        counts.append(f"n{i}")
        groups = groups.withColumn(counts[-1], _flagged_in_group(F.col(GROUP_SIZE), keep).cast("long"))
        size = F.sum(GROUP_SIZE)
    return groups.select(*counts)


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None, keep: Keep = "first") -> DataFrame:
    """One row ``duplicates``: how many rows would be flagged."""
    return duplicate_counts(df, [subset], keep).withColumnRenamed("n0", "duplicates")


def _spread(copies: DataFrame, flagged: Column, columns: list[str]) -> DataFrame:
    """Counted copies as rows again, with their flag.

    They are spelled out where they are. Only very many copies of one row become pieces first, which are dealt to all tasks. Both
    kinds come from the same shuffles, which Spark runs once.
    """
    n_copies = F.col(COPIES)
    few = copies.filter(n_copies <= PIECE).withColumn(COPY, F.explode(F.sequence(F.lit(1).cast("long"), n_copies)))
    last_piece = F.ceil(n_copies / PIECE) - 1
    pieces = copies.filter(n_copies > PIECE).withColumn(PIECE_NO, F.explode(F.sequence(F.lit(0).cast("long"), last_piece)))
    # With a number, so that Spark does not put the pieces, which are still small, back into one task.
    tasks = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(tasks, PIECE_NO, F.xxhash64(*columns))
    first = F.col(PIECE_NO) * PIECE + 1
    last = F.least(n_copies, first + (PIECE - 1))
    many = dealt.withColumn(COPY, F.explode(F.sequence(first, last)))
    told = [*columns, flagged.alias("is_duplicate")]
    return few.select(*told).unionByName(many.select(*told))


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias(COPIES))


def _in_order(columns: Sequence[str], keys: Sequence[str], order_by: Sequence[str]) -> list[str]:
    return [*order_by, *[name for name in columns if name not in (*order_by, *keys)]]


def _flagged_in_place(few: DataFrame, keys: list[str], keep: Keep, order_by: Sequence[str] | None) -> DataFrame:
    """Rows of keys with few rows each, with their flag: one shuffle by key, and copies stand for themselves."""
    same_key = Window.partitionBy(*keys)
    if keep is False:
        return few.withColumn("is_duplicate", F.count("*").over(same_key) > 1)
    names = _in_order(few.columns, keys, order_by)
    order = [F.col(name).asc_nulls_first() if keep == "first" else F.col(name).desc_nulls_last() for name in names]
    return few.withColumn("is_duplicate", F.row_number().over(same_key.orderBy(*order)) > 1)


def with_arrival(df: DataFrame) -> DataFrame:
    """The rows with their place in the Parquet files that they come from: the path of the file, then the number of the row in it.

    Raises ``ValueError`` if the rows are not straight from such files: then no place is known.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.withColumn(ARRIVAL, place)
    except AnalysisException as unknown:
        raise ValueError("keeping the first or last row of a key needs order_by, or rows straight from Parquet files") from unknown


def _checked_keys(
    df: DataFrame, subset: Sequence[str] | None, keep: Keep, order_by: Sequence[str] | None
) -> tuple[DataFrame, list[str], bool, Sequence[str] | None]:
    """The rows, the key columns, whether they are all columns, and the order: that of arrival where it is needed and none is given."""
    _check_keep(keep)
    keys = _key_columns(df, subset)
    whole_rows = set(keys) == set(df.columns)
    require_columns(df, order_by or [])
    if not whole_rows and keep is not False and not order_by:
        return with_arrival(df), keys, whole_rows, [ARRIVAL]
    return df, keys, whole_rows, order_by


def flag_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: Keep = "first",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Every row with ``is_duplicate``.

    ``keep`` spares the first or the last row of each group, or with False no row of a group of
    several. With a ``subset`` first and last go by ``order_by``; null comes first, and the remaining columns break ties. Without it
    they go by the order in which the rows stand in the Parquet files that they are read from, files by their path.
    """
    names = df.columns
    df, keys, whole_rows, order_by = _checked_keys(df, subset, keep, order_by)
    columns = df.columns
    suspects = _suspects(df, keys)
    if whole_rows:
        result = _spread(_counted(suspects.all(df)), F.col(COPIES) > 1 if keep is False else F.col(COPY) > 1, columns)
        settled = suspects.none(df)
    else:
        result = _flagged_in_place(suspects.few(df), keys, keep, order_by)
        hot = suspects.hot(df)
        if hot is not None:
            marked, flagged = _flag_within_keys(_counted(hot), keys, columns, keep, order_by)
            result = result.unionByName(_spread(marked, flagged, columns))
        settled = suspects.settled(df)
    settled = settled.select(*columns, F.lit(False).alias("is_duplicate"))
    return settled.unionByName(result).select(*names, "is_duplicate")


def _flag_within_keys(
    copies: DataFrame, keys: list[str], columns: list[str], keep: Keep, order_by: Sequence[str] | None
) -> tuple[DataFrame, Column]:
    """Counted copies with the summary row of their key, and the flag that follows from both.

    The summary is an aggregate and the join an equi-join, both of which Spark can spread when one
    key holds a large share of the rows; a window over the key could not be.
    """
    of_key = [F.col(name).alias(f"{name}__of_key") for name in keys]
    if keep is False:
        summary = copies.groupBy(*of_key).agg(F.sum(COPIES).alias(GROUP_SIZE))
        flagged = F.col(GROUP_SIZE) > 1
    else:
        in_order = F.struct(*_in_order(columns, keys, order_by))
        pick = F.min if keep == "first" else F.max
        summary = copies.groupBy(*of_key).agg(pick(in_order).alias(SURVIVOR))
        flagged = ~in_order.eqNullSafe(F.col(SURVIVOR)) | (F.col(COPY) > 1)
    same_key = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"{name}__of_key")) for name in keys])
    return copies.join(summary, same_key), flagged


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: Keep = "first",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The rows that ``flag_duplicates`` does not flag. Copies are never spelled out: one row at most stays of each."""
    names = df.columns
    df, keys, whole_rows, order_by = _checked_keys(df, subset, keep, order_by)
    columns = df.columns
    suspects = _suspects(df, keys)
    if whole_rows:
        copies = _counted(suspects.all(df))
        stays = copies.filter(F.col(COPIES) == 1) if keep is False else copies
        return suspects.none(df).unionByName(stays.select(*columns)).select(*names)
    stays = _flagged_in_place(suspects.few(df), keys, keep, order_by).filter(~F.col("is_duplicate")).select(*columns)
    hot = suspects.hot(df)
    if hot is not None:
        marked, flagged = _flag_within_keys(_counted(hot).withColumn(COPY, F.lit(1)), keys, columns, keep, order_by)
        stays = stays.unionByName(marked.filter(~flagged).select(*columns))
    return suspects.settled(df).unionByName(stays).select(*names)
