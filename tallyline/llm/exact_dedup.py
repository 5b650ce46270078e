"""Exact duplicates of texts, found by two passes over a Bloom filter.

The first pass counts, for every text hash, the bits it sets; bits that are set twice form the
second filter. In the second pass a row whose bits are not all in it has a text of its own and
passes straight through. Only the others are shuffled and compared by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.columns import numbered
from tallyline.llm.text import ascii_lower, or_empty
from tallyline.sources.staging import stage

FILTER_BITS = 1 << 26
"""Bits of the filter. Its words of 64 bits, a million rows at most (16 MB), are what is broadcast.
A filter that is too small for its table lets more rows through to the comparison, nothing else."""

HASHES = 2
UID, SHA, SUSPECT = "uid__", "sha__", "suspect__"


def normalised_sha256(text: Column) -> Column:
    """SHA-256, in lower-case hex, of the text with A to Z in lower case; null counts as empty."""
    return F.sha2(ascii_lower(or_empty(text)).cast("binary"), 256)


def _bits(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits)) for seed in range(HASHES)]


def filter_words(keys: DataFrame, key: str, at_least: int, bits: int = FILTER_BITS) -> DataFrame:
    """A filter as 64-bit words ``(word, mask)``, of the bits that at least so many rows set.

    The counts are summed within each task before the shuffle, so that a key of very many rows
    arrives as one row a task. Both hashes share the bits: a row sets two of them, or one when they fall together.
    """
    set_bits = keys.select(F.explode(F.array_distinct(F.array(*_bits(F.col(key), bits)))).alias("bit"))
    twice = set_bits.groupBy("bit").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)
    mask = F.expr("shiftleft(1L, cast(pmod(bit, 64) as int))")
    return twice.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(mask).alias("mask"))


def repeated_bits(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The second filter: the bits that at least two rows set."""
    return filter_words(keys, key, 2, bits)


def mark_suspects(rows: DataFrame, key: str, repeated: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows with ``suspect__``: whether all the bits of their key are in the filter."""
    suspect = F.lit(True)
    marked = rows
    for i, bit in enumerate(_bits(F.col(key), bits)):
        part = F.broadcast(repeated.select(F.col("word").alias(f"word{i}__"), F.col("mask").alias(f"mask{i}__")))
        marked = marked.withColumn(f"bit{i}__", bit).join(part, F.expr(f"bit{i}__ div 64 = word{i}__"), "left")
        suspect = suspect & F.expr(f"coalesce(mask{i}__ & shiftleft(1L, cast(pmod(bit{i}__, 64) as int)), 0L) <> 0")
    return marked.select(*rows.columns, suspect.alias(SUSPECT))


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same after lower-casing A to Z; a null text equals an empty
    one. Of equal texts the row with the largest id stays, null being the smallest; of rows that
    share the largest id, one. An empty table gives an empty result. Other columns are not read.
    """
    digests = docs.select(F.col(id_col).alias("doc_id"), normalised_sha256(F.col(text_col)).alias(SHA))
    # Written, so that the texts are read once and the row numbers stay as they are.
    digests = stage(digests.withColumn(UID, F.monotonically_increasing_id()), "digests")
    marked = mark_suspects(digests, SHA, repeated_bits(digests, SHA))
    alone = marked.filter(~F.col(SUSPECT)).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col(SHA).alias("text_sha256"),
    )
    suspects = marked.filter(F.col(SUSPECT)).drop(SUSPECT)
    groups = suspects.groupBy(F.col(SHA).alias("group_sha")).agg(
        F.max(F.struct("doc_id", UID)).alias("last"), F.count("*").alias("group_size")
    )
    # Many copies of one text are rows of one key; Spark splits them, as both sides come from a shuffle.
    compared = suspects.repartition(SHA).join(groups, F.col(SHA) == F.col("group_sha")).select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col(UID) == F.col(f"last.{UID}")).alias("kept"),
        F.col(SHA).alias("text_sha256"),
    )
    return alone.unionByName(compared)


def drop_duplicate_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``find_duplicates`` keeps, with all their columns.

    Rows that may be repeated are reduced to one per text within each task, before the shuffle. Of
    rows with one text and one id, the one with the largest other columns stays.
    """
    names = docs.columns
    docs, id_col, text_col = numbered(docs, id_col, text_col)
    columns = docs.columns
    digests = stage(docs.select(normalised_sha256(F.col(text_col)).alias(SHA)), "digests")
    hashed = docs.withColumn(SHA, normalised_sha256(F.col(text_col)))
    marked = mark_suspects(hashed, SHA, stage(repeated_bits(digests, SHA), "repeated"))
    alone = marked.filter(~F.col(SUSPECT)).select(*columns)
    order = F.struct(id_col, *[name for name in columns if name != id_col and _orderable(docs, name)])
    last = (
        marked.filter(F.col(SUSPECT))
        .groupBy(SHA)
        .agg(F.max_by(F.struct(*columns), order).alias("row__"))
        .select("row__.*")
    )
    return alone.unionByName(last).toDF(*names)


def _orderable(docs: DataFrame, name: str) -> bool:
    return docs.schema[name].dataType.typeName() not in ("map", "variant", "interval")
