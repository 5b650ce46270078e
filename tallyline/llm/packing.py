"""Packing documents into sequences of a fixed length, each with the same mixture of sources.

Every source is a queue of tokens, in the order in which the table holds them. A window takes from
each queue what its share of the tokens gives it, in deficit round-robin: what a queue is owed but
did not get, a fraction of a token, is carried to the next window. Because the deficits are only
the remainders of running totals, the state of every queue at every window is known from the totals
alone, so that windows can be filled anywhere, and deficits carry over between partitions by themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm import pretokens
from tallyline.llm.text import or_empty
from tallyline.sources.staging import stage

SEQUENCE = 4096
SEPARATOR = 2
AT_ONCE = 500
"""Rows that a worker holds as Python objects. Spark sends 10,000 in a batch, of which two workers would hold a few hundred megabytes."""

_ENCODED = "part long, doc_id long, source string, before long, n long, ids binary"
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"
)


def few_rows(batches: Iterator[pa.RecordBatch], at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in smaller ones."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            yield batch.slice(start, at_once)


def encoded(docs: DataFrame, path: str, separator: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Each document's ids, with the tokens that its source has before it in the same task."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        # A null source is a queue of its own; the first letter tells it from all others.
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("source"),
        or_empty(F.col(text_col)).alias("text"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind = pretokens.id_type(path)
        # The next task of this worker goes on with what this one has learnt.
        memo = pretokens.worker_ids(path, kind.str)
        end = np.array([separator], kind).tobytes()
        so_far: dict[str, int] = {}
        for batch in few_rows(batches):
            before, n, blobs = [], [], []
            sources = batch["source"].to_pylist()
            for source, text in zip(sources, batch["text"].to_pylist()):
                blobs.append(memo.of_text(text) + end)
                n.append(len(blobs[-1]) // kind.itemsize)
                before.append(so_far.get(source, 0))
                so_far[source] = before[-1] + n[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(n), pa.int64()),
                    batch["doc_id"],
                    batch["source"],
                    pa.array(before, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(blobs, pa.binary()),
                ],
                names=["part", "doc_id", "source", "before", "n", "ids"],
            )

    return rows.mapInArrow(encode, _ENCODED)


def queues(tokens: DataFrame, sequence: int) -> DataFrame:
    """Where the tokens of each task and source stand in their queue: ``part, source, base, queue_size, queue_end``.

    A source with a token or more in every window has a queue of its own. The rarer ones follow one
    another in one queue, and where even that is too short, they follow the smallest source.
    ``queue_end`` is the running total over the queues.
    """
    parts = stage(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "parts")
    everything = Window.partitionBy()
    by_source = parts.groupBy("source").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(everything))
    large = F.col("n") * sequence >= F.col("total")
    smallest_large = F.min(F.when(large, F.struct("n", "source"))).over(everything)
    rest = F.sum(F.when(large, 0).otherwise(F.col("n"))).over(everything)
    own = by_source.select(
        "source",
        "n",
        F.when(large, F.col("source"))
        .when(rest * sequence >= F.col("total"), F.lit(""))
        .otherwise(F.coalesce(smallest_large["source"], F.lit("")))
        .alias("queue"),
    )
    ends = Window.orderBy("queue")
    sizes = own.groupBy("queue").agg(F.sum("n").alias("queue_size")).withColumn("queue_end", F.sum("queue_size").over(ends))
    before = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.join(F.broadcast(own.select("source", "queue")), "source")
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(F.broadcast(sizes), "queue")
        .select("part", "source", "base", "queue_size", "queue_end")
    )


class Windows:
    """What each window takes from one queue."""

    def __init__(self, size: int, end: int, total: int, sequence: int):
        self.size, self.end, self.total, self.sequence = size, end, total, sequence
        self.n = -(-total // sequence)

    def _up_to(self, k: int, end: int) -> int:
        """Tokens that the queues up to ``end`` have given before window ``k``."""
        return end if k >= self.n else self.sequence * k * end // self.total

    def first(self, k: int) -> int:
        """The queue's first token that is in window ``k`` or later."""
        return self._up_to(k, self.end) - self._up_to(k, self.end - self.size)

    def offset(self, k: int) -> int:
        """Where the queue's tokens begin in window ``k``: behind those of the queues before it."""
        end = self.end - self.size
        return self._up_to(k + 1, end) - self._up_to(k, end)

    def pieces(self, begin: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """``(window, offset, start, length)`` of the tokens from ``begin`` on."""
        k = begin * self.total // (self.sequence * self.size)
        while k > 0 and self.first(k) > begin:
            k -= 1
        while self.first(k + 1) <= begin:
            k += 1
        at, stop = begin, begin + length
        while at < stop:
            first, after = self.first(k), min(stop, self.first(k + 1))
            if after > at:
                yield k, self.offset(k) + at - first, at - begin, after - at
                at = after
            k += 1


def cutter(total: int, sequence: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts documents, whose place in their queue is known, into the pieces of their windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The ids are encoded: what the worker learnt for that is of no more use.
        pretokens.forget()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]
        types = [pa.int64()] * 7 + [pa.string(), pa.binary()]
        windows: dict[int, Windows] = {}
        for batch in few_rows(batches):
            out: list[tuple] = []
            for row in batch.to_pylist():
                end = row["queue_end"]
                if end not in windows:
                    windows[end] = Windows(row["queue_size"], end, total, sequence)
                # As wide as they were encoded; the tokenizer is not loaded again to ask.
                ids = np.frombuffer(row["ids"], f"<u{len(row['ids']) // row['n']}")
                wide = ids.astype("<u4")
                for k, offset, start, length in windows[end].pieces(row["begin"], row["n"]):
                    crc = zlib.crc32(wide[start : start + length])
                    blob = ids[start : start + length].tobytes() if with_ids else None
                    out.append((row["doc_id"], start, length, crc, row["n"], k, offset, row["source"][1:] if row["source"] != "n" else None, blob))
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return cut


def pack(
    docs: DataFrame,
    path: str | None = None,
    sequence: int = SEQUENCE,
    separator: int = SEPARATOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document: where it is cut and where it stands, with its ids.

    Sequences are numbered from 0; all are full but the last. A document's ids end with the
    separator, so that an empty or null text has one token. Rows that repeat are packed each for
    itself, and so are those with a null id; a null source is a queue of its own. An empty table gives no
    piece. ``ids`` are little-endian, two bytes each if the vocabulary allows it. Writes two tables on the way.
    """
    path = path or pretokens.tokenizer_path()
    tokens = stage(encoded(docs, path, separator, id_col, text_col, source_col), "token-ids")
    placed = stage(queues(tokens.select("part", "source", "n"), sequence), "queues")
    total = placed.agg(F.coalesce(F.max("queue_end"), F.lit(0))).first()[0]
    # Spark broadcasts the queues when they are small; beyond that the rows are shuffled by task and source.
    rows = tokens.join(placed, ["part", "source"]).select(
        "doc_id", "source", (F.col("base") + F.col("before")).alias("begin"), "n", "queue_size", "queue_end", "ids"
    )

    return rows.mapInArrow(cutter(total, sequence, with_ids), _PIECES)


def padded_length(tokens: int, sequence: int = SEQUENCE) -> int:
    """What a sequence is padded to: itself at a power of two, else the full length."""
    return tokens if tokens and tokens & (tokens - 1) == 0 else sequence
