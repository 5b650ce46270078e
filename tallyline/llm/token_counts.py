"""Token counts of whole texts, on the map side.

A small table of frequent pre-tokens and their lengths in tokens goes to all workers. A pre-token that
is not in it is encoded once and kept in the worker's own bounded cache. Nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import pretokens
from tallyline.llm.text import or_empty

SAMPLE_ROWS = 2_000
"""Rows whose pre-tokens fill the frequent table: those with the smallest hashes of their ids. The
sample decides which lengths are at hand, never a result."""
FREQUENT = 20_000
"""Entries of the frequent table, under 2 MB: the bound on what is broadcast."""
SAMPLE_TEXT = 100_000
"""Characters of a sampled text that the sample looks at."""


def frequent_lengths(docs: DataFrame, path: str, id_col: str, text_col: str) -> dict[str, int]:
    """The most frequent pre-tokens of a sample of the texts, with their lengths in tokens."""
    order = F.xxhash64(F.lit("sample"), id_col)
    # The hashes are chosen first, so that only the texts of the sample are read beyond their task.
    chosen = docs.select(order.alias("chosen")).distinct().orderBy("chosen").limit(SAMPLE_ROWS)
    texts = docs.select(order.alias("order"), F.substring(or_empty(F.col(text_col)), 1, SAMPLE_TEXT).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("order") == F.col("chosen"), "left_semi").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                counts.update(pretokens.split(text) or [])
        top = counts.most_common(FREQUENT)
        yield pa.RecordBatch.from_pydict({"pre": [k for k, _ in top], "n": [n for _, n in top]})

    merged = sample.mapInArrow(count, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    top = [row["pre"] for row in merged.orderBy(F.desc("n"), "pre").limit(FREQUENT).collect()]
    return dict(zip(top, map(len, pretokens.encode_whole(path, top))))


def count_tokens(
    docs: DataFrame,
    path: str | None = None,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts equal the library's for the whole text, without added special tokens. A null text counts
    as empty, with no bytes and no tokens. Ids may be null or repeat; an empty table gives an empty result.
    """
    path = path or pretokens.tokenizer_path()
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, path, id_col, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), or_empty(F.col(text_col)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = pretokens.Memo(path, pretokens.lengths, frequent.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch["text"].to_pylist():
                pre = pretokens.split(text)
                n_tokens.append(sum(memo.values(pre)) if pre is not None else len(pretokens.encode_whole(path, [text])[0]))
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
