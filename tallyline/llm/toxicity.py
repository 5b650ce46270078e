"""Toxicity of whole texts by a small recurrent network that is trained on the given labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm import pretokens
from tallyline.llm.columns import numbered
from tallyline.llm.recurrent import Network, Scorer, train
from tallyline.llm.text import lower_bytes, or_empty

THRESHOLD = 0.3
SAMPLE_ROWS = 2_500
SAMPLE_CHARS = 4_000_000
SHORT = 2_000
"""The labelled sample that the network is fitted to: at most so many rows and characters, rows of up to
``SHORT`` characters first (their label says more about each window), by the hash of their id."""
LEAST_LABELS = 10
SCORE = "toxicity__"


def held_out(id_col: str) -> Column:
    """Whether the label of a row is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased texts and labels of the sample. An id with several labels counts as toxic if one says so; null labels do not count."""
    marked = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    length = F.length(or_empty(F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("row_id"), length.alias("chars")).join(marked, F.col("row_id") == F.col("label_id"))
    best = (
        rows.groupBy("row_id")
        .agg(F.max("chars").alias("chars"), F.max("label").alias("label"))
        .withColumn("order", F.struct(F.col("chars") > SHORT, F.xxhash64("row_id"), "row_id"))
        .orderBy("order")
        .limit(SAMPLE_ROWS)
    )
    so_far = F.sum("chars").over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = best.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_CHARS).select("row_id", "label")
    # At most SAMPLE_ROWS rows are broadcast, and at most SAMPLE_CHARS characters reach the driver.
    sample = (
        docs.select(F.col(id_col).alias("sample_id"), or_empty(F.col(text_col)).alias("text"))
        .join(F.broadcast(chosen), F.col("sample_id") == F.col("row_id"))
        .groupBy("sample_id")
        .agg(F.max("text").alias("text"), F.max("label").alias("label"))
    )
    found = sorted((r.sample_id, r.text, r.label) for r in sample.collect())
    return [lower_bytes(text) for _, text, _ in found], np.array([label for _, _, label in found], np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    return train(*training_sample(docs, labels, id_col, text_col))


def with_score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """All rows and columns with ``toxicity__``, the highest score among the overlapping windows of the whole text."""
    columns = [name for name in docs.columns if name != SCORE]
    given = docs.select(*columns, or_empty(F.col(text_col)).alias("scored_text__"))
    model = docs.sparkSession.sparkContext.broadcast(net)
    fields = [field for field in given.schema if field.name != "scored_text__"]
    schema = type(given.schema)([*fields]).add(SCORE, "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that has packed before still holds the ids that it learnt.
        pretokens.forget()
        scorer = Scorer(model.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = [scorer.scores([lower_bytes(t) for t in texts[i : i + 500].to_pylist()]) for i in range(0, len(texts), 500)]
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(flat, pa.float64())], names=[*batch.schema.names[:-1], SCORE]
            )

    return given.mapInArrow(score, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Only the text is read for a score. A null text scores as an empty one, and an empty one as a window without words.
    Rows with a null id are scored and never held out. Without labels of both kinds every row gets the
    prior. An empty table gives an empty result.
    """
    net = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_score(rows, net).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col(SCORE).alias("score"),
        (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    From fewer than ``LEAST_LABELS`` texts of either label nothing can be learnt that tells a clean text from a toxic one; then all rows stay.
    """
    texts, marked = training_sample(docs, labels, id_col, text_col)
    if min(int(marked.sum()), len(marked) - int(marked.sum())) < LEAST_LABELS:
        return docs
    rows, text = numbered(docs, text_col)
    return with_score(rows, train(texts, marked), text).filter(F.col(SCORE) < THRESHOLD).select(*rows.columns).toDF(*docs.columns)
