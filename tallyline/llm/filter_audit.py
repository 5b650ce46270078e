"""What each filter removes under every order of the filters.

A document is a mask of the filters that it fails. The audit needs only how many documents of a part have each mask, so the
documents are counted per part and mask before anything else; there are at most two to the number of filters masks. The removal step of a mask under an order is the
smallest place of a failed filter in that order: the min-plus product of the matrix of masks (0 where a filter fails,
infinity elsewhere) and the matrix of inverse permutations (place of each filter in each order). Scattered by that step,
the counts give what every step removes; a filter behind the step of a mask that fails it is redundant there.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.text import SPACED_WORD, or_empty
from tallyline.sources.staging import stage

MOST_FILTERS = 7
"""7 filters have 5,040 orders; the result grows with that number."""
_COUNTS = ["part", "mask", "documents", "good", "toxic"]
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def orders_and_places(letters: str) -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and the place (from 1) of each filter in each order."""
    places = np.array(list(permutations(range(1, len(letters) + 1))), np.int64)
    by_place = np.argsort(places, axis=1)
    return ["".join(letters[f] for f in row) for row in by_place], places


def removal_steps(masks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The step at which each mask is removed under each order; one more than there are filters where it never is."""
    n = places.shape[1]
    failed = np.where(masks[:, None] >> np.arange(n) & 1, 0, n + 1)
    steps = np.full((len(masks), len(places)), n + 1, np.int64)
    for f in range(n):
        np.minimum(steps, failed[:, f, None] + places[None, :, f], out=steps)
    return steps


def audit_part(counts: pd.DataFrame, letters: str) -> pd.DataFrame:
    """The rows of one part from its counts per mask."""
    orders, places = orders_and_places(letters)
    masks = counts["mask"].to_numpy(np.int64)
    weights = {name: counts[name].to_numpy(np.int64) for name in _COUNTS[2:]}
    n, steps = len(letters), removal_steps(masks, places)
    at_order = np.broadcast_to(np.arange(len(orders)), steps.shape)

    def scattered(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(orders), n + 2), np.int64)
        np.add.at(out, (at_order, steps), weight[:, None])
        return out[:, 1 : n + 1]

    lost = {name: scattered(weight) for name, weight in weights.items()}
    removed = lost["documents"]
    kept = weights["documents"].sum() - removed.cumsum(axis=1)
    fails = (masks[:, None] >> np.arange(n) & 1).astype(bool)
    filter_at = np.argsort(places, axis=1)
    # Documents that fail a filter but were gone before its step.
    redundant = np.stack(
        [(weights["documents"][:, None] * (fails[:, f, None] & (steps < places[None, :, f]))).sum(axis=0) for f in range(n)], axis=1
    )
    only = np.array([weights["documents"][masks == 1 << f].sum() for f in range(n)], np.int64)
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, filter_at, removed)
    each = np.arange(len(orders))[:, None]
    return pd.DataFrame(
        {
            "part": counts["part"].iloc[0],
            "filter_order": np.repeat(orders, n),
            "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
            "kept": kept.ravel(),
            "removed": removed.ravel(),
            "redundant": redundant[each, filter_at].ravel(),
            "unique_fails": only[filter_at].ravel(),
            "good_lost": lost["good"].ravel(),
            "toxic_lost": lost["toxic"].ravel(),
            "shapley": shapley[filter_at].ravel(),
        }
    )


def audit_filters(rows: DataFrame, fails: Mapping[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """For each part, order and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``fails`` has a condition for each filter under a single letter; null counts as passed. ``good`` and ``toxic`` mark the
    documents that are counted when lost. A part is a null-free text. Only counts per part and mask leave the rows' tasks, so neither
    a large part nor a common mask weighs on one task. No rows give no parts and no result.
    """
    letters = "".join(fails)
    if not 1 <= len(fails) <= MOST_FILTERS or any(len(name) != 1 for name in fails):
        raise ValueError(f"between 1 and {MOST_FILTERS} filters of one letter each are needed")
    bits = [F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(fails.values())]
    counts = (
        rows.select(
            part.alias("part"),
            sum(bits[1:], bits[0]).alias("mask"),
            F.when(good, 1).otherwise(0).alias("good"),
            F.when(toxic, 1).otherwise(0).alias("toxic"),
        )
        .groupBy("part", "mask")
        .agg(F.count("*").alias("documents"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    )
    return counts.groupBy("part").applyInPandas(lambda found: audit_part(found, letters), SCHEMA)


def document_facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part`` (the language), the five failure conditions ``A`` to ``E``, ``good`` and ``toxic`` of each row.

    Texts are read once; what is shuffled is a digest and a few flags for each. A row fails E if a smaller id has the same
    text; a row without an id fails it never and has no label. Of an id with several label rows any one counts.
    """
    text = or_empty(F.col("text"))
    words = F.regexp_extract_all(F.col("text"), F.lit(SPACED_WORD), F.lit(0))
    measured = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty(F.col("lang")).alias("part"), text.alias("text"))
        .withColumn("words", words)
        .select(
            "doc_id",
            "part",
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.size("words").alias("n_words"),
            F.size(F.array_distinct("words")).alias("n_distinct"),
            F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"),
            F.length("text").alias("n_chars"),
            F.col("text").rlike(r"[#$%&*|]").alias("D"),
        )
        .select(
            "doc_id",
            "part",
            "digest",
            (F.col("n_words") < 200).alias("A"),
            (100 * F.col("n_distinct").cast("long") < 50 * F.col("n_words").cast("long")).alias("B"),
            (100 * F.col("n_upper").cast("long") > 3 * F.col("n_chars").cast("long")).alias("C"),
            "D",
        )
    )
    facts = stage(measured, "filter-facts")
    known, unknown = facts.filter(F.col("doc_id").isNotNull()), facts.filter(F.col("doc_id").isNull())
    # The smallest id of each text. Matched by both columns, so that the copies of one text are spread over all tasks.
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & (F.col("good") | F.col("toxic")))
        .groupBy("doc_id")
        .agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    )
    joined = known.join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
    told = ["part", "A", "B", "C", "D"]
    no = F.lit(False)
    return joined.select(
        *told, F.col("is_first").isNull().alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    ).unionByName(unknown.select(*told, no.alias("E"), no.alias("good"), no.alias("toxic")))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five document filters, in parts by language.

    A: under 200 words; B: fewer than half of the words distinct; C: over 3 % capital letters A-Z; D: one of ``#$%&*|``; E: the text of a
    smaller id. Words stand between ASCII white space. A null text counts as empty (it fails A alone, and E after the first), a null
    language is the part with the empty name. Rows with equal ids count each. An empty table gives an empty result. Other columns are not read.
    """
    facts = document_facts(docs, labels)
    return audit_filters(facts, {name: F.col(name) for name in "ABCDE"}, F.col("part"), F.col("good"), F.col("toxic"))
