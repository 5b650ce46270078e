from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import filter_audit, queries
from tests.compare import differences, oracle_rows
from tests.llm.helpers import LARGER, documents

LABELS = "doc_id long, quality int, toxic int, text string"


def _fails(rows):
    """Masks by the letter of the contract, one document after the other."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, *_ in rows),
        }
        out.append({name for name, failed in fails.items() if failed})
    return out


def brute_force(rows, labels):
    """Each filter run in turn over the documents left, for every order and part."""
    fails, result = _fails(rows), {}
    good = {i for i, q, _, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    for part in {lang or "" for _, _, lang, *_ in rows}:
        members = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = Counter()
        found = []
        for order in permutations("ABCDE"):
            left, gone = list(members), []
            for step, name in enumerate(order, 1):
                out = [m for m in left if name in m[1]]
                redundant = sum(name in m[1] for m in gone)
                left, gone = [m for m in left if name not in m[1]], gone + out
                shapley[name] += len(out)
                found.append((order, step, name, len(left), len(out), redundant, sum(m[1] == {name} for m in members),
                              sum(m[0] in good for m in out), sum(m[0] in toxic for m in out)))
        for order, step, name, *numbers in found:
            result[part, "".join(order), step] = (*numbers, shapley[name])
    return result


def rows_of(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = df.collect()
    assert len({(r.part, r.filter_order, r.step) for r in found}) == len(found)
    return {(r.part, r.filter_order, r.step): tuple(r[name] for name in names) for r in found}


def test_awkward_rows_against_filters_run_one_after_the_other(spark):
    long_text = " ".join(f"w{i}" for i in range(300))
    texts = [
        (1, long_text, "en"), (2, long_text, "en"), (2, long_text, None), (2, long_text, "en"), (None, long_text, "en"), (None, None, "en"),
        (5, None, "de"), (4, "", "de"), (6, "same " * 250, "en"), (7, "same " * 250, "en"), (8, "A B C #", "fr"), (9, long_text + " X" * 60, "fr"),
        (10, "\x1cone\x85two\v" * 200, ""), (11, "x" * 200_000 + " |", "fr"), (0, "A B C #", "en"), (12, long_text + " &", "fr"), (13, long_text + " $", "fr"),
    ]
    docs = spark.createDataFrame([(*t, "x", 5, True) for t in texts], "doc_id long, text string, lang string, part string, A int, is_first boolean")
    labels = [(1, 1, 0, "t"), (2, 0, 1, "t"), (2, 1, None, "t"), (None, 1, 1, "t"), (8, None, 1, "t"), (9, 1, 1, "t"), (99, 1, 1, "t"), (11, 1, 0, "t")]
    found = rows_of(filter_audit.audit_documents(docs, spark.createDataFrame(labels, LABELS)))
    expected = brute_force(texts, labels)
    assert found == expected
    assert len(found) == 120 * 5 * 4


def test_random_masks(spark):
    rng = np.random.default_rng(4)
    words = ["a", "B", "#", "w x y", "same same same", *[f"t{i}" for i in range(40)]]
    texts = [(int(i), " ".join(rng.choice(words, rng.integers(0, 320))), str(rng.choice(["en", "de"]))) for i in rng.permutation(120) // 2]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2)), "t") for i in range(0, 60, 2)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert rows_of(filter_audit.audit_documents(docs, spark.createDataFrame(labels, LABELS))) == brute_force(texts, labels)


def test_removal_steps_are_the_smallest_place_of_a_failed_filter():
    orders, places = filter_audit.orders_and_places("ABC")
    assert sorted(orders) == sorted("".join(p) for p in permutations("ABC"))
    masks = np.arange(8)
    steps = filter_audit.removal_steps(masks, places)
    for m in masks:
        for o, order in enumerate(orders):
            hit = [i for i, name in enumerate(order, 1) if m >> "ABC".index(name) & 1]
            assert steps[m, o] == min(hit, default=4)


def test_empty_table_and_wrong_filters(spark):
    docs = documents(spark, ["a"]).limit(0)
    assert filter_audit.audit_documents(docs, spark.createDataFrame([], LABELS)).collect() == []
    with pytest.raises(ValueError):
        filter_audit.audit_filters(docs, {}, F.col("lang"), F.lit(True), F.lit(True))


def test_other_filters_under_the_general_interface(spark):
    rows = spark.range(100).withColumn("part", F.lit("all"))
    found = rows_of(filter_audit.audit_filters(rows, {"x": F.col("id") % 2 == 0, "y": F.col("id") % 3 == 0}, F.col("part"), F.col("id") < 10, F.lit(None).cast("boolean")))
    # Of 100 numbers 50 are even, 34 divisible by three, 17 both.
    assert found["all", "xy", 1] == (50, 50, 0, 33, 5, 0, 83)
    assert found["all", "xy", 2] == (33, 17, 17, 17, 2, 0, 51)
    assert found["all", "yx", 2] == (33, 33, 17, 33, 3, 0, 83)


def test_query_equals_sql(spark):
    sf = LARGER
    name = "op12_filter_audit"
    assert differences(queries.queries()[name](spark, sf), oracle_rows(sf, queries.oracle_sql()[name])) == ""
