from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from tallyline.llm import exact_dedup
from tests.llm.helpers import AWKWARD, LARGER, documents, table


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[_lower(text)].append(doc_id)
    return sorted(
        (i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    )


def _result(df):
    return sorted(tuple(r) for r in exact_dedup.find_duplicates(df).collect())


def test_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents", LARGER)]
    assert _result(spark.read.parquet(f"{LARGER}/documents.parquet")) == _expected(rows)


def test_awkward_rows(spark):
    assert _result(documents(spark, AWKWARD)) == _expected(list(enumerate(AWKWARD)))


def test_full_filter_lets_rows_through_but_loses_none(spark):
    texts = [f"text {i % 40}" for i in range(100)]
    df = documents(spark, texts)
    digests = df.select("doc_id", exact_dedup.normalised_sha256(df.text).alias("k"))
    marked = exact_dedup.mark_suspects(digests, "k", exact_dedup.repeated_bits(digests, "k", 64), 64)
    assert marked.filter("suspect__").count() == 100


def test_single_rows_pass_without_a_shuffle(spark):
    df = documents(spark, [f"text {i}" for i in range(200)] + ["copy"] * 50)
    digests = df.select("doc_id", exact_dedup.normalised_sha256(df.text).alias("k"))
    marked = exact_dedup.mark_suspects(digests, "k", exact_dedup.repeated_bits(digests, "k"))
    assert marked.filter("suspect__").count() == 50


def test_repeated_and_null_ids(spark):
    df = documents(spark, ["a", "A", "a", "b", None], ids=[None, 5, 5, None, None])
    got = exact_dedup.find_duplicates(df).collect()
    assert sorted((r.keep_id, r.group_size) for r in got if r.group_size == 3) == [(5, 3)] * 3
    assert sum(r.kept for r in got) == 3


@pytest.mark.parametrize("texts", [[], ["x"]])
def test_tiny_tables(spark, texts):
    df = documents(spark, texts)
    assert exact_dedup.find_duplicates(df).count() == len(texts)
    assert exact_dedup.drop_duplicate_texts(df).count() == len(texts)


def test_dropping_keeps_whole_rows(spark):
    df = documents(spark, [*AWKWARD, "Same TEXT here"])
    kept = exact_dedup.drop_duplicate_texts(df)
    assert kept.columns == df.columns
    expected = {r[0] for r in _expected(list(enumerate([*AWKWARD, "Same TEXT here"]))) if r[3]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)
