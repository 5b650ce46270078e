from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyline.llm import mixing
from tests.llm.helpers import AWKWARD, LARGER, documents, table


def _targets(sizes, budget=1.5, cap=2.0):
    """Clamp, redistribute, repeat."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    left, open_, target = budget * sum(sizes.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def _words(raw):
    return len((raw or "").encode().split())


def _check(df, rows):
    got = mixing.taken_words(mixing.plan_mix(df)).collect()
    sizes = defaultdict(int)
    for _, raw, source in rows:
        sizes[source] += _words(raw)
    want = _targets(sizes)
    taken = defaultdict(int)
    by_id = {i: (raw, source) for i, raw, source in rows}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in rows)
    for r in got:
        raw, source = by_id[r.doc_id]
        assert r.size == _words(raw) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for source, target in want.items():
        assert taken[source] == pytest.approx(target, abs=2)
    return got


def test_given_table(spark):
    df = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table("documents", LARGER)]
    first = _check(df, rows)
    again = mixing.taken_words(mixing.plan_mix(df.repartition(7))).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


@pytest.mark.parametrize("n_sources", [1, 2, 5])
def test_awkward_rows(spark, n_sources):
    sources = [[None, "a", "", "é", "b"][i % n_sources] for i in range(len(AWKWARD))]
    _check(documents(spark, AWKWARD, None, sources), list(zip(range(99), AWKWARD, sources)))


def test_hot_source_and_many_small_ones(spark):
    texts = ["w " * (1 + i % 90) for i in range(600)]
    sources = ["hot" if i % 3 == 0 else f"s{i % 40}" for i in range(600)]
    _check(documents(spark, texts, None, sources), list(zip(range(600), texts, sources)))


def test_nothing_to_mix(spark):
    assert mixing.taken_words(mixing.plan_mix(documents(spark, []))).collect() == []
    got = mixing.taken_words(mixing.plan_mix(documents(spark, [None, "", " "]))).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3


def test_repeated_ids_are_taken_alike(spark):
    df = documents(spark, ["a b c d"] * 30, ids=[i // 3 for i in range(30)], sources=["s", "t", "t"] * 10)
    first, again = (sorted(map(tuple, mixing.taken_words(mixing.plan_mix(df.repartition(n))).collect())) for n in (1, 6))
    assert first == again


def test_mixed_rows_are_the_documents_as_often_as_taken(spark):
    df = spark.read.parquet(f"{LARGER}/documents.parquet")
    mix = mixing.plan_mix(df)
    rows = mixing.mixed_rows(df, mix)
    assert rows.columns == df.columns
    copies = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    for r in mixing.taken_words(mix).collect():
        if r.size:
            assert copies.get(r.doc_id, 0) == round(r.taken / r.size + 1e-9) or abs(copies.get(r.doc_id, 0) - r.taken / r.size) <= 0.5
    per_source = rows.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
    target = {r.source: r.target for r in mix.plan.collect()}
    largest = max(_words(r["text"]) for r in table("documents", LARGER))
    assert all(abs(r.n - target[r.source]) <= largest for r in per_source)
