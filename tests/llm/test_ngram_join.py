from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import components, ngram_join
from tallyline.llm.text import lower_bytes, words
from tests.llm.helpers import AWKWARD, LARGER, documents, table


def _shingles(raw, n=5):
    own = words(lower_bytes(raw))
    return frozenset(tuple(own[i : i + min(n, len(own))]) for i in range(max(len(own) - n, 0) + 1)) if own else frozenset()


def _expected(rows, threshold=0.8):
    """All pairs compared."""
    sets = [_shingles(raw) for _, raw in rows]
    linked = np.zeros((len(rows), len(rows)), bool)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 10 * len(a & sets[j]) >= 10 * threshold * len(a | sets[j]):
                linked[i, j] = linked[j, i] = True
    ids = np.array([i for i, _ in rows], np.int64)
    least = ngram_join._smallest_reachable(linked, ids)
    same = {}
    for i, s in zip(ids.tolist(), sets):
        if s:
            same[s] = min(i, same.get(s, i))
    return sorted((int(i), same.get(s, int(i)), int(n), int(c)) for i, s, n, c in zip(ids, sets, linked.sum(axis=1), least))


def _result(df, **options):
    return sorted(tuple(r) for r in ngram_join.ngram_join(df, **options).collect())


def test_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents", LARGER)]
    assert _result(spark.read.parquet(f"{LARGER}/documents.parquet")) == _expected(rows)


def _near_copies(n, seed=0, length=120):
    """Versions of one text, each with a few words changed."""
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(1000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, length, rng.integers(0, 4)):
            own[at] = f"x{rng.integers(1000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [256, 16])
def test_large_groups_are_compared_in_blocks(spark, block):
    texts = _near_copies(150) + _near_copies(20, 1) + _near_copies(3, 2, 8) + ["copy " * 9] * 40
    assert _result(documents(spark, texts), block=block) == _expected(list(enumerate(texts)))


def test_awkward_rows(spark):
    assert _result(documents(spark, AWKWARD)) == _expected(list(enumerate(AWKWARD)))


def test_null_and_repeated_ids(spark):
    df = documents(spark, ["a b c d e f"] * 4, ids=[None, 3, 3, 5])
    got = sorted((tuple(r) for r in ngram_join.ngram_join(df).collect()), key=str)
    assert got == sorted([(None, None, 0, None), (3, 3, 2, 3), (3, 3, 2, 3), (5, 3, 2, 3)], key=str)


def test_an_id_that_repeats_with_different_texts(spark):
    """Three texts under id 3, of which two are each nearly the same as another row's, and id 3 is the smallest of both classes."""
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    texts = [" ".join(a), " ".join(b), "something else altogether here", " ".join(a[:-1]), " ".join(b[1:]), " ".join(a)]
    df = documents(spark, texts, ids=[3, 3, 3, 5, 4, 9])
    got = sorted((r.doc_id, r.class_id, r.n_links, r.component_id) for r in ngram_join.ngram_join(df).collect())
    assert got == [(3, 3, 0, 3), (3, 3, 1, 3), (3, 3, 2, 3), (4, 4, 1, 3), (5, 5, 2, 3), (9, 3, 2, 3)]
    kept = ngram_join.keep_one_per_component(df, ngram_join.ngram_join(df))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 3, 3]


@pytest.mark.parametrize("texts", [[], [None], ["one text"]])
def test_tiny_tables(spark, texts):
    assert _result(documents(spark, texts)) == [(i, i, 0, i) for i in range(len(texts))]


def test_long_texts_with_one_change(spark):
    base = [f"w{i}" for i in range(60_000)]
    texts = [" ".join(base), " ".join([*base[:30_000], "new", *base[30_000:]]), " ".join(base[:30_000])]
    assert _result(documents(spark, texts)) == [(0, 0, 1, 0), (1, 1, 1, 0), (2, 2, 0, 2)]


def test_prefixes_are_shortened_until_the_recall_is_reached():
    for recall in (0.5, 0.9, 0.999, 0.9999):
        lengths = ngram_join.prefix_lengths(0.8, recall, 14, 4)
        assert 1 - np.prod([1 - 0.8**n for n in lengths]) >= recall
        longer = sorted(lengths)
        longer[0] += 1
        assert longer[0] > 4 or 1 - np.prod([1 - 0.8**n for n in longer]) < recall


def test_signatures_estimate_the_similarity():
    minhash, shingles = ngram_join.MinHash(400), ngram_join.Shingles(5)
    a, b = (shingles.of_text(" ".join(f"w{i}" for i in range(k, k + 500))) for k in (0, 50))
    assert np.mean(minhash.of(a) == minhash.of(b)) == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)), abs=0.06)


def test_one_of_each_component_stays(spark):
    df = spark.read.parquet(f"{LARGER}/documents.parquet")
    joined = ngram_join.ngram_join(df)
    kept = ngram_join.keep_one_per_component(df, joined)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({r.component_id for r in joined.collect()})


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(1, 2), (2, 3), (3, 1), (9, 9), (5, 4), (4, 5)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    sizes = Counter(r.component for r in got.collect())
    assert sizes == {100: 61, 7: 101, 1: 3, 4: 2}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert got.filter(F.col("node") < F.col("component")).count() == 0
