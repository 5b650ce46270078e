from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyline.llm import katz
from tests.llm.helpers import AWKWARD, LARGER, documents, table


def _tokens(raw):
    return [*(raw or "").encode().lower().split(), None]


class Plain:
    """The same model, one dictionary entry at a time."""

    def __init__(self, rows):
        train = [_tokens(raw) for i, raw in rows if not _held(i)]
        self.one = Counter(t for text in train for t in text)
        self.two = Counter(pair for text in train for pair in zip([b""] + text, text))
        self.n = self.one.total()
        self.factor1, self.factor2 = (
            katz.discounts(np.array([0] + [sum(c == r for c in counts.values()) for r in range(1, 7)], float))
            for counts in (self.one, self.two)
        )
        self.unknown = 1 - sum(self.p1(w) for w in self.one) if self.n else 1.0
        self.after = defaultdict(list)
        for v, w in self.two:
            self.after[v].append(w)

    def p1(self, w):
        c = self.one[w]
        return self.factor1[min(c, 6)] * c / self.n if c else self.unknown

    def p2(self, v, w):
        if v not in self.after:
            return self.p1(w)
        total = sum(self.two[v, x] for x in self.after[v])
        kept = sum(self.factor2[min(self.two[v, x], 6)] * self.two[v, x] for x in self.after[v])
        divisor = total if total - kept > 1e-9 * total else total + 1
        if c := self.two[v, w]:
            return self.factor2[min(c, 6)] * c / divisor
        return (1 - kept / divisor) / max(1 - sum(self.p1(x) for x in self.after[v]), self.unknown) * self.p1(w)

    def result(self, i, raw):
        tokens = _tokens(raw)
        base = sum(math.log10((self.one[t] + 1) / (self.n + len(self.one) + 1)) for t in tokens)
        score = sum(math.log10(self.p2(v, w)) for v, w in zip([b""] + tokens, tokens))
        return (i, _held(i), len(tokens), sum(self.one[t] > 0 for t in tokens), self.n, base, score)


def _held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _check(df, rows, **sizes):
    got = sorted((tuple(r) for r in katz.score_texts(df, **sizes).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    plain = Plain(rows)
    want = sorted((plain.result(*row) for row in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    return plain


def test_small_corpus_against_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "The", "cat", "sat", "on", f"w{i}", f"v{i % 7}"], rng.integers(0, 60))) for i in range(300)]
    df = documents(spark, texts).repartition(4, "doc_id")
    # Small chunks and partitions, and contexts that are spread over the partitions.
    plain = _check(df, list(enumerate(texts)), chunk_tokens=500, part_tokens=200)
    assert plain.one[b"the"] * katz.HOT_PARTS > 200
    for v in [b"the", b"cat", b"", b"w1", b"never"]:
        assert sum(plain.p2(v, w) for w in plain.one) + plain.p2(v, b"not met") == pytest.approx(1)


def test_given_table_against_brute_force(spark):
    rows = [(r["doc_id"], " ".join((r["text"] or "").split()[:80])) for r in table("documents")]
    _check(documents(spark, [t for _, t in rows], [i for i, _ in rows]), rows, chunk_tokens=3000)


def test_awkward_rows(spark):
    texts = [t if t is None or len(t) < 1000 else t[:300] for t in AWKWARD]
    ids = [None, None, 3, 3, *range(4, 4 + len(texts) - 4)]
    _check(documents(spark, texts, ids), list(zip(ids, texts)))


@pytest.mark.parametrize("texts", [[], [None], ["a"], ["a a a a a a a a"] * 12])
def test_tiny_tables(spark, texts):
    _check(documents(spark, texts), list(enumerate(texts)))


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    got = katz.score_texts(spark.read.parquet(f"{LARGER}/documents.parquet")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert (got.score <= 0).all() and len(got) == 1000


def test_discounts():
    out = katz.discounts(np.array([0, 1000, 400, 200, 120, 80, 60.0]))
    assert out[-1] == 1 and ((out[1:-1] > 0) & (out[1:-1] < 1)).all()
    assert (katz.discounts(np.array([0, 3, 0, 0, 0, 0, 9.0]))[1:] > 0).all()
    assert (katz.discounts(np.zeros(7))[1:] > 0).all()


def test_a_frequent_context_is_split_by_its_share_of_a_partition():
    counts = {7: 501, 9: 499, 11: 500_000, 0: 2_000}
    split = katz.Split.of(counts, 2_000)
    assert dict(zip(split.numbers.tolist(), split.pieces.tolist())) == {0: 4, 7: 2, 11: 1000}
    rng = np.random.default_rng(1)
    context, second = rng.choice([0, 7, 9, 11, 13], 40_000).astype(np.uint64), rng.integers(0, 5_000, 40_000).astype(np.uint64)
    part = split.partitions(context, second, 64)
    assert part.max() < 64
    # One bigram, one partition; one context, at most as many as it has pieces.
    assert len(set(zip(context.tolist(), second.tolist()))) == len(set(zip(context.tolist(), second.tolist(), part.tolist())))
    found = {c: len(set(part[context == c].tolist())) for c in (0, 7, 9, 11, 13)}
    assert found[9] == found[13] == 1 and 2 <= found[0] <= 4 and found[7] == 2 and found[11] > 60
    assert np.bincount(part[context == 11].astype(int), minlength=64).max() < 4 * (context == 11).sum() / 64
    nothing = katz.Split.of({}, 2_000)
    assert (nothing.partitions(context, second, 64) == katz._partition(context, 64)).all()
