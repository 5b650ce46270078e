from __future__ import annotations

from tallyline.llm import pretokens, token_counts
from tests.llm.helpers import AWKWARD, LARGER, documents, table

TEXTS = [
    *AWKWARD,
    "It's we'll I'VE they're'd '' ''s 'S x'y",
    "Ünïcödé Straße œuvre ŒUVRE ÀÉ … — “quoted” €5",
    "a\x0bb\x0cc d e",
    "<|startoftext|>hi<|endoftext|><|nope|>",
    "é combining, Å ﬁ Ⅷ ١٢٣ 𝒳 🙂🙂",
    "12345 3.14 x2y ____ ==>!!",
    "word " * 30_000,
]


def _expected(texts):
    path = pretokens.tokenizer_path()
    return [len(x) for x in pretokens.encode_whole(path, [t or "" for t in texts])]


def test_counts_equal_the_library(spark):
    got = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, TEXTS)).collect()}
    for i, (raw, n) in enumerate(zip(TEXTS, _expected(TEXTS))):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((raw or "").encode()), n > 2048), raw


def test_given_table(spark):
    rows = table("documents", LARGER)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.read.parquet(f"{LARGER}/documents.parquet")).collect()}
    assert got == {r["doc_id"]: n for r, n in zip(rows, _expected([r["text"] for r in rows]))}


def test_pieces_of_every_listed_character(spark):
    plain = [chr(c) for c in range(0x2100) if pretokens.PLAIN.fullmatch(chr(c))]
    texts = [f"{a}{b} x{a}7{b}{a}'S" for a in plain for b in ("a", "É", ".", "'", "5")]
    path = pretokens.tokenizer_path()
    memo = pretokens.Memo(path, lambda ids, ends: [ids[a:b] for a, b in zip([0, *ends], ends)])
    for raw, ids in zip(texts, pretokens.encode_whole(path, texts)):
        assert [x for part in memo.values(pretokens.split(raw)) for x in part] == ids, raw


def test_cache_stays_bounded():
    memo = pretokens.Memo(pretokens.tokenizer_path(), pretokens.lengths, {"the": 1}, size=50)
    for i in range(0, 1000, 10):
        memo.values(["the", *[f"word{k}" for k in range(i, i + 10)]])
        assert len(memo.known) <= 51


def test_empty_table(spark):
    assert token_counts.count_tokens(documents(spark, [])).collect() == []


def test_null_and_repeated_ids(spark):
    got = token_counts.count_tokens(documents(spark, ["a b", "a b", "c"], ids=[1, 1, None])).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 2), ("1", 2), ("None", 1)]
