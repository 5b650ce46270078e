from __future__ import annotations

import gc
import weakref
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyline.llm import packing, pretokens
from tests.llm.helpers import AWKWARD, LARGER, documents, table


def _check(df, rows, sequence):
    """Every id in one piece, sequences without gaps, all full but the last, and each with the same mixture."""
    path = pretokens.tokenizer_path()
    want = defaultdict(list)
    for doc_id, raw, _ in rows:
        want[doc_id].append([*pretokens.encode_whole(path, [raw or ""])[0], packing.SEPARATOR])
    pieces = packing.pack(df, sequence=sequence).collect()
    of_docs, of_sequences, per_source = defaultdict(list), defaultdict(list), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        ids = np.frombuffer(p.ids, pretokens.id_type(path))
        assert len(ids) == p.length and zlib.crc32(ids.astype("<u4")) == p.ids_crc32
        of_docs[p.doc_id].append((p.start, ids.tolist(), p.doc_tokens))
        of_sequences[p.sequence_id].append((p.offset, p.length))
        per_source[p.sequence_id][p.source] += p.length
    total = sum(len(ids) for docs in want.values() for ids in docs)
    assert sorted(of_sequences) == list(range(-(-total // sequence)))
    for k, parts in of_sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == (sequence if k < len(of_sequences) - 1 else total - sequence * k)
    for doc_id, docs in want.items():
        assert sum(len(ids) for _, ids, _ in of_docs[doc_id]) == sum(map(len, docs))
        if len(docs) == 1:
            parts = sorted(of_docs[doc_id])
            assert [x for _, ids, _ in parts for x in ids] == docs[0]
            assert [start for start, _, _ in parts] == np.cumsum([0, *[len(ids) for _, ids, _ in parts[:-1]]]).tolist()
            assert {n for _, _, n in parts} == {len(docs[0])}
    return per_source, total


@pytest.mark.parametrize("sequence", [4096, 128])
def test_given_table(spark, sequence):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table("documents", LARGER)]
    df = spark.read.parquet(f"{LARGER}/documents.parquet").repartition(5, "doc_id")
    per_source, total = _check(df, rows, sequence)
    shares = defaultdict(int)
    for counts in per_source.values():
        for source, n in counts.items():
            shares[source] += n
    del per_source[max(per_source)]
    for counts in per_source.values():
        for source, n in shares.items():
            if n * sequence >= total:
                assert abs(counts[source] - n * sequence / total) <= 2


@pytest.mark.parametrize("sequence", [4096, 16, 1])
def test_awkward_rows(spark, sequence):
    texts = [t if t is None or len(t) < 1000 else t[:400] for t in AWKWARD]
    sources = [None if i % 4 == 0 else f"s{i % 5}" for i in range(len(texts))]
    ids = [i if i % 3 else 0 for i in range(len(texts))]
    _check(documents(spark, texts, ids, sources), list(zip(ids, texts, sources)), sequence)


def test_rare_sources_share_a_queue(spark):
    texts = ["word " * 3000] + ["x"] * 40
    sources = ["large"] + [f"rare{i}" for i in range(40)]
    _check(documents(spark, texts, None, sources), list(zip(range(41), texts, sources)), 64)


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).collect() == []


def test_long_text(spark):
    texts = ["many words " * 40_000, "few"]
    _check(documents(spark, texts), [(i, t, None) for i, t in enumerate(texts)], 4096)


def test_padding():
    assert [packing.padded_length(n) for n in (1, 3, 64, 4095, 4096)] == [1, 4096, 64, 4096, 4096]


def test_a_worker_remembers_ids_from_task_to_task(monkeypatch):
    path = pretokens.tokenizer_path()
    ids = pretokens.worker_ids(path, "<u2")
    assert pretokens.worker_ids(path, "<u2") is ids and pretokens.worker_ids(path, "<u4") is not ids
    texts = ["The words, of one text's 'll 12a", "other words; of\nanother\ttext", "it's x'se ''s's 3'd don't\r\nwe've", "x" * 500 + "'s9", "<|endoftext|> é ½", ""]
    texts += [r["text"] or "" for r in table("documents")[:60]]
    expected = [pretokens.encode_whole(path, [t])[0] for t in texts]

    def read():
        return [np.frombuffer(ids.of_text(t), "<u2").tolist() for t in texts]

    assert read() == expected
    assert read() == expected
    # A full memory starts anew and still knows everything it is asked.
    monkeypatch.setattr(ids.memo, "size", 20)
    assert read() == expected


def round_robin(tokens_of, sequence):
    """Windows filled one after the other from the queues in order of their names: each gets its share of the window and of what it was
    owed, rounded down over the running total, and the last queue of a window the rest."""
    total = sum(tokens_of.values())
    sizes = sorted(tokens_of.items())
    given = dict.fromkeys(tokens_of, 0)
    windows = []
    for k in range(-(-total // sequence)):
        end, filled, window = 0, 0, {}
        upto = min(total, sequence * (k + 1))
        for name, size in sizes:
            end += size
            # What this queue and those before it are owed after this window, less what they got.
            owed = end if upto == total else upto * end // total
            window[name] = owed - filled - sum(given[n] for n, _ in sizes[: sizes.index((name, size)) + 1])
            filled += window[name]
        for name, n in window.items():
            given[name] += n
        windows.append(window)
    return windows


@pytest.mark.parametrize("sequence", [16, 50])
def test_against_round_robin_window_by_window(spark, sequence):
    texts = ["a b c d e f g " * n for n in (9, 1, 4, 30, 2, 7, 5, 12)]
    sources = ["x", "y", "x", "z", "y", "z", "x", "y"]
    rows = packing.pack(documents(spark, texts, None, sources), sequence=sequence).collect()
    tokens_of = defaultdict(int)
    got = defaultdict(lambda: defaultdict(int))
    for r in rows:
        tokens_of[r.source] += r.length
        got[r.sequence_id][r.source] += r.length
    assert [dict(got[k]) for k in sorted(got)] == [{n: c for n, c in w.items() if c} for w in round_robin(tokens_of, sequence)]


def test_a_worker_gives_back_what_it_learnt():
    """Workers are shared by the stages: the next one needs the memory."""
    path = pretokens.tokenizer_path()
    pretokens.worker_ids(path, "<u2").of_text("some words to learn")
    assert pretokens.worker_ids.cache_info().currsize == 1
    pretokens.forget()
    assert pretokens.worker_ids.cache_info().currsize == pretokens.load.cache_info().currsize == 0


def test_what_a_worker_learnt_goes_at_once():
    """Not only when Python next looks for cycles, which texts and bytes do not make it do."""
    path = pretokens.tokenizer_path()
    pretokens.forget()
    ids = pretokens.worker_ids(path, "<u2")
    ids.of_text("some words to learn")
    gone = weakref.ref(ids)
    gc.disable()
    try:
        del ids
        pretokens.forget()
        assert gone() is None
    finally:
        gc.enable()


def test_packing_holds_few_rows_at_once():
    whole = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (0, 1, 1200, 500)]
    parts = list(packing.few_rows(iter(whole)))
    assert [len(p) for p in parts] == [1, 500, 500, 200, 500]
    assert [x for p in parts for x in p["a"].to_pylist()] == [x for b in whole for x in b["a"].to_pylist()]


def test_cutting_needs_nothing_that_encoding_learnt():
    path = pretokens.tokenizer_path()
    blob = pretokens.worker_ids(path, "<u2").of_text("some words to learn")
    n = len(blob) // 2
    row = {"doc_id": 1, "source": "sx", "begin": 0, "n": n, "queue_size": n, "queue_end": n, "ids": blob}
    for kind, ids in (("<u2", blob), ("<u4", np.frombuffer(blob, "<u2").astype("<u4").tobytes())):
        (out,) = packing.cutter(n, 4096, True)(iter([pa.RecordBatch.from_pylist([row | {"ids": ids}])]))
        assert pretokens.worker_ids.cache_info().currsize == pretokens.load.cache_info().currsize == 0
        assert out["ids"][0].as_py() == ids and out["length"][0].as_py() == n
        assert out["ids_crc32"][0].as_py() == zlib.crc32(np.frombuffer(ids, kind).astype("<u4"))
