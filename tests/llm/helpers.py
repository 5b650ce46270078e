"""Small tables with awkward rows, and the given tables as plain Python."""

from __future__ import annotations

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size int, label string"


def table(name: str, sf: str = SF) -> list[dict]:
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def documents(spark, texts, ids=None, sources=None):
    """Texts as documents, with extra columns whose names operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"src{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [(i, t, "en", s, None, 7, "x") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCUMENTS)


AWKWARD = [None, "", "  \n", "a", "A", "one two", "One  two", "ıİK ǅ 한국어 \x1f\x85 x", "license " * 5000, "same text here", "same text here", "<|endoftext|> 's'S ½²"]
