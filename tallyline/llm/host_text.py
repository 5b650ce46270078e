"""Main text of pages, without the runs of tokens that other pages of the host repeat.

The blocks of a page outside its article are a stream of tokens. The streams of a host are concatenated, and a suffix array over them
brings suffixes with a common beginning together: a beginning of at least ``min_run`` tokens that distinct pages share is
boilerplate wherever it stands. Only common beginnings of that length matter, so the array is built by prefix doubling up to
that depth: the name of a suffix's first 2k tokens follows from the names of its first k and of the k after them. Names are 64-bit hashes of
the host and the tokens and therefore the same in every task, so each task sorts the suffixes of its own pages and hands on one row for a name
and stream; the arrays are then merged by name. A host of any size is spread over all tasks in this way.

A block that such runs cover goes, and so do those that lie inside a block. What stays are the unique runs, except those that the markup marks as menus, adverts and the
like. Blocks inside the article are not part of the streams: copies of an article, and passages that articles share, are
repeated text too, but belong to the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import blobs
from tallyline.llm.html_blocks import ARTICLE, MARKED, page_blocks
from tallyline.sources.staging import stage

MIN_RUN = 8
"""Tokens of the shortest run that counts as boilerplate when distinct pages repeat it. A block's kind counts as a token."""
AT_ONCE = 1 << 20
"""Tokens of the streams whose suffixes a task sorts at once; 8 MB."""
_SEPARATOR = np.uint64(0)
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Begin a block in the stream.
_BLOCK_STARTS = (b"\x00marked", b"\x00open")


def host_of(url: str | None) -> str:
    """The host in lower case, without user and port; empty if there is none."""
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def stream_tokens(host: str, blocks: list[tuple[int, str]]) -> np.ndarray:
    """64-bit hashes of the tokens outside the article, the start of each block being one. None is the separator."""
    seed = xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"))
    tokens: list[int] = []
    for kind, text in blocks:
        if kind != ARTICLE:
            tokens.append(xxhash.xxh3_64_intdigest(_BLOCK_STARTS[kind], seed) or 1)
            tokens += [xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), seed) or 1 for word in text.split(" ")]
    return np.array(tokens, np.uint64)


def _combine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first ^ (first >> np.uint64(29))) * _MIX + second
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_names(tokens: np.ndarray, length: int) -> np.ndarray:
    """A name for the first ``length`` tokens of every suffix that has as many, by doubling."""
    if len(tokens) < length:
        return np.zeros(0, np.uint64)
    names, known = tokens.astype(np.uint64), 1
    while 2 * known <= length:
        names = _combine(names[:-known], names[known:])
        known *= 2
    rest = length - known
    # The last step overlaps: the first ``known`` tokens and those that end at ``length``.
    return _combine(names[: len(names) - rest], names[rest:]) if rest else names


def covered_tokens(names: np.ndarray, n_tokens: int, length: int, repeated: np.ndarray) -> np.ndarray:
    """Which tokens lie in a run whose name is among the sorted ``repeated``."""
    starts = np.zeros(n_tokens + 1, np.int64)
    if len(names) and len(repeated):
        at = np.minimum(np.searchsorted(repeated, names), len(repeated) - 1)
        hits = np.flatnonzero(repeated[at] == names)
        np.add.at(starts, hits, 1)
        np.add.at(starts, hits + length, -1)
    return np.cumsum(starts)[:n_tokens] > 0


def suffix_intervals(streams: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the concatenated streams, sorted by the name of their beginning: the names, and the streams they lie in.

    Of the suffixes of one stream with one name the first is returned; suffixes that reach over a stream's end have no name.
    """
    whole = np.concatenate([part for stream in streams for part in (stream, [_SEPARATOR])]).astype(np.uint64)
    of_stream = np.repeat(np.arange(len(streams)), [len(stream) + 1 for stream in streams])
    names = prefix_names(whole, length)
    inside = np.flatnonzero(of_stream[: len(names)] == of_stream[length - 1 : length - 1 + len(names)])
    inside = inside[whole[inside + length - 1] != _SEPARATOR]
    order = inside[np.lexsort((of_stream[inside], names[inside]))]
    first = np.ones(len(order), bool)
    first[1:] = (names[order][1:] != names[order][:-1]) | (of_stream[order][1:] != of_stream[order][:-1])
    return names[order][first], of_stream[order][first]


def _digest(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def _stream_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """``name, stream, least, greatest`` for each name and stream of a bounded number of pages, with the smallest and largest page of the stream.

    A page is known by all its text, so that copies of one page are not distinct pages.
    """
    streams: dict[int, list] = {}
    n_tokens = 0

    def rows() -> pa.RecordBatch:
        ids = np.array(list(streams), np.uint64)
        pages = np.array([found[1:] for found in streams.values()], np.uint64).reshape(-1, 2)
        names, at = suffix_intervals([found[0] for found in streams.values()], length)
        columns = [_signed(names), _signed(ids[at]), _signed(pages[at, 0]), _signed(pages[at, 1])]
        return pa.RecordBatch.from_arrays(columns, names=["name", "stream", "least", "greatest"])

    for batch in batches:
        for url, html in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
            blocks, host = page_blocks(html), host_of(url)
            tokens = stream_tokens(host, blocks)
            if len(tokens) < length:
                continue
            stream, page = xxhash.xxh3_64_intdigest(tokens.tobytes()), _digest(*[text for _, text in blocks])
            found = streams.get(stream)
            if found:
                found[1:] = min(found[1], page), max(found[2], page)
            else:
                streams[stream] = [tokens, page, page]
                n_tokens += len(tokens)
            if n_tokens >= AT_ONCE:
                yield rows()
                streams, n_tokens = {}, 0
    if streams:
        yield rows()


def repeated_runs(pages: DataFrame, length: int) -> DataFrame:
    """``stream, names``: the names of each stream's runs that stand on distinct pages of its host.

    ``pages`` has ``url`` and ``html``. A stream is the same for all pages with the same tokens outside the article, and has as many
    names as tokens at most.
    """
    found = pages.mapInArrow(lambda batches: _stream_rows(batches, length), "name long, stream long, least long, greatest long")
    runs = stage(found, "host-runs")
    repeated = runs.groupBy("name").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest")).filter("least < greatest").select("name")
    return runs.select("name", "stream").distinct().join(repeated, "name").groupBy("stream").agg(F.collect_list("name").alias("names"))


def _parsed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``url`` and the blocks of each page as one blob, with the stream of its tokens."""
    for batch in batches:
        packed, streams = [], []
        for url, html in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
            blocks = page_blocks(html)
            texts = [text.encode("utf-8", "surrogatepass") for _, text in blocks]
            kinds, sizes = np.array([kind for kind, _ in blocks], np.uint8), np.array([len(text) for text in texts], np.uint32)
            packed.append(blobs.pack(kinds, sizes, np.frombuffer(b"".join(texts), np.uint8)))
            streams.append(xxhash.xxh3_64_intdigest(stream_tokens(host_of(url), blocks).tobytes()))
        columns = [batch["page_id"], batch["url"], pa.array(packed, pa.binary()), _signed(np.array(streams, np.uint64))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "blocks", "stream"])


def _long_runs(covered: np.ndarray, length: int) -> np.ndarray:
    """What is covered of a block: all of it, or the runs of at least ``length`` tokens inside it.

    A run that comes from the block before may end in a word or two that pages share by chance; those stay.
    """
    if covered.all():
        return covered
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    long_ = np.zeros(len(covered), bool)
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        long_[start:end] = end - start >= length
    return long_


def main_text(host: str, blocks: list[tuple[int, str]], repeated: np.ndarray, length: int) -> tuple[str, int, int]:
    """Text of a page, tokens that went because they are repeated, and those that went by the markup alone."""
    tokens = stream_tokens(host, blocks)
    covered = covered_tokens(prefix_names(tokens, length), len(tokens), length, repeated)
    kept, n_repeated, n_marked, at = [], 0, 0, 0
    for kind, text in blocks:
        if kind == ARTICLE:
            kept.append(text)
            continue
        words = text.split(" ")
        gone = _long_runs(covered[at + 1 : at + 1 + len(words)], length)
        at += 1 + len(words)
        n_repeated += int(gone.sum())
        if kind == MARKED:
            n_marked += int((~gone).sum())
        elif not gone.all():
            kept.append(" ".join(word for word, drop in zip(words, gone.tolist()) if not drop))
    return "\n\n".join(kept), n_repeated, n_marked


def _text_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for url, blob, names in zip(batch["url"].to_pylist(), batch["blocks"].to_pylist(), batch["names"].to_pylist()):
            kinds, sizes, raw = blobs.unpack(blob, "u1", "u4", "u1")
            ends = np.cumsum(sizes.astype(np.int64)).tolist()
            whole = raw.tobytes()
            blocks = [(kind, whole[a:b].decode("utf-8", "surrogatepass")) for kind, a, b in zip(kinds.tolist(), [0, *ends], ends)]
            repeated = np.sort(np.array(names or [], np.int64).view(np.uint64))
            texts.append(main_text(host_of(url), blocks, repeated, length))
        columns = [batch["page_id"], batch["url"], pa.array([t for t, _, _ in texts], pa.string()), pa.array([len(t) for t, _, _ in texts], pa.int64())]
        columns += [pa.array([found[i] for found in texts], pa.int64()) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_repeated", "n_marked"])


def extract_text(pages: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars, n_repeated, n_marked``.

    ``text`` has the blocks of the article and the unique runs of the blocks that the markup leaves undecided, in page order,
    joined by two newlines. ``n_repeated`` counts the tokens outside the article that go because distinct pages of the host repeat them in runs of ``min_run`` tokens or
    more, ``n_marked`` the others that are gone because their markup says that they are no article. Pages whose text is equal
    are one page, so that copies do not make each other boilerplate. A null or empty html gives an empty text; pages with a null url share the host
    with the empty name; rows that repeat come out as often. An empty table gives an empty result. Other columns are not read.
    Reads the pages twice and shuffles them once.
    """
    if min_run < 1:
        raise ValueError("a run has at least one token")
    kept_id = pages.schema["page_id"].dataType.simpleString()
    read = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    runs = repeated_runs(read.select("url", "html"), min_run)
    parsed = read.mapInArrow(_parsed_rows, f"page_id {kept_id}, url string, blocks binary, stream long")
    # Many pages of one host may share a stream. Their rows are on the side that Spark may split.
    joined = parsed.join(stage(runs, "repeated-runs"), "stream", "left").select("page_id", "url", "blocks", "names")
    return joined.mapInArrow(
        lambda batches: _text_rows(batches, min_run),
        f"page_id {kept_id}, url string, text string, n_chars long, n_repeated long, n_marked long",
    )
