"""A bigram language model with Katz backoff, counted on the corpus and applied to all of it.

The texts are cut into chunks of tokens, and only what is distinct in a chunk travels. The words of a
chunk go to the partition of their hash, which counts them and answers with their numbers and counts. Then
the bigrams go to the partition of their first word, where all bigrams of a context meet: there the
counts are discounted after Good and Turing, the backoff weight of the context is what makes its
probabilities sum to one, and every chunk gets back the sums of its texts' tokens. A context with more tokens than a part of a
partition is split by the second word, into pieces that go to partitions of their own; its few totals are added up first.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.blobs import groups, pack, steps, unpack
from tallyline.llm.text import lower_bytes, spaced_words
from tallyline.sources.staging import stage

CHUNK_TOKENS = 1_500_000
PART_TOKENS = 2_000_000
HOT_PARTS = 4
"""A context with more than a quarter of a partition's tokens is split into as many pieces as it has such quarters."""
START, UNKNOWN, FIRST_WORD = 0, 1, 2
LARGEST = 5
"""Counts above it are not discounted."""
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def discounts(n_of_count: np.ndarray) -> np.ndarray:
    """What each count is multiplied by, for counts 0 to LARGEST + 1; the last stands for all above.

    ``n_of_count[r]`` is how many kinds occur r times. Good-Turing with Katz's correction where it gives factors
    between 0 and 1; on tables too small or odd for that, absolute discounting by the share of what occurs once.
    """
    n = np.asarray(n_of_count, float)
    out = np.ones(LARGEST + 2)
    r = np.arange(1, LARGEST + 1)
    if (n[1 : LARGEST + 2] > 0).all():
        beyond = (LARGEST + 1) * n[LARGEST + 1] / n[1]
        if beyond < 1:
            out[1:-1] = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond)
            if ((out[1:-1] > 0) & (out[1:-1] < 1)).all():
                return out
    once = (n[1] + 0.5) / (n[1] + 2 * n[2] + 1)
    out[1:] = (np.arange(1, LARGEST + 2) - once) / np.arange(1, LARGEST + 2)
    return out


@dataclass(frozen=True)
class Unigrams:
    """Totals of the training words: tokens, kinds, discounts, and what is left for words not met."""

    tokens: int
    kinds: int
    factor: np.ndarray
    unknown: float

    @classmethod
    def of(cls, counts: np.ndarray, kinds: np.ndarray) -> Unigrams:
        """``kinds[i]`` words occur ``counts[i]`` times."""
        n = np.zeros(LARGEST + 2)
        for r in range(1, LARGEST + 2):
            n[r] = kinds[counts == r].sum()
        tokens = int((counts * kinds).sum())
        factor = discounts(n)
        known = (factor[np.minimum(counts, LARGEST + 1)] * counts * kinds).sum() / tokens if tokens else 0.0
        return cls(tokens, int(kinds.sum()), factor, float(1 - known))

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words by their counts; all words not met share one probability."""
        known = self.factor[np.minimum(counts, LARGEST + 1)] * counts / max(self.tokens, 1)
        return np.where(counts > 0, known, self.unknown)


def backoff(kept: np.ndarray, total: np.ndarray, seen: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """The divisor of each context's counts and its backoff weight.

    ``kept`` is the sum of its discounted counts, ``total`` that of its counts, ``seen`` the sum of the
    unigram probabilities of the words met after it. Where nothing was discounted, one more event
    is added to the total. A context never met has weight 1.
    """
    divisor = np.where(total - kept > 1e-9 * np.maximum(total, 1), total, total + 1)
    weight = (1 - kept / np.maximum(divisor, 1)) / np.maximum(1 - seen, unknown)
    return divisor, np.where(total > 0, weight, 1.0)


def _partition(numbers: np.ndarray, parts: int | np.ndarray) -> np.ndarray:
    return ((numbers * _MIX) >> np.uint64(33)) % np.asarray(parts, np.uint64)


@dataclass(frozen=True)
class Split:
    """The contexts that are split, in ascending order of their numbers, and into how many pieces each."""

    numbers: np.ndarray
    pieces: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, int], part_tokens: int) -> Split:
        some = {n: -(-c * HOT_PARTS // part_tokens) for n, c in counts.items() if c * HOT_PARTS > part_tokens}
        numbers = np.array(sorted(some), np.uint64)
        return cls(numbers, np.array([some[n] for n in numbers.tolist()], np.uint64))

    def partitions(self, context: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
        """Where each bigram belongs: with all others of its context, or of its piece of it."""
        key = context
        if len(self.numbers):
            at = np.minimum(np.searchsorted(self.numbers, context), len(self.numbers) - 1)
            piece = _partition(second, self.pieces[at]) + np.uint64(1)
            key = np.where(self.numbers[at] == context, (context ^ (context >> np.uint64(31))) * _MIX + piece * np.uint64(0xD6E8FEB86659FD93), context)
        return _partition(key, parts)


_CHUNKS = (
    "chunk long, doc_ids array<long>, held array<boolean>, n_tokens array<int>, tokens binary, hashes binary, counts binary"
)


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Texts as numbers of the chunk's distinct words, the most frequent first; word 0 is the end of a text."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId() << 32, itertools.count()
        docs_of, held_of, lengths, tokens = [], [], [], []
        numbers: defaultdict = defaultdict(itertools.count(1).__next__)

        def chunk() -> pa.RecordBatch:
            raw = np.concatenate(tokens)
            used = np.repeat(~np.array(held_of), lengths)
            n = len(numbers) + 1
            order = np.argsort(-np.bincount(raw, minlength=n)[1:], kind="stable") + 1
            place = np.zeros(n, np.uint32)
            place[order] = np.arange(1, n)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, n - 1)
            # The end of a text is a word that no text holds.
            hashes = np.concatenate([[np.uint64(xxhash.xxh3_64_intdigest(b" "))], hashes[order - 1]])
            counts = np.bincount(place[raw[used]], minlength=n).astype(np.uint32)
            row = [task + next(nth)], [docs_of], [held_of], [lengths], [pack(place[raw])], [pack(hashes)], [pack(counts)]
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()
            names = [field.split()[0] for field in _CHUNKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=names)

        waiting = 0
        for batch in batches:
            for doc_id, text, held in zip(*(batch[name].to_pylist() for name in ("doc_id", "text", "held"))):
                own = spaced_words(lower_bytes(text))
                tokens.append(np.fromiter(map(numbers.__getitem__, own), np.uint32, len(own)))
                tokens.append(np.zeros(1, np.uint32))
                docs_of.append(doc_id)
                held_of.append(held)
                lengths.append(len(own) + 1)
                waiting += len(own) + 1
                if waiting >= size:
                    yield chunk()
                    docs_of, held_of, lengths, tokens, waiting = [], [], [], [], 0
                    numbers = defaultdict(itertools.count(1).__next__)
        if waiting:
            yield chunk()

    return rows.mapInArrow(cut, _CHUNKS)


_NUMBERED = "chunk long, blob binary, counts array<long>, kinds array<long>"


def numbered_words(cut: DataFrame, parts: int, part_tokens: int) -> DataFrame:
    """For each chunk and partition of words, the words' numbers and counts; and with chunk -1 how many words have each count,
    and (``blob``) the numbers of the most frequent words with their counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (hashes,), (counts,) = unpack(row["hashes"], "u8"), unpack(row["counts"], "u4")
                part = _partition(hashes, parts)
                order = np.argsort(part, kind="stable")
                found, starts = np.unique(part[order], return_index=True)
                blobs = [
                    pack(hashes[at], counts[at], steps(at.astype(np.uint32)))
                    for at in np.split(order, starts[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.astype(np.int64)), pa.array([row["chunk"]] * len(found), pa.int64()), pa.array(blobs, pa.binary())],
                    names=["part", "chunk", "blob"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groups(batches, "part"):
            asked = [unpack(row["blob"], "u8", "u4", "u4") for row in rows]
            words, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([a[1] for a in asked]).astype(float), len(words)).astype(np.int64)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            number = np.where(counts > 0, rank * parts + part + FIRST_WORD, UNKNOWN).astype(np.uint64)
            ends = np.cumsum([len(a[0]) for a in asked])
            blobs = [
                pack(number[i].astype(np.uint64), counts[i].astype(np.uint64), a[2])
                for i, a in zip(np.split(at, ends[:-1]), asked)
            ]
            values, kinds = np.unique(counts[counts > 0], return_counts=True)
            top = order[counts[order] * HOT_PARTS > part_tokens]
            blobs.append(pack(number[top], counts[top].astype(np.uint64)))
            n = len(asked)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*[row["chunk"] for row in rows], -1], pa.int64()),
                    pa.array(blobs, pa.binary()),
                    pa.array([None] * n + [values.tolist()], pa.list_(pa.int64())),
                    pa.array([None] * n + [kinds.tolist()], pa.list_(pa.int64())),
                ],
                names=["chunk", "blob", "counts", "kinds"],
            )

    asked = cut.select("chunk", "hashes", "counts").mapInArrow(ask, "part long, chunk long, blob binary")
    return asked.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(answer, _NUMBERED)


_REQUESTS = (
    "part long, chunk long, blob binary, doc_ids array<long>, held array<boolean>, n_tokens array<int>, "
    "n_known array<long>, base array<double>"
)
_MODEL = (
    "part long, bigrams binary, chunks array<long>, pieces array<binary>, n_of_count array<long>, hot binary, "
    "chunk long, doc_ids array<long>, held array<boolean>, n_tokens array<int>, n_known array<long>, base array<double>"
)


def bigram_requests(cut: DataFrame, numbered: DataFrame, words: Unigrams, hot: Split, parts: int) -> DataFrame:
    """For each chunk its base results, and for each partition of contexts its distinct bigrams with the texts they occur in."""
    answers = numbered.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list("blob").alias("answers"))
    joined = cut.select("chunk", "doc_ids", "held", "n_tokens", "tokens").join(answers, "chunk")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in _REQUESTS.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                answers = [unpack(blob, "u8", "u8", "u4") for blob in row["answers"]]
                n = sum(len(a[0]) for a in answers)
                number, count = np.empty(n, np.uint64), np.empty(n, np.int64)
                for numbers, counts, gaps in answers:
                    at = np.cumsum(gaps)
                    number[at], count[at] = numbers, counts
                (tokens,) = unpack(row["tokens"], "u4")
                lengths = np.array(row["n_tokens"], np.int64)
                begin = np.cumsum(lengths) - lengths
                owner = np.repeat(np.arange(len(lengths)), lengths).astype(np.uint32)
                base_of = np.log10((count + 1) / (words.tokens + words.kinds + 1))
                base = np.add.reduceat(base_of[tokens], begin)
                known = np.add.reduceat((count > 0)[tokens].astype(np.int64), begin)

                second, context = number[tokens], np.empty(len(tokens), np.uint64)
                context[1:] = second[:-1]
                context[begin] = START
                part = hot.partitions(context, second, parts)
                order = np.lexsort((owner, second, context, part))
                part, context, second, owner = part[order], context[order], second[order], owner[order]
                used = (~np.array(row["held"]))[owner].astype(np.uint32)
                new = np.ones(len(part), bool)
                new[1:] = (context[1:] != context[:-1]) | (second[1:] != second[:-1]) | (part[1:] != part[:-1])
                starts = np.flatnonzero(new)
                runs = np.diff(np.append(starts, len(part))).astype(np.uint32)
                times = np.add.reduceat(used, starts).astype(np.uint32)
                of_word = count[tokens][order][starts].astype(np.uint64)
                found, first = np.unique(part[starts], return_index=True)
                blobs = []
                for lo, hi in zip(first, np.append(first[1:], len(starts))):
                    at = starts[lo:hi]
                    last = starts[hi] if hi < len(starts) else len(part)
                    seconds, first_at, which = np.unique(second[at], return_index=True, return_inverse=True)
                    blobs.append(
                        pack(
                            steps(context[at]),
                            steps(seconds),
                            of_word[lo:hi][first_at],
                            which.astype(np.uint32),
                            times[lo:hi],
                            runs[lo:hi],
                            owner[at[0] : last],
                        )
                    )
                empty = [None] * len(found)
                columns = [
                    pa.array([*found.tolist(), int(found[0])], pa.int64()),
                    pa.array([row["chunk"]] * (len(found) + 1), pa.int64()),
                    pa.array([*blobs, None], pa.binary()),
                    pa.array([*empty, row["doc_ids"]], pa.list_(pa.int64())),
                    pa.array([*empty, row["held"]], pa.list_(pa.bool_())),
                    pa.array([*empty, row["n_tokens"]], pa.list_(pa.int32())),
                    pa.array([*empty, known.tolist()], pa.list_(pa.int64())),
                    pa.array([*empty, base.tolist()], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(ask, _REQUESTS)


def counted_bigrams(requests: DataFrame, words: Unigrams, hot: Split, parts: int) -> DataFrame:
    """The model's table: for each partition its bigrams with their counts, and where they occur.

    The base results of the chunks pass through as rows of their own.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in _MODEL.split(", ")]
        kinds = [
            pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(),
            pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()),
        ]

        def row_of(**values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([values.get(n)], k) for n, k in zip(names, kinds)], names=names)

        for part, rows in groups(batches, "part"):
            for row in rows:
                if row["blob"] is None:
                    yield row_of(**{name: row[name] for name in names[6:]})
            rows = [row for row in rows if row["blob"] is not None]
            asked = [unpack(row["blob"], "u8", "u8", "u8", "u4", "u4", "u4", "u4") for row in rows]
            context = np.concatenate([np.cumsum(a[0]) for a in asked])
            second = np.concatenate([np.cumsum(a[1])[a[3]] for a in asked])
            of_word = np.concatenate([a[2][a[3]] for a in asked])
            times = np.concatenate([a[4] for a in asked])
            order = np.lexsort((second, context))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(context[order]) != 0) | (np.diff(second[order]) != 0)
            starts = np.flatnonzero(new)
            at = np.empty(len(order), np.uint32)
            at[order] = np.cumsum(new) - 1
            counts = np.add.reduceat(times[order].astype(np.int64), starts)
            context, second, of_word = context[order][starts], second[order][starts], of_word[order][starts].astype(np.int64)
            ends = np.cumsum([len(a[0]) for a in asked])
            pieces = [pack(steps(i), a[5], a[6]) for i, a in zip(np.split(at, ends[:-1]), asked)]

            met = counts > 0
            small = np.bincount(np.minimum(counts[met], LARGEST + 2), minlength=LARGEST + 3)[: LARGEST + 2]
            spread = met & np.isin(context, hot.numbers)
            totals = []
            if spread.any():
                those, group = np.unique(context[spread], return_inverse=True)
                c = counts[spread]
                totals = [those] + [np.bincount(group, c * (c == r), len(those)) for r in range(1, LARGEST + 1)]
                totals += [np.bincount(group, c * (c > LARGEST), len(those))]
                totals += [np.bincount(group, words.probability(of_word[spread]), len(those))]
            yield row_of(
                part=part,
                bigrams=pack(steps(context), second, of_word.astype(np.uint64), counts.astype(np.uint64)),
                chunks=[row["chunk"] for row in rows],
                pieces=pieces,
                n_of_count=small.tolist(),
                hot=pack(*totals) if totals else None,
            )

    dealt = requests.repartition(parts, "part").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(merge, _MODEL)


def text_sums(
    model: DataFrame, words: Unigrams, factor: np.ndarray, totals: dict[int, np.ndarray]
) -> DataFrame:
    """For each chunk and partition, the log10 probabilities of its tokens, summed by text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                gaps, _, of_word, counts = (a.astype(np.int64) for a in unpack(row["bigrams"], "u8", "u8", "u8", "u8"))
                context = np.cumsum(gaps)
                log = log_probabilities(context, of_word, counts, words, factor, totals)
                blobs = []
                for piece in row["pieces"]:
                    gaps, runs, owner = unpack(piece, "u4", "u4", "u4")
                    sums = np.bincount(owner, np.repeat(log[np.cumsum(gaps.astype(np.int64))], runs))
                    texts = np.unique(owner)
                    blobs.append(pack(texts, sums[texts]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["chunks"], pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "blob"]
                )

    return model.filter(F.col("part").isNotNull()).select("bigrams", "chunks", "pieces").mapInArrow(score, "chunk long, blob binary")


def log_probabilities(
    context: np.ndarray, of_word: np.ndarray, counts: np.ndarray, words: Unigrams, factor: np.ndarray, totals: dict[int, np.ndarray]
) -> np.ndarray:
    """log10 of each bigram's probability: its discounted count if it was met, else the context's weight times the word's own."""
    own = words.probability(of_word)
    kept = factor[np.minimum(counts, LARGEST + 1)] * counts
    those, group = np.unique(context, return_inverse=True)
    met = counts > 0
    sum_kept, sum_counts, sum_seen = (np.bincount(group, x, len(those)) for x in (kept, counts, np.where(met, own, 0.0)))
    for i in np.flatnonzero(np.isin(those, np.array(list(totals), np.int64))):
        of_small, beyond, sum_seen[i] = totals[int(those[i])][:LARGEST], totals[int(those[i])][LARGEST], totals[int(those[i])][-1]
        sum_kept[i] = (factor[1 : LARGEST + 1] * of_small).sum() + factor[LARGEST + 1] * beyond
        sum_counts[i] = of_small.sum() + beyond
    divisor, weight = backoff(sum_kept, sum_counts, sum_seen, words.unknown)
    return np.log10(np.where(met, kept / np.maximum(divisor[group], 1), weight[group] * own))


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_tokens: int = CHUNK_TOKENS,
    part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are words between white space with A to Z in lower case, then one end, so that a null or empty text
    has one token. All rows but the held-out ones are learned from; rows with a null id are, and so is each
    repeated row. Words not met in training share one probability. An empty table gives an empty result.
    Words are told apart by 64-bit hashes. Writes three tables on the way.
    """
    cut = stage(chunks(docs, id_col, text_col, chunk_tokens), "chunks")
    sums = cut.select(
        F.coalesce(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)),
        F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)),
    ).first()
    parts = max(32, -(-int(sums[0]) // part_tokens))
    numbered = stage(numbered_words(cut, parts, part_tokens), "numbered-words")
    totals = numbered.filter("chunk < 0")
    by_count = totals.select(F.inline(F.arrays_zip("counts", "kinds"))).groupBy("counts").agg(F.sum("kinds").alias("kinds"))
    # One row per distinct count: at most the root of twice the number of tokens.
    rows = by_count.collect()
    words = Unigrams.of(np.array([r.counts for r in rows], np.int64), np.array([r.kinds for r in rows], np.int64))

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number, count = unpack(row["blob"], "u8", "u8")
                yield pa.RecordBatch.from_pydict({"number": number.astype(np.int64), "n": count.astype(np.int64)})

    # Words with a quarter of a partition's tokens: no more than four times the partitions.
    frequent = {r.number: r.n for r in totals.select("blob").mapInArrow(above, "number long, n long").collect()}
    # As a context, words not met in training have no counts that would have to be added up; they are at most the held-out tokens.
    hot = Split.of(frequent | {START: int(sums[1]), UNKNOWN: int(sums[0]) - words.tokens}, part_tokens)

    model = stage(counted_bigrams(bigram_requests(cut, numbered, words, hot, parts), words, hot, parts), "bigrams")
    n_of_count = [F.coalesce(F.sum(F.get("n_of_count", F.lit(r))), F.lit(0)) for r in range(LARGEST + 2)]
    factor = discounts(np.array(model.select(*n_of_count).first(), float))

    names = [f"t{i}" for i in range(LARGEST + 2)]

    def of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch["hot"].to_pylist():
                numbers, *values = unpack(blob, "u8", *["f8"] * (LARGEST + 2))
                yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), *map(pa.array, values)], names=["number", *names])

    pieces = model.filter(F.col("hot").isNotNull()).select("hot").mapInArrow(of_pieces, ", ".join(["number long", *[f"{n} double" for n in names]]))
    # The totals of a split context are added up in Spark; one row for each comes here.
    whole = pieces.groupBy("number").agg(*[F.sum(n).alias(n) for n in names]).collect()
    spread = {row.number: np.array(row[1:]) for row in whole}

    sums_of_texts = text_sums(model, words, factor, spread)
    base = model.filter(F.col("part").isNull()).select("chunk", "doc_ids", "held", "n_tokens", "n_known", "base")
    scored = sums_of_texts.groupBy("chunk").agg(F.collect_list("blob").alias("blobs")).join(base, "chunk")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                score = np.zeros(len(row["doc_ids"]))
                for blob in row["blobs"]:
                    texts, part = unpack(blob, "u4", "f8")
                    score[texts] += part
                n = len(score)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["held"], pa.bool_()),
                        pa.array(row["n_tokens"], pa.int64()),
                        pa.array(row["n_known"], pa.int64()),
                        pa.array([words.tokens] * n, pa.int64()),
                        pa.array(row["base"], pa.float64()),
                        pa.array(score),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return scored.mapInArrow(
        finish,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
