"""Documents that share most of their word n-grams: MinHash LSH with exact verification.

Texts with one and the same set of shingles form a class, of which only the smallest id goes on. Classes
that share one of several prefixes of their MinHash signatures are brought together. How long each prefix
is, is fixed beforehand, by the formula for the recall of a pair of the threshold's similarity, so that this amounts
to banding. The classes that hang together this way are compared exactly, block by block, on their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.columns import numbered
from tallyline.llm.components import connected_components
from tallyline.llm.exact_dedup import SUSPECT, filter_words, mark_suspects
from tallyline.llm.text import lower_bytes, words
from tallyline.sources.staging import stage

TREES = 14
MAX_PREFIX = 4
TARGET_RECALL = 0.9999
BLOCK = 256
"""Classes of one block. A task compares two blocks at a time, whatever the size of the group."""
SEED = 20_240_607
_STEP = np.uint64(0x100000001B3)
_COLUMNS = 8_192
DROPPED = "dropped__"


def prefix_lengths(threshold: float, recall: float, trees: int, longest: int) -> list[int]:
    """The prefix that must agree in each trie, shortened one trie at a time until the recall is reached."""
    lengths = [longest] * trees
    while True:
        missed = 1.0
        for length in lengths:
            missed *= 1 - threshold**length
        if 1 - missed >= recall or max(lengths) == 1:
            return lengths
        lengths[lengths.index(max(lengths))] -= 1


class Shingles:
    """Sets of word n-grams as sorted 64-bit hashes. A text of fewer words has one shingle, all of it; an empty one none."""

    def __init__(self, n: int, remember: int = 400_000):
        self.n, self.remember, self.known = n, remember, {}

    def _hashes(self, of: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.remember:
            known.clear()
        missing = set(of).difference(known)
        known.update(zip(missing, map(xxhash.xxh3_64_intdigest, missing)))
        return np.fromiter(map(known.__getitem__, of), np.uint64, len(of))

    def of_text(self, text: str | None) -> np.ndarray:
        hashes = self._hashes(words(lower_bytes(text)))
        if not len(hashes):
            return hashes
        n = min(self.n, len(hashes))
        places = len(hashes) - n + 1
        mixed = hashes[:places].copy()
        for k in range(1, n):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _STEP + hashes[k : k + places]
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed * np.uint64(0x9E3779B97F4A7C15))


def _digest(shingles: bytes) -> bytes:
    """What tells one set of shingles from all others."""
    return hashlib.sha256(shingles).digest()[:16]


class MinHash:
    """Signatures by multiply-and-add on the upper half of each shingle's hash."""

    def __init__(self, size: int):
        rng = np.random.default_rng(SEED)
        self.factor = rng.integers(0, 1 << 32, size, np.uint32) | np.uint32(1)
        self.offset = rng.integers(0, 1 << 32, size, np.uint32)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        high = shingles.astype(np.uint32)
        least = np.full(len(self.factor), np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(low), 512):
            part = low[i : i + 512] * self.factor[:, None] + self.offset[:, None]
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x85EBCA6B)
            part += high[i : i + 512]
            np.minimum(least, part.min(axis=1), out=least)
        return least


def signatures(docs: DataFrame, n: int, size: int) -> DataFrame:
    """``doc_id, set_id, signature``: a digest of the shingle set, null for an empty one, and its MinHash."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minhash = Shingles(n), MinHash(size)
        for batch in batches:
            digests, found = [], []
            for text in batch["text"].to_pylist():
                own = shingles.of_text(text)
                digests.append(_digest(own.tobytes()) if len(own) else None)
                found.append(minhash.of(own).view(np.int32).tolist() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "set_id", "signature"],
            )

    return docs.mapInArrow(sign, "doc_id long, set_id binary, signature array<int>")


def forest_links(classes: DataFrame, lengths: list[int], longest: int) -> DataFrame:
    """A link from each class to the smallest class that shares its prefix, for every trie.

    A trie's nodes at the chosen depth are the distinct prefixes of the sorted signatures.
    """
    labels = [
        F.struct(F.lit(tree).alias("tree"), F.slice("signature", tree * longest + 1, length).alias("prefix"))
        for tree, length in enumerate(lengths)
    ]
    entries = classes.select("rep", F.explode(F.array(*labels)).alias("label")).select(
        "rep", F.xxhash64("label.tree", "label.prefix").alias("node")
    )
    shared = entries.groupBy("node").agg(F.min("rep").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return entries.join(shared, "node").filter("rep > b").select(F.col("rep").alias("a"), "b")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets has in common, by products of 0/1 matrices over blocks of shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(values)))
    code = np.cumsum(new) - 1
    shared = counts[code] > 1
    owner, code = owner[shared], code[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    if not len(code):
        return common
    code = np.cumsum(np.concatenate([[False], code[1:] != code[:-1]]))
    for first in range(0, int(code[-1]) + 1, _COLUMNS):
        lo, hi = np.searchsorted(code, [first, first + _COLUMNS])
        part = np.zeros((len(sets), min(_COLUMNS, int(code[-1]) + 1 - first)), np.float32)
        part[owner[lo:hi], code[lo:hi] - first] = 1
        common += part @ part.T
    return common


def _smallest_reachable(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each member reaches inside the group."""
    least = ids.copy()
    while True:
        near = np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        step = np.minimum(least, near)
        if (step == least).all():
            return least
        least = step


def compare_group(
    reps: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, first: int, second: int, sets: list[np.ndarray], threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """For two blocks of a group: the number of documents each class is linked with, and the smallest class it reaches."""
    lengths = np.array([len(s) for s in sets], np.int64)
    common = _common(sets).astype(np.int64)
    # A small allowance for the product in floating point; both sides are whole numbers otherwise.
    linked = common >= threshold * (lengths[:, None] + lengths[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if first != second:
        linked &= blocks[:, None] != blocks[None, :]
    return (linked * sizes[None, :]).sum(axis=1), _smallest_reachable(linked, reps)


def verified_links(
    docs: DataFrame, members: DataFrame, n: int, threshold: float
) -> DataFrame:
    """``rep, n_links, least`` for every class and pair of blocks it is compared in.

    ``members`` has ``rep, least_id, set_id, size, grp, n_blocks``. The texts of the members are read again: those with the smallest id of a
    class, and of these, as an id may repeat, the ones with the class's set.
    """
    spark = docs.sparkSession
    # A filter of bounded size holds back nearly all other texts, so that these are not shuffled for the join.
    likely = mark_suspects(docs, "doc_id", stage(filter_words(members, "least_id", 1), "member-bits")).filter(SUSPECT)
    texts = likely.join(members, F.col("doc_id") == F.col("least_id"))
    block = F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    schema = "rep long, size long, grp long, block int, first int, second int, shingles binary"

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in batches:
            blobs = [shingles.of_text(text).tobytes() for text in batch["text"].to_pylist()]
            own = pa.array([_digest(blob) == set_id for blob, set_id in zip(blobs, batch["set_id"].to_pylist())], pa.bool_())
            found = pa.RecordBatch.from_arrays(
                [batch[name] for name in ("rep", "size", "grp", "n_blocks", "block")] + [pa.array(blobs, pa.binary())],
                names=["rep", "size", "grp", "n_blocks", "block", "shingles"],
            )
            yield found.filter(own)

    blobs = texts.select("rep", "size", "grp", "n_blocks", block.alias("block"), "set_id", "text").mapInArrow(
        shingle, "rep long, size long, grp long, n_blocks int, block int, shingles binary"
    )
    pairs = (
        blobs.withColumn("other", F.explode(others))
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
        .select(*[field.split()[0] for field in schema.split(", ")])
    )
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.repartition(tasks, "grp", "first", "second").sortWithinPartitions("grp", "first", "second", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(key, rows):
            reps, blobs = np.array([r[0] for r in rows], np.int64), [r[3] for r in rows]
            # Rows that repeat an id count in its class; here it is one member.
            _, once = np.unique(reps, return_index=True)
            if len(once) < 2:
                return None
            sizes, blocks = (np.array([r[i] for r in rows], np.int64)[once] for i in (1, 2))
            sets = [np.frombuffer(blobs[i], np.uint64) for i in once]
            counts, least = compare_group(reps[once], sizes, blocks, key[1], key[2], sets, threshold)
            some = counts > 0
            return pa.RecordBatch.from_arrays(
                [pa.array(reps[once][some]), pa.array(counts[some]), pa.array(least[some])], names=["rep", "n_links", "least"]
            )

        key, rows = None, []
        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("grp", "first", "second", "rep", "size", "block", "shingles")]
            for grp, first, second, *row in zip(*columns):
                if (grp, first, second) != key:
                    if len(rows) > 1 and (out := result(key, rows)) is not None:
                        yield out
                    key, rows = (grp, first, second), []
                rows.append(row)
        if len(rows) > 1 and (out := result(key, rows)) is not None:
            yield out

    return dealt.mapInArrow(compare, "rep long, n_links long, least long")


def ngram_join(
    docs: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    recall: float = TARGET_RECALL,
    trees: int = TREES,
    longest: int = MAX_PREFIX,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, component_id``.

    Two documents are linked when the Jaccard similarity of their sets of ``n`` consecutive words (after
    lower-casing A to Z; all words if there are fewer) is at least ``threshold``. ``class_id`` is the smallest id
    with the same set, ``n_links`` the number of rows linked directly, copies included, and ``component_id``
    the smallest id reachable by links. A text without words, empty or null, is linked with nothing, and neither is a row
    with a null id, whose three results are its own id and 0. Rows that repeat an id and a text are copies
    of one another, and rows of one id with different texts are documents of their own. Writes several tables on the way.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stage(signatures(rows, n, trees * longest), "signatures")
    usable = signed.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = stage(
        usable.groupBy("set_id").agg(
            F.min("doc_id").alias("least_id"), F.count("*").alias("size"), F.any_value("signature").alias("signature")
        )
        # A number of its own for each class: the smallest ids of two classes may be equal, where an id repeats.
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    groups = connected_components(forest_links(classes, prefix_lengths(threshold, recall, trees, longest), longest))
    groups = groups.select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    members = stage(
        groups.join(sizes, "grp").join(classes.drop("signature"), "rep").select("rep", "least_id", "set_id", "size", "grp", "n_blocks"),
        "members",
    )
    found = stage(verified_links(rows.filter(F.col("doc_id").isNotNull()), members, n, threshold), "verified")
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "rep")
    smallest = components.join(classes.select("rep", "least_id"), "rep").groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = stage(
        classes.join(counts, "rep", "left")
        .join(components, "rep", "left")
        .join(smallest, "component", "left")
        .select(
            F.col("set_id").alias("class_set"),
            F.col("least_id").alias("class_id"),
            (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "least_id").alias("component_id"),
        ),
        "class-results",
    )
    # Many copies of one text are rows of one key; Spark splits them, as both sides come from a shuffle.
    joined = usable.select("doc_id", "set_id").repartition("set_id").join(of_class, F.col("set_id") == F.col("class_set"))
    alone = signed.filter(F.col("set_id").isNull() | F.col("doc_id").isNull()).select(
        "doc_id",
        F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.col("doc_id").alias("component_id"),
    )
    return joined.select("doc_id", "class_id", "n_links", "component_id").unionByName(alone)


def keep_one_per_component(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, in a result of ``ngram_join``.

    Of an id that repeats with different texts all rows stay if one does.
    """
    gone = joined.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone")
    dropped = gone.select(F.col("doc_id").alias(DROPPED))
    rows, own_id = numbered(docs, id_col)
    return rows.join(dropped, F.col(own_id) == F.col(DROPPED), "left_anti").toDF(*docs.columns)
