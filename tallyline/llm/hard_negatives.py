"""Hard negatives for anchors, read from Hilbert-ordered blocks of candidates.

Vectors are scaled to whole numbers. Their places on a Hilbert curve, through the leading axes of a bounded sample, order all rows; the order
is cut into blocks, which are rows of a Parquet table with the smallest and largest component per dimension and the labels they
hold. For an anchor, interval arithmetic on these zone maps bounds every score in a block. A first read of the most
promising blocks gives each anchor a score that its last positive reaches; the blocks whose bound reaches it hold all its positives. The blocks
whose interval meets the score window of a positive hold all its negatives, and no others are read.

Zone maps and blocks travel in slices of the order. The anchors, a stated query set, are compared with the zone maps of each slice
and travel to those slices alone in which they have something to read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.sources.staging import stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
"""A negative's score lies between these percentages of the positive's."""
BLOCK = 1024
"""Candidates of a block, at most."""
SLICE = 64
"""Blocks of a slice, at most."""
GROUP = 256
"""Anchors that are compared at once, at most."""
SAMPLE = 8192
"""Rows the axes of the curve are fitted to, those with the smallest hashes. All rows are ordered and read by their bounds."""
AXES, BITS = 8, 7
"""The curve runs through so many axes, with so many bits on each."""
LARGEST = float(1 << 61)
"""Squared length up to which a scaled vector takes part: no score of two such vectors overflows a long."""
EXACT = float(1 << 52)
_BUFFER = 1 << 17
"""Found rows that a task holds before it keeps the best ones only."""

_ROWS = "place long, dim int, hilbert long, vec_id long, label long, anchor boolean, q binary"
_BLOCKS = "dim int, n int, ids binary, labels binary, places binary, anchors binary, q binary, low binary, high binary, present array<long>"


def scaled_rows(vectors: DataFrame, anchors: Column, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``place, dim, vec_id, label, anchor, q``: the rows that take part, their components as whole numbers, numbered."""
    values = F.col("values")
    scaled = F.transform(values, lambda x: x * F.lit(float(scale)))
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & values.isNotNull()
        & (F.size(values) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    short = F.aggregate(F.col("scaled"), F.lit(0.0), lambda total, x: total + x * x) < LARGEST
    chosen = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("values"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    whole = chosen.filter(F.coalesce(usable, F.lit(False))).withColumn("scaled", scaled).filter(short)
    return whole.select(
        F.monotonically_increasing_id().alias("place"),
        F.size("values").alias("dim"),
        "vec_id",
        "label",
        "anchor",
        F.transform("scaled", lambda x: F.floor(x)).alias("q"),
    )


def fitted_axes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading axes of a bounded sample, and the range of the sample along each."""
    found = [r.q for r in rows.orderBy(F.xxhash64("place", "vec_id"), "place").limit(SAMPLE).select("q").collect()]
    dim = max((len(q) for q in found), default=1)
    sample = np.array([q for q in found if len(q) == dim], np.float64).reshape(-1, dim)
    if not len(sample):
        return np.zeros((dim, AXES)), np.zeros(AXES), np.ones(AXES)
    _, vectors = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(dim, dim) if len(sample) > 1 else np.eye(dim))
    axes = np.zeros((dim, AXES))
    leading = vectors[:, ::-1][:, :AXES]
    axes[:, : leading.shape[1]] = leading
    along = sample @ axes
    return axes, along.min(axis=0), along.max(axis=0)


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers, one per axis, of ``bits`` bits.

    The transposed form: from the highest bit down, the lower bits of a cell are turned as the subcube it lies in is turned, and the
    Gray code of the subcubes is undone.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for shift in range(bits - 1, 0, -1):
        bit, below = 1 << shift, (1 << shift) - 1
        for i in range(n):
            set_ = (x[i] & bit) != 0
            swapped = np.where(set_, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(set_, below, swapped)
            if i:
                x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1], np.int64)
    for shift in range(bits - 1, 0, -1):
        turned ^= np.where((x[n - 1] >> shift) & 1, (1 << shift) - 1, 0)
    x ^= turned
    out = np.zeros(x.shape[1], np.int64)
    for shift in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> shift) & 1
    return out


def _place_rows(batches: Iterator[pa.RecordBatch], axes: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with their place on the curve. Rows of another length than the axes are placed by the dimensions that both have."""
    width = np.where(high > low, high - low, 1.0)
    for batch in batches:
        dims = batch["dim"].to_numpy(zero_copy_only=False)
        flat, ends = batch["q"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(dims)
        along = np.zeros((len(batch), AXES))
        for dim in np.unique(dims).tolist():
            at, shared = np.flatnonzero(dims == dim), min(dim, len(axes))
            q = flat[(ends[at] - dim)[:, None] + np.arange(shared)]
            along[at] = q @ axes[:shared]
        cells = np.clip((along - low) / width * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        blobs = pa.array([flat[end - dim : end].tobytes() for dim, end in zip(dims.tolist(), ends.tolist())], pa.binary())
        columns = [batch["place"], batch["dim"], pa.array(hilbert_places(cells, BITS)), batch["vec_id"], batch["label"], batch["anchor"], blobs]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "dim", "hilbert", "vec_id", "label", "anchor", "q"])


def _narrow(q: np.ndarray) -> bytes:
    """Whole numbers in the smallest type that holds them, told by its length."""
    for kind in (np.int8, np.int16, np.int32):
        if q.size == 0 or (q.min() >= np.iinfo(kind).min and q.max() <= np.iinfo(kind).max):
            return q.astype(kind).tobytes()
    return q.astype(np.int64).tobytes()


def _matrix(blob: bytes, n: int, dim: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[len(blob) // (n * dim)]
    return np.frombuffer(blob, kind).reshape(n, dim)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition as blocks of one length of vectors and at most ``most`` rows."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        _, dims, _, ids, labels, anchors, qs = zip(*rows)
        q = np.frombuffer(b"".join(qs), np.int64).reshape(len(rows), dims[0])
        as_bytes = lambda values, kind: np.array(values, kind).tobytes()
        columns = [
            [dims[0]], [len(rows)], [as_bytes(ids, np.int64)], [as_bytes(labels, np.int64)], [as_bytes([r[0] for r in rows], np.int64)],
            [as_bytes(anchors, np.bool_)], [_narrow(q)], [q.min(axis=0).tobytes()], [q.max(axis=0).tobytes()], [sorted(set(labels))],
        ]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7, pa.list_(pa.int64())]
        names = ["dim", "n", "ids", "labels", "places", "anchors", "q", "low", "high", "present"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[name].to_pylist() for name in ("place", "dim", "hilbert", "vec_id", "label", "anchor", "q"))):
            if rows and (len(rows) == most or row[1] != rows[0][1]):
                yield block(rows)
                rows = []
            rows.append(row)
    if rows:
        yield block(rows)


def ordered_blocks(rows: DataFrame, n_rows: int, most: int, per_task: int, label: str) -> DataFrame:
    """The written blocks of the rows in Hilbert order, each with a number ``block``; ``slice`` numbers the task that cut it.

    Equal places are told apart by the rows' numbers, so that very many equal vectors are spread over as many blocks as others.
    """
    tasks = max(1, -(-n_rows // (most * per_task)))
    dealt = rows.repartitionByRange(tasks, "dim", "hilbert", "place").sortWithinPartitions("dim", "hilbert", "place")
    cut = dealt.mapInArrow(lambda batches: _cut(batches, most), _BLOCKS)
    # Fixed value: monotonically_increasing_id keeps the partition above its 33 lowest bits.
    numbered = cut.withColumn("block", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("block", 33))
    return stage(numbered, label)


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high``, anchors by blocks.

    Sums in doubles, widened by more than they may be rounded.
    """
    above, below = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
    low, high = low.astype(np.float64), high.astype(np.float64)
    least, greatest = above @ low.T + below @ high.T, above @ high.T + below @ low.T
    room = (above @ np.maximum(np.abs(low), np.abs(high)).T - below @ np.maximum(np.abs(low), np.abs(high)).T) * 1e-12
    return least - room, greatest + room


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, in doubles where these are exact."""
    a, c = anchors.astype(np.float64), candidates.astype(np.float64)
    reach = np.sqrt((a * a).sum(axis=1).max(initial=0) * (c * c).sum(axis=1).max(initial=0))
    # No partial sum of the products can exceed the sum of their sizes.
    if reach * np.sqrt(anchors.shape[1]) < EXACT:
        return (a @ c.T).astype(np.int64)
    return anchors.astype(np.int64) @ candidates.astype(np.int64).T


def _best(values: np.ndarray, ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` largest values, equal ones by smaller id, then place."""
    if len(values) > n:
        least = np.partition(values, len(values) - n)[len(values) - n]
        some = np.flatnonzero(values >= least)
    else:
        some = np.arange(len(values))
    return some[np.lexsort((places[some], ids[some], -values[some]))][:n]


class _Found:
    """Found rows of a task, of which only the best of each window are kept as they come to be many."""

    NAMES = ("anchor", "positive", "value", "id", "place")

    def __init__(self, n: int) -> None:
        self.n, self.parts, self.rows = n, [], 0

    def add(self, anchor: int, positive: int, values: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        if len(values):
            self.parts.append(np.stack([np.full(len(values), anchor), np.full(len(values), positive), values, ids, places]))
            self.rows += len(values)

    def full(self) -> bool:
        """Whether so many rows remain, after only the best are kept, that they had better be handed on."""
        if self.rows < _BUFFER:
            return False
        self.parts = [self.best()]
        self.rows = self.parts[0].shape[1]
        return self.rows > _BUFFER // 2

    def best(self) -> np.ndarray:
        if not self.parts:
            return np.zeros((5, 0), np.int64)
        all_ = np.concatenate(self.parts, axis=1)
        all_ = all_[:, np.lexsort((all_[4], all_[3], -all_[2], all_[1], all_[0]))]
        new = np.ones(all_.shape[1], bool)
        new[1:] = (all_[0, 1:] != all_[0, :-1]) | (all_[1, 1:] != all_[1, :-1])
        starts = np.flatnonzero(new)
        rank = np.arange(len(new)) - np.repeat(starts, np.diff([*starts, len(new)]))
        return all_[:, rank < self.n]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(row)) for row in self.best()], names=list(self.NAMES))


_FOUND = "anchor long, positive long, value long, id long, place long"


def _window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score ``s`` with ``low * positive <= 100 * s <= high * positive``."""
    # In whole numbers of any size: a positive's score may be near the end of a long.
    wide = positive.astype(object)
    bounds = [(-(-low * p // 100), high * p // 100) for p in wide.tolist()]
    return np.array([a for a, _ in bounds], np.int64), np.array([b for _, b in bounds], np.int64)


def _anchor_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["a_places"], np.int64), np.frombuffer(row["a_labels"], np.int64), _matrix(row["a_q"], row["a_n"], row["dim"])


def _positive_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of a group: the anchor's position in it, the positive's number and its score."""
    return tuple(np.frombuffer(row[name], np.int64) for name in ("w_anchor", "w_positive", "w_score"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _wanted(row: dict, low: np.ndarray, high: np.ndarray, present: list[list[int]], bounds: tuple[int, int]) -> np.ndarray:
    """Which windows of a group (or anchors, while positives are sought) must read which of the blocks."""
    _, labels, q = _anchor_arrays(row)
    least, greatest = score_bounds(q, low, high)
    if row["w_anchor"] is None:
        floor = np.frombuffer(row["a_floor"], np.int64).astype(np.float64)
        has = np.array([np.isin(labels, found) for found in present]).T.reshape(len(labels), len(present))
        return has & (greatest >= floor[:, None])
    anchor, _, score = _positive_arrays(row)
    lowest, highest = _window(score, *bounds)
    # A rounded bound may touch a window that the block misses; never the other way round.
    meets = (greatest[anchor] >= lowest[:, None].astype(np.float64)) & (least[anchor] <= highest[:, None].astype(np.float64))
    other = np.array([[any(x != label for x in found) for found in present] for label in labels.tolist()], bool).reshape(len(labels), len(present))
    return meets & other[anchor]


def _choose(batches: Iterator[pa.RecordBatch], bounds: tuple[int, int], first: bool) -> Iterator[pa.RecordBatch]:
    """The anchor groups with the blocks of the slice that they must read. ``first``: those with the highest bounds alone."""
    for batch in batches:
        for i in range(len(batch)):
            one = batch.slice(i, 1)
            row = one.to_pylist()[0]
            blocks, dim = row["z_block"], row["dim"]
            low, high = (np.frombuffer(row[name], np.int64).reshape(len(blocks), dim) for name in ("z_low", "z_high"))
            wanted = _wanted(row, low, high, row["z_present"], bounds)
            if first:
                _, labels, q = _anchor_arrays(row)
                greatest = np.where(wanted, score_bounds(q, low, high)[1], -np.inf)
                top = np.argsort(-greatest, axis=1, kind="stable")[:, :1]
                chosen = np.zeros(len(blocks), bool)
                chosen[top[greatest[np.arange(len(top)), top[:, 0]] > -np.inf]] = True
            else:
                chosen = wanted.any(axis=0)
            read = [block for block, yes in zip(blocks, chosen.tolist()) if yes]
            if read:
                names = [name for name in one.schema.names if not name.startswith("z_")]
                columns = [one[name] for name in names] + [pa.array([read], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "read"])


def _read_positives(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The best rows of the anchors' labels in the blocks."""
    found = _Found(n)
    for row in _rows(batches):
        places, labels, q = _anchor_arrays(row)
        ids, c_labels, c_places = (np.frombuffer(row[name], np.int64) for name in ("ids", "labels", "places"))
        candidates = _matrix(row["q"], row["n"], row["dim"])
        floor = np.frombuffer(row["a_floor"], np.int64)
        wanted = _wanted(row, *(np.frombuffer(row[name], np.int64)[None] for name in ("low", "high")), [row["present"]], (0, 0))[:, 0]
        values = scores(q, candidates)
        for a in np.flatnonzero(wanted).tolist():
            some = np.flatnonzero((c_labels == labels[a]) & (values[a] >= floor[a]) & (c_places != places[a]))
            some = some[_best(values[a, some], ids[some], c_places[some], n)]
            found.add(int(places[a]), 0, values[a, some], ids[some], c_places[some])
        if found.full():
            yield found.batch()
            found = _Found(n)
    yield found.batch()


def _read_negatives(batches: Iterator[pa.RecordBatch], n: int, bounds: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The best rows of other labels in the windows of the positives."""
    found = _Found(n)
    for row in _rows(batches):
        places, labels, q = _anchor_arrays(row)
        ids, c_labels, c_places = (np.frombuffer(row[name], np.int64) for name in ("ids", "labels", "places"))
        candidates = _matrix(row["q"], row["n"], row["dim"])
        anchor, positive, score = _positive_arrays(row)
        lowest, highest = _window(score, *bounds)
        wanted = _wanted(row, *(np.frombuffer(row[name], np.int64)[None] for name in ("low", "high")), [row["present"]], bounds)[:, 0]
        values = scores(q, candidates)
        for w in np.flatnonzero(wanted).tolist():
            a = anchor[w]
            some = np.flatnonzero((c_labels != labels[a]) & (values[a] >= lowest[w]) & (values[a] <= highest[w]))
            some = some[_best(values[a, some], ids[some], c_places[some], n)]
            found.add(int(places[a]), int(positive[w]), values[a, some], ids[some], c_places[some])
        if found.full():
            yield found.batch()
            found = _Found(n)
    yield found.batch()


def _best_rows(found: DataFrame, n: int, rank: str) -> DataFrame:
    """The ``n`` best rows of each anchor and positive. At most as many as there are tasks times ``n`` come together for one."""
    each = F.struct((-F.col("value")).alias("minus"), "id", "place")
    best = found.groupBy("anchor", "positive").agg(F.slice(F.sort_array(F.collect_list(each)), 1, n).alias("best"))
    return best.select("anchor", "positive", F.posexplode("best").alias(rank, "row")).select(
        "anchor", "positive", (F.col(rank) + 1).alias(rank), (-F.col("row.minus")).alias("value"), "row.id", "row.place"
    )


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    block: int = BLOCK,
    per_slice: int = SLICE,
    group: int = GROUP,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor, positive and negative.

    Components are multiplied by ``scale`` and rounded down; a score is the inner product of the whole numbers. ``anchors`` is a condition on the
    rows of ``vectors``. An anchor's positives are its ``n_positives`` best other rows with its label, a positive's negatives the
    ``n_negatives`` best rows with other labels whose score times 100 lies between ``low`` and ``high`` times the positive's score, both included.
    Equal scores are ordered by id. ``rank`` counts from 1 for each anchor and positive.

    Rows with a null id, a null label, a null or empty vector or a null or non-finite component take no part, nor do rows so long that a score could
    overflow (``LARGEST``). Vectors of different lengths have no score and do not meet. Of rows that share an id each counts, with any order
    among them the same on every run that reads the same table. Positives with a negative score have an empty window. No rows or no anchors give an empty
    result. Other columns are not read. Results are exact: the bounds leave out only blocks that hold nothing wanted.
    """
    if min(n_positives, n_negatives, scale, block, per_slice, group) < 1:
        raise ValueError("counts, scale and sizes are at least 1")
    rows = stage(scaled_rows(vectors, anchors, scale, id_col, label_col, vector_col), "vectors")
    axes, least, greatest = fitted_axes(rows)
    placed = stage(rows.mapInArrow(lambda batches: _place_rows(batches, axes, least, greatest), _ROWS), "placed-vectors")
    n_rows, n_anchors = placed.agg(F.count("*"), F.count_if("anchor")).first()
    blocks = ordered_blocks(placed, n_rows, block, per_slice, "candidate-blocks")
    groups = ordered_blocks(placed.filter("anchor"), n_anchors, group, per_slice, "anchor-groups").select(
        F.col("block").alias("grp"), "dim", *[F.col(name).alias(f"a_{name}") for name in ("n", "places", "labels", "q")]
    )
    # One row per slice and length of vectors, of a slice's worth of zone maps at most.
    maps = F.sort_array(F.collect_list(F.struct("block", "low", "high", "present")))
    zones = blocks.groupBy("slice", "dim").agg(maps.alias("maps"))
    zones = stage(
        zones.select(
            "slice",
            "dim",
            F.col("maps.block").alias("z_block"),
            F.aggregate("maps.low", F.lit(b"").cast("binary"), lambda all_, one: F.concat(all_, one)).alias("z_low"),
            F.aggregate("maps.high", F.lit(b"").cast("binary"), lambda all_, one: F.concat(all_, one)).alias("z_high"),
            F.col("maps.present").alias("z_present"),
        ),
        "zone-maps",
    )
    last_slice = blocks.agg(F.coalesce(F.max("slice"), F.lit(0))).first()[0]

    def read(asking: DataFrame, bounds: tuple[int, int], reader, first: bool = False) -> DataFrame:
        """What ``reader`` finds in the blocks that the groups must read."""
        everywhere = asking.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last_slice).cast("long"))))
        met = everywhere.join(zones, ["slice", "dim"])
        kept = [name for name in met.columns if not name.startswith("z_")]
        schema = T.StructType([*met.select(*kept).schema.fields, T.StructField("read", T.ArrayType(T.LongType()))])
        chosen = stage(met.mapInArrow(lambda batches: _choose(batches, bounds, first), _spelled(schema, met.columns)), "block-reads")
        to_read = chosen.join(blocks.drop("anchors"), ["slice", "dim"]).filter(F.array_contains("read", F.col("block")))
        return to_read.drop("read", "slice", "grp").mapInArrow(reader, _FOUND)

    none = [F.lit(None).cast("binary").alias(name) for name in ("w_anchor", "w_positive", "w_score")]

    def positives(asking: DataFrame, first: bool) -> DataFrame:
        found = read(asking.select("*", *none), (0, 0), lambda batches: _read_positives(batches, n_positives), first)
        return _best_rows(found, n_positives, "rank")

    lowest = F.lit(np.iinfo(np.int64).min)
    floors = (
        positives(_with_floors(groups, None), True)
        .groupBy("anchor")
        .agg(F.min(F.when(F.col("rank") == n_positives, F.col("value"))).alias("floor"))
        .select("anchor", F.coalesce("floor", lowest).alias("floor"))
    )
    best = stage(positives(_with_floors(groups, floors), False), "positives")
    windows = _with_windows(groups, best)
    negatives = _best_rows(read(windows, (low, high), lambda batches: _read_negatives(batches, n_negatives, (low, high))), n_negatives, "rank")
    ids = placed.filter("anchor").select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    told = best.select("anchor", F.col("rank").cast("long").alias("positive"), F.col("id").alias("positive_id"), F.col("value").alias("positive_score"))
    return (
        negatives.join(told, ["anchor", "positive"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("value").alias("negative_score"))
    )


def _spelled(schema: T.StructType, order: list[str]) -> T.StructType:
    fields = {field.name: field for field in schema.fields}
    return T.StructType([fields[name] for name in order if name in fields] + [fields["read"]])


def _members(groups: DataFrame) -> DataFrame:
    """``grp, at, anchor`` for each anchor of each group: its position in the group and its number."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, blob in zip(batch["grp"].to_pylist(), batch["a_places"].to_pylist()):
                places = np.frombuffer(blob, np.int64)
                columns = [np.full(len(places), grp, np.int64), np.arange(len(places), dtype=np.int64), places]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["grp", "at", "anchor"])

    return groups.select("grp", "a_places").mapInArrow(spell, "grp long, at long, anchor long")


def _packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows of each group, ordered, as one blob of whole numbers per column. A group has a bounded number of rows."""
    gathered = rows.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [[np.array([row[name] for row in rows], np.int64).tobytes() for rows in batch["rows"].to_pylist()] for name in names]
            yield pa.RecordBatch.from_arrays([batch["grp"], *[pa.array(blob, pa.binary()) for blob in blobs]], names=["grp", *names])

    return gathered.mapInArrow(pack, ", ".join(["grp long", *[f"{name} binary" for name in names]]))


def _with_floors(groups: DataFrame, floors: DataFrame | None) -> DataFrame:
    """The groups with the score that each anchor's positives are known to reach, as ``a_floor``."""
    members, lowest = _members(groups), F.lit(np.iinfo(np.int64).min)
    known = members.withColumn("floor", lowest) if floors is None else members.join(floors, "anchor", "left").withColumn("floor", F.coalesce("floor", lowest))
    packed = _packed(known.select("grp", "at", F.col("floor").alias("a_floor")), ["at", "a_floor"]).drop("at")
    return stage(groups.join(packed, "grp"), "asking")


def _with_windows(groups: DataFrame, best: DataFrame) -> DataFrame:
    """The groups with the windows of their positives, in at most ``GROUP`` times the number of positives."""
    windows = _members(groups).join(best.select("anchor", "rank", "value"), "anchor")
    names = {"at": "w_anchor", "rank": "w_positive", "value": "w_score"}
    packed = _packed(windows.select("grp", *[F.col(old).cast("long").alias(new) for old, new in names.items()]), list(names.values()))
    return stage(groups.join(packed, "grp").withColumn("a_floor", F.lit(None).cast("binary")), "windows")
