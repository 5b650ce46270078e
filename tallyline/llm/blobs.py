"""Arrays that travel between tasks as compressed binary columns, and rows that are read group by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays as one compressed blob. All first bytes of an array go first, then all second ones and so on, so that the
    many zero bytes of small numbers lie together."""
    sizes = np.array([len(arrays), *[len(a) for a in arrays]], np.uint64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(3).compress(b"".join([sizes.tobytes(), *planes]))


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.uint64, len(types) + 1)[1:]
    out, at = [], 8 * (len(types) + 1)
    for size, kind in zip(sizes.tolist(), types):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * width
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, which pack into less; ``np.cumsum`` turns them back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Runs of rows with one key, of a partition that is sorted by it."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != current:
                yield current, rows
                rows = []
            current = row[key]
            rows.append(row)
    if rows:
        yield current, rows
