"""Helpers for work on Arrow batches: pieces of bounded size, raw text bytes, words and their hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes handled at once inside a task; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def map_texts(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = PIECE_BYTES
) -> DataFrame:
    """Apply ``fn`` to pieces of the Arrow batches that hold at most ``limit`` bytes of ``text``, or one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit):
                yield fn(piece)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of ``text``, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, joined, and the offsets of its rows; null counts as empty."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, filled.offset * 8)
    held = filled.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power of 0 to n - 1, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes with A to Z in lower case.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words that end at ASCII white space.
SPACED = np.array([b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) for b in range(256)])
#: Bytes of words of lower-case letters and everything beyond ASCII.
LETTERS = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bytes of words made of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class Words:
    """The words of a piece of texts: byte ranges, row of each word, and words per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        self.data, self.offsets = LOWER[data], offsets
        inside = member[self.data]
        edge = np.zeros(len(data) + 1, bool)  # a new row also ends a word
        edge[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        bounds = np.searchsorted(self.starts, offsets)
        self.first, self.counts = bounds[:-1], np.diff(bounds)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same on every machine."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        own = (sums[self.ends] - sums[self.starts]) * powers(_INVERSE, n + 1)[self.starts]
        return mix(own + (self.ends - self.starts).astype(np.uint64))

    def strings(self, chosen: np.ndarray) -> pa.Array:
        """The chosen words (ascending numbers) as a column of bytes."""
        edges = np.zeros(len(self.data) + 1, np.int8)
        edges[self.starts[chosen]] += 1
        edges[self.ends[chosen]] -= 1
        held = self.data[np.cumsum(edges[:-1]).astype(bool)]
        offsets = np.concatenate(([0], np.cumsum((self.ends - self.starts)[chosen]))).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(held)])

    def text(self, start: int, stop: int) -> str:
        """Words ``start`` to ``stop - 1``, joined by spaces."""
        held = self.data
        return " ".join(
            held[s:e].tobytes().decode("utf-8", "replace")
            for s, e in zip(self.starts[start:stop].tolist(), self.ends[start:stop].tolist())
        )
