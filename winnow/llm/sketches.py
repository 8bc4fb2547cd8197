"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, and what differs between two of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from winnow.llm.batches import PIECE_BYTES, SPACED, Words, map_texts, mix, powers, utf8
from winnow.sources.scratch import cut_lineage

#: A paragraph ends at a line feed, and at one word in so many, chosen by the word itself: an edit moves no other end.
PASSAGE_WORDS = 4
#: Each digest lies in one cell of each of three parts; a fingerprint has parts of so many cells.
PARTS, WIDTH = 3, 4
#: A sketch that cannot be peeled is made again with so many times the cells.
GROWTH = 2

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALTS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]
_ODD = np.uint64(0x9FB21C651E98DF25)


class Digests(NamedTuple):
    """Digests of the paragraphs of some texts; the repeats of a paragraph in a text differ, so each text has a set."""

    keys: np.ndarray
    row: np.ndarray  # ascending
    rows: int

    def of(self, chosen: np.ndarray) -> Digests:
        """The digests of the chosen rows, which are numbered anew."""
        place = np.full(self.rows, -1)
        place[chosen] = np.arange(len(chosen))
        own = place[self.row]
        return Digests(self.keys[own >= 0], own[own >= 0], len(chosen))

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte at which each paragraph begins, and the end of the last; texts are cut into paragraphs without a gap."""
    words = Words(data, offsets, SPACED)
    chosen = words.hashes() % np.uint64(PASSAGE_WORDS) == 0
    ends = np.concatenate((offsets, np.flatnonzero(data == 0x0A) + 1, words.ends[chosen]))
    held = np.zeros(len(data) + 1, bool)
    held[ends] = True
    bounds = np.flatnonzero(held)
    return bounds[:-1], bounds[1:]


def digests(data: np.ndarray, offsets: np.ndarray) -> Digests:
    """The paragraph digests of texts, given as joined bytes and the offsets of the rows."""
    starts, ends = paragraphs(data, offsets)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    own = mix((sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))
    row = np.searchsorted(offsets, starts, side="right") - 1
    order = np.lexsort((own, row))
    same = np.zeros(len(own), bool)
    same[1:] = (own[order][1:] == own[order][:-1]) & (row[order][1:] == row[order][:-1])
    place = np.arange(len(own))
    repeat = np.zeros(len(own), np.uint64)
    repeat[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    return Digests(mix(own + repeat * _ODD), row, len(offsets) - 1)


def _slot(keys: np.ndarray, part: int, width: int) -> np.ndarray:
    return ((mix(keys ^ _SALTS[part]) >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + _ODD) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """For each row ``PARTS * width`` cells: how many digests lie there, and the sums of digests and of their checks."""

    def __init__(self, rows: int, width: int):
        size = rows * PARTS * width
        self.rows, self.width = rows, width
        self.count, self.key, self.check = np.zeros(size, np.int32), np.zeros(size, np.uint64), np.zeros(size, np.uint32)

    @classmethod
    def of(cls, found: Digests, width: int) -> Sketches:
        made = cls(found.rows, width)
        made.add(found.keys, found.row, np.ones(len(found.keys), np.int32))
        return made

    def _places(self, keys: np.ndarray, row: np.ndarray, part: int) -> np.ndarray:
        return (row * PARTS + part) * self.width + _slot(keys, part, self.width)

    def add(self, keys: np.ndarray, row: np.ndarray, sign: np.ndarray) -> None:
        signed, checked = keys * sign.astype(np.uint64), _check(keys) * sign.astype(np.uint32)
        for part in range(PARTS):
            at = self._places(keys, row, part)
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, signed)
            np.add.at(self.check, at, checked)

    def minus(self, other: Sketches) -> Sketches:
        """Cell by cell: what both hold is gone."""
        made = Sketches(self.rows, self.width)
        made.count, made.key, made.check = self.count - other.count, self.key - other.key, self.check - other.check
        return made

    def pure(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``keys, row, sign`` of the cells of a part that hold one digest alone."""
        row, slot = np.nonzero(np.abs(self.count.reshape(self.rows, PARTS, self.width)[:, part]) == 1)
        at = (row * PARTS + part) * self.width + slot
        sign = self.count[at]
        keys = self.key[at] * sign.astype(np.uint64)
        true = (self.check[at] * sign.astype(np.uint32) == _check(keys)) & (_slot(keys, part, self.width) == slot)
        return keys[true], row[true], sign[true]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out digests that are alone in a cell until none is; ``keys, row, sign`` of all."""
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        rounds, before = 0, -1
        while len(found) != before and rounds < 64 + self.width:  # more rounds than a sketch can need
            before, rounds = len(found), rounds + 1
            for part in range(PARTS):
                keys, row, sign = self.pure(part)
                if len(keys):
                    self.add(keys, row, -sign)
                    found.append((keys, row, sign))
        return tuple(np.concatenate(x) for x in zip(*found))

    def empty(self) -> np.ndarray:
        """Which rows have nothing left."""
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return ~left.reshape(self.rows, -1).any(axis=1)

    def bytes(self, counts: np.ndarray) -> list[bytes]:
        """Each row's number of digests and cells, in a fixed order of bytes."""
        size = PARTS * self.width
        cells = np.zeros(len(self.count), np.dtype([("count", "<i4"), ("check", "<u4"), ("key", "<u8")]))
        cells["count"], cells["check"], cells["key"] = self.count, self.check, self.key
        return [int(n).to_bytes(8, "little") + cells[i * size : (i + 1) * size].tobytes() for i, n in enumerate(counts)]


class Difference(NamedTuple):
    keys: np.ndarray
    row: np.ndarray
    sign: np.ndarray  # 1: only the first has the digest, -1: only the second


def differences(one: Digests, other: Digests, width: int = WIDTH) -> Difference:
    """The digests that only one of both has, row by row, by peeling the difference of their sketches.

    A row whose sketch cannot be peeled to nothing is tried again with more cells, up to where it can.
    """
    active = np.arange(one.rows)
    found = []
    while len(active):
        left = Sketches.of(one.of(active), width).minus(Sketches.of(other.of(active), width))
        keys, row, sign = left.peel()
        done = left.empty()
        own = done[row]
        found.append((keys[own], active[row[own]], sign[own]))
        active, width = active[~done], width * GROWTH
    return Difference(*(np.concatenate(x) for x in zip(*found))) if found else Difference(*(np.zeros(0, np.int64),) * 3)


def likeness(one: Digests, other: Digests, found: Difference) -> np.ndarray:
    """Shared digests out of all digests of both, row by row; 1 for two texts without any."""
    only = np.bincount(found.row, minlength=one.rows)
    total = one.counts() + other.counts()
    shared = (total - only) / 2
    return np.where(total > 0, shared / np.maximum(total - shared, 1), 1.0)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_paragraphs, fingerprint`` of every document, the sketch in lower-case hex.

    Equal texts have equal fingerprints, null counts as empty. Every row has a row of its own. Whole texts are read,
    one longer than a megabyte on its own. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = digests(*utf8(batch.column("text")))
        made = Sketches.of(found, width).bytes(found.counts())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found.counts()), pa.array([x.hex() for x in made])],
            ["doc_id", "n_paragraphs", "fingerprint"],
        )

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_paragraphs long, fingerprint string")


class _Edits(NamedTuple):
    data: np.ndarray
    offsets: np.ndarray
    chars: np.ndarray
    sha: list[bytes]


def edited(texts: list[bytes], after: list[bytes]) -> _Edits:
    """Each text with its last half (rounded down, in code points) replaced by as many of the one after it, or all."""

    def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(begins, offsets)
        return data, offsets, begins, first

    _, offsets, begins, first = joined(texts)
    chars = np.diff(first)
    half = chars // 2
    keep = begins[first[1:] - half] - offsets[:-1]
    _, offsets, begins, first = joined(after)
    take = begins[first[:-1] + np.minimum(half, np.diff(first))] - offsets[:-1]
    made = [t[:k] + a[:n] for t, k, a, n in zip(texts, keep.tolist(), after, take.tolist())]
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int64)
    return _Edits(np.frombuffer(b"".join(made), np.uint8), sizes, chars, [hashlib.sha256(x).digest() for x in made])


_DONE, _FIRST, _LAST = 0, 1, 2
_RESULT = (
    "doc_id long, n_chars long, edited_sha binary, own binary, edited binary, near_edited double, near_next double, "
    "n_paragraphs long, n_added long, n_removed long"
)


def _compared(ids: list, texts: list[bytes], after: list[bytes]) -> list[pa.Array]:
    """The columns of the result for texts that are followed by others."""
    edits = edited(texts, after)

    def whole(parts: list[bytes]) -> Digests:
        sizes = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        return digests(np.frombuffer(b"".join(parts), np.uint8), sizes)

    own, new, following = whole(texts), digests(edits.data, edits.offsets), whole(after)
    changed, apart = differences(own, new), differences(own, following)
    return [
        pa.array(ids, pa.int64()),
        pa.array(edits.chars),
        pa.array(edits.sha, pa.binary()),
        pa.array(Sketches.of(own, WIDTH).bytes(own.counts()), pa.binary()),
        pa.array(Sketches.of(new, WIDTH).bytes(new.counts()), pa.binary()),
        pa.array(likeness(own, new, changed)),
        pa.array(likeness(own, following, apart)),
        pa.array(own.counts()),
        pa.array(np.bincount(changed.row[changed.sign < 0], minlength=own.rows)),
        pa.array(np.bincount(changed.row[changed.sign > 0], minlength=own.rows)),
    ]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _in_sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with the next; hand on the first row and the last one, which has none here."""
    schema = ["kind", "part", "text", *(c.split(" ")[0] for c in _RESULT.split(", "))]
    part = TaskContext.get().partitionId()

    def batch(kind: int, text: bytes | None, columns: list[pa.Array]) -> pa.RecordBatch:
        n = len(columns[0])
        head = [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([text] * n, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays([*head, *columns], schema)

    def edge(kind: int, doc_id: int | None, text: bytes) -> pa.RecordBatch:
        return batch(kind, text, [pa.array([doc_id], pa.int64()), *_blank(1)])

    ids: list = []
    texts: list[bytes] = []
    size, begun = 0, False
    for rows in batches:
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), _bytes(rows.column("text"))):
            if not begun:
                begun = True
                yield edge(_FIRST, doc_id, text)
            if len(texts) > 1 and size + len(text) > PIECE_BYTES:
                yield batch(_DONE, None, _compared(ids[:-1], texts[:-1], texts[1:]))
                ids, texts = ids[-1:], texts[-1:]
                size = len(texts[0])
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if len(texts) > 1:
        yield batch(_DONE, None, _compared(ids[:-1], texts[:-1], texts[1:]))
    if texts:
        yield edge(_LAST, ids[-1], texts[-1])


def _blank(n: int) -> list[pa.Array]:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return [pa.nulls(n, kinds[c.split(" ")[1]]) for c in _RESULT.split(", ")[1:]]


def version_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, n_added,
    n_removed`` of every document.

    In descending doc_id, a text's last half (code points, rounded down) is replaced by as many of the next document's first
    ones, or all it has; after the last document comes the first, and one alone comes after itself. Paragraph digests of
    text, edited text and next text go into sketches; the sketches of two texts are subtracted and peeled, which gives the
    digests that only one of them has: likeness is the shared digests out of all. A sketch that is too small is made
    again with twice the cells until it can be peeled, so likeness is exact. ``n_added`` and ``n_removed`` count the
    paragraphs that only the edited or only the own text has.

    Null texts are empty; two empty texts are alike (1). Documents with equal doc_id come by a hash of their text, those
    without doc_id last; repeated rows each get a row. Texts of any length are taken whole, about a megabyte at
    a time or one alone; other columns are ignored; an empty table gives an empty result.

    Rows are dealt by ranges of that order, so texts are shuffled once. Only the first and the last row of each range
    are joined afterwards; the driver sees the numbers of the ranges, no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("by_text"), F.asc("by_row")]
    # the last one only parts equal rows, so that many of them need not be one range
    keyed = docs.withColumns({"by_text": F.xxhash64("text"), "by_row": F.monotonically_increasing_id()})
    ranges = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = cut_lineage(ranges.mapInArrow(_in_sequence, f"kind int, part int, text string, {_RESULT}"), "versions")
    first = rows.where(F.col("kind") == _FIRST).select(F.col("part").alias("next"), F.col("text").alias("after"))
    last = rows.where(F.col("kind") == _LAST).select("part", "doc_id", "text")
    parts = sorted(r["next"] for r in first.select("next").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _RESULT.split(", ")]
        for batch in batches:
            texts, after = _bytes(batch.column("text")), _bytes(batch.column("after"))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                yield pa.RecordBatch.from_arrays(_compared([doc_id], texts[i : i + 1], after[i : i + 1]), names)

    edges = last.join(follows, "part").join(first, "next").select("doc_id", "text", "after").mapInArrow(run, _RESULT)
    done = rows.where(F.col("kind") == _DONE).select(*edges.columns).unionByName(edges)
    return done.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        F.lower(F.hex("own")).alias("fingerprint"),
        F.lower(F.hex("edited")).alias("edited_fingerprint"),
        *["near_edited", "near_next", "n_paragraphs", "n_added", "n_removed"],
    )
