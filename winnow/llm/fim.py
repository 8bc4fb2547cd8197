"""Fill-in-middle transformation of documents by a piece table, and its inverse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from winnow.llm.batches import SPACED, Words, map_batches, map_texts, utf8

#: Buffers of a piece table: 0 is the text itself, these hold the sentinels.
TEXT, PREFIX, SUFFIX, MIDDLE = range(4)
SENTINELS = {PREFIX: b"<P>", SUFFIX: b"<S>", MIDDLE: b"<M>"}
#: For each form the order in which it gives prefix (0), middle (1) and suffix (2), each behind its sentinel.
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
PLAIN = "plain"
_MARK = (PREFIX, MIDDLE, SUFFIX)

SEED = 42
#: Documents in a hundred that are transformed, and of these the ones in form spm.
RATE = 50
SPM_RATE = 80


class Piece(NamedTuple):
    """Descriptor of the bytes ``start`` to ``stop`` of a buffer. Buffers never change; only descriptors do."""

    buffer: int
    start: int
    stop: int


def cut(piece: Piece, places: Iterable[int]) -> list[Piece]:
    """Split a descriptor at ascending places of its buffer; parts may be empty."""
    bounds = [piece.start, *places, piece.stop]
    return [Piece(piece.buffer, a, b) for a, b in zip(bounds, bounds[1:])]


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    """The permutation that undoes ``order``."""
    return tuple(order.index(i) for i in range(len(order)))


def arrange(sections: list[Piece], form: str) -> list[Piece]:
    """Descriptors of the output: the sections in the order of the form, each behind its sentinel."""
    found = []
    for i in FORMS[form]:
        found += [Piece(_MARK[i], 0, len(SENTINELS[_MARK[i]])), sections[i]]
    return found


def sections_of(output: bytes, form: str) -> list[Piece]:
    """Prefix, middle and suffix of an output, as descriptors over it: its sentinels are cut out, its order undone.

    No text that was transformed holds a sentinel, and no sentinel can begin or end inside another one, so
    the first place of each is its own.
    """
    own, at = [], 0
    marks = [SENTINELS[_MARK[i]] for i in FORMS[form]]
    for mark, following in zip(marks, [*marks[1:], None]):
        if output[at : at + len(mark)] != mark:
            raise ValueError(f"not an output of form {form}")
        begin = at + len(mark)
        at = len(output) if following is None else output.find(following, begin)
        if at < 0:
            raise ValueError(f"not an output of form {form}")
        own.append(Piece(TEXT, begin, at))
    return [own[i] for i in inverse(FORMS[form])]


def buffers(text: bytes | memoryview) -> dict[int, bytes | memoryview]:
    return {TEXT: text, **SENTINELS}


def joined(pieces: Iterable[Piece], held: dict[int, bytes | memoryview]) -> bytes:
    return b"".join(held[p.buffer][p.start : p.stop] for p in pieces)


def digest(pieces: Iterable[Piece], held: dict[int, bytes | memoryview]) -> str:
    """Lower-case hex SHA-256 of what the descriptors stand for, read piece by piece and never joined."""
    sha = hashlib.sha256()
    for p in pieces:
        sha.update(memoryview(held[p.buffer])[p.start : p.stop])
    return sha.hexdigest()


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers that depend on the document and the seed alone; without doc_id, on the seed."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[i : i + 8], 16) for i in range(0, 32, 8)]


class Units(NamedTuple):
    """Where each text of a piece can be cut: after white space and the word behind it, or after white space at its end."""

    data: np.ndarray
    offsets: np.ndarray
    words: Words
    counts: np.ndarray  # units of each text
    holds_sentinel: np.ndarray

    def place(self, row: int, k: int) -> int:
        """The byte after the first ``k`` units of a text."""
        if not k:
            return int(self.offsets[row])
        if k <= self.words.counts[row]:
            return int(self.words.ends[self.words.first[row] + k - 1])
        return int(self.offsets[row + 1])


def units(column: pa.Array) -> Units:
    data, offsets = utf8(column)
    words = Words(data, offsets, SPACED)
    sizes = np.diff(offsets)
    trailing = np.zeros(len(sizes), bool)
    trailing[sizes > 0] = ~SPACED[data[offsets[1:][sizes > 0] - 1]]
    first = {mark[0] for mark in SENTINELS.values()}.pop()
    at = np.flatnonzero(data[:-2] == first) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 2] == SENTINELS[PREFIX][2]) & np.isin(data[at + 1], [mark[1] for mark in SENTINELS.values()])]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 2 < offsets[row + 1]
    holds = np.bincount(row[inside], minlength=len(sizes)) > 0
    return Units(data, offsets, words, words.counts + trailing, holds)


def _strings(values: list[bytes]) -> pa.Array:
    """Bytes of texts as a string column, as they are: what came in as text is not tested again."""
    return pa.array(values, pa.binary()).view(pa.string())


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, output_sha256`` of every document.

    A text is cut into ``n`` units: white space and the word behind it, and white space at its end. Two of four
    numbers drawn from a hash of seed and doc_id say after how many units prefix and middle end, the third whether
    the text is transformed at all (``rate`` in a hundred), the fourth its form (``spm_rate`` in a hundred: ``spm``).
    The text is never copied until the output is written: cutting splits a descriptor, a form permutes descriptors and
    puts sentinels between, the hash reads descriptors in turn.

    A null text is empty. Empty texts and texts that hold a sentinel are ``plain``: they stay as they are and have null
    lengths. Lengths are code points. Documents without doc_id draw as if it were written as nothing. Every row has a
    row of its own, so equal rows give equal ones; whole texts are cut however long they are, one longer than a
    megabyte on its own; other columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = units(batch.column("text"))
        starts = np.zeros(len(found.data) + 1, np.int64)
        np.cumsum((found.data & 0xC0) != 0x80, out=starts[1:])
        held = buffers(found.data.tobytes())
        forms, prefixes, middles, outputs, digests = [], [], [], [], []
        for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            whole = Piece(TEXT, int(found.offsets[row]), int(found.offsets[row + 1]))
            n = int(found.counts[row])
            h1, h2, h3, h4 = draws(doc_id, seed)
            if not n or found.holds_sentinel[row] or h3 % 100 >= rate:
                form, table, lengths = PLAIN, [whole], (None, None)
            else:
                form = "spm" if h4 % 100 < spm_rate else "psm"
                sections = cut(whole, (found.place(row, k) for k in sorted((h1 % (n + 1), h2 % (n + 1)))))
                table = arrange(sections, form)
                lengths = tuple(int(starts[p.stop] - starts[p.start]) for p in sections[:2])
            forms.append(form)
            prefixes.append(lengths[0])
            middles.append(lengths[1])
            outputs.append(joined(table, held))
            digests.append(digest(table, held))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(found.counts.astype(np.int64)),
                pa.array(forms, pa.string()),
                pa.array(prefixes, pa.int64()),
                pa.array(middles, pa.int64()),
                _strings(outputs),
                pa.array(digests, pa.string()),
            ],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"],
        )

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def restore(rows: DataFrame) -> DataFrame:
    """The rows with ``restored`` in place of ``output``: the text rebuilt from ``output`` and ``form`` alone.

    The sentinels of an output are cut out of its descriptor and the permutation of its form is undone. A plain output
    is the text; a null output or form gives null. An output that is not of its form is an error. A column named
    ``restored`` is replaced.
    """
    kept = [c for c in rows.columns if c != "restored"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*[f"`{c}`" for c in kept if c != "output"]).dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        outputs = batch.column("output").cast(pa.binary()).to_pylist()
        for output, form in zip(outputs, batch.column("form").to_pylist()):
            if output is None or form is None:
                texts.append(None)
            else:
                texts.append(output if form == PLAIN else joined(sections_of(output, form), buffers(output)))
        own = [c for c in kept if c != "output"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), _strings(texts)], [*own, "restored"])

    return map_batches(rows.select(*[f"`{c}`" for c in kept]), run, f"{kinds}, restored string")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every document.

    The digests are of the output of ``transform`` and of the text that ``restore`` makes of it; nulls, empty and long
    texts, repeated rows and empty tables as stated there.
    """
    return restore(transform(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256")
    )
