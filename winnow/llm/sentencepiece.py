"""SentencePiece encoding and decoding as a shortest path through a transducer."""

from __future__ import annotations

import re
from collections.abc import Iterable
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from winnow.llm.batches import map_batches, map_texts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Encoded chunks, parts of them and pairs that a worker remembers, about a hundred megabytes in all; when full, it starts anew.
MEMO_ENTRIES = 250_000
PAIR_ENTRIES = 200_000
MEMO_CHARS = 48

# Fixed values of the model format: piece kinds and model kinds.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Model(NamedTuple):
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_kind: int
    dummy_prefix: bool
    byte_fallback: bool


def _fields(data: bytes):
    """Field number and value of each entry of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> Model:
    """Pieces, scores and settings of a SentencePiece model file."""
    pieces, scores, kinds = [], [], []
    trainer, normalizer = {}, {}
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(piece.get(3, NORMAL))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    model_kind = trainer.get(3, UNIGRAM)
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only models with the identity normaliser that keep and escape spaces are supported")
    if USER_DEFINED in kinds or model_kind not in (UNIGRAM, BPE):
        raise ValueError("user-defined pieces, word and character models are not supported")
    return Model(pieces, scores, kinds, model_kind, bool(normalizer.get(3, 1)), bool(trainer.get(35, 0)))


_NONE: dict[str, bool] = {}


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Transducer:
    """Normaliser, pieces and byte fallback, compiled once per worker and composed with each chunk of a text.

    A state is a place in the chunk and the piece that ends there. An arc reads a piece and writes its
    id; a character that no piece holds is written as its bytes. In a unigram model an arc weighs the
    negative score of its piece. In a BPE model an arc weighs 0 if merging leaves the two neighbouring
    pieces apart, and is infinite otherwise: a sequence of pieces is what merging gives exactly if
    every pair of neighbours is, so one path is finite. Longer pieces are tried first, which makes no
    difference to that path but finds it sooner.

    A text is cut where no piece can reach across: before spaces, and between characters that no piece
    has side by side. Shortest paths of the parts joined are the shortest path of the whole.
    """

    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] == NORMAL}
        self.code = {p: _packed([i]) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.unknown = model.kinds.index(UNKNOWN)
        self.reach = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.start: dict = {}  # the pieces as a tree: by character, the piece that ends there, if one does, and what may follow
        for p in self.ids:
            node = self.start
            for char in p:
                entry = node.setdefault(char, [None, {}])
                node = entry[1]
            entry[0] = p
        inner = {b for a, b in self.reach if a != SPACE}
        lines = "\n" if not any("\n" in p for p in self.ids) else ""
        if SPACE in inner:
            self.chunk = re.compile(".+", re.S)
        else:
            self.chunk = re.compile(f"{SPACE}+[^{SPACE}{lines}]*|[^{SPACE}{lines}]+" + ("|\n" if lines else ""))
        self.pairs: dict[str, dict[str, bool]] = {}  # by the left piece, then the right one
        self.n_pairs = 0
        self.memo = _Memo(self)
        self.parts: dict[str, bytes] = {}
        self.table = [self._written(i) for i in range(len(model.pieces))]

    def _written(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    def encode(self, text: str) -> bytes:
        """The ids of a text, as the bytes of 32-bit numbers."""
        if not text:
            return b""
        normal = text.replace(" ", SPACE)
        if self.model.dummy_prefix:
            normal = SPACE + normal
        ids = b"".join(map(self.memo.__getitem__, self.chunk.findall(normal)))
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        if len(self.parts) > MEMO_ENTRIES:
            self.parts.clear()
        if self.n_pairs > PAIR_ENTRIES:
            self.pairs.clear()
            self.n_pairs = 0
        return ids

    def decode(self, ids) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of a chunk, from those of the parts that no piece reaches across."""
        reach = self.reach
        if reach.issuperset(map(add, chunk, chunk[1:])):
            return self._part_ids(chunk)
        ids, start = [], 0
        for k in range(1, len(chunk) + 1):
            if k == len(chunk) or chunk[k - 1 : k + 1] not in reach:
                ids.append(self._part_ids(chunk[start:k]))
                start = k
        return b"".join(ids)

    def _part_ids(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self._best(part) if self.model.model_kind == UNIGRAM else self._only(part)
            if len(part) <= MEMO_CHARS:
                self.parts[part] = found
        return found

    def _fallback(self, char: str) -> bytes:
        if self.model.byte_fallback:
            return _packed([self.bytes[b] for b in char.encode("utf-8", "replace")])
        return _packed([self.unknown])

    def _written_ids(self, path: Iterable[str]) -> bytes:
        code = self.code
        return b"".join([code[p] if p in code else self._fallback(p) for p in path])

    def _only(self, part: str) -> bytes:
        """The finite path of a BPE model."""
        code, n = self.code, len(part)
        if n == 1:
            return self._written_ids(part)
        if n <= self.longest and part in code and self.apart("", part):
            return code[part]
        # The path so far, and for each of its pieces those still to try in its place, the last one first.
        path, left = [], []
        at, before, ends, pairs, root = 0, "", None, self.pairs, self.start
        while at < n:
            if ends is None:
                char = part[at]
                ends, entry = [char], root.get(char)
                if entry:
                    node = entry[1]
                    for char in part[at + 1 : at + self.longest]:
                        entry = node.get(char)
                        if entry is None:
                            break
                        piece, node = entry
                        if piece:
                            ends.append(piece)
            known = pairs.get(before, _NONE)
            while ends:
                piece = ends.pop()
                fits = known.get(piece)
                if fits is None:
                    fits = self.apart(before, piece)
                if fits:
                    path.append(piece)
                    left.append(ends)
                    at += len(piece)
                    before, ends = piece, None
                    break
            else:
                at -= len(path.pop())
                ends, before = left.pop(), path[-1] if path else ""
        return self._written_ids(path)

    def apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of both pieces ends with exactly these two."""
        after = self.pairs.setdefault(left, {})
        known = after.get(right)
        if known is None:
            known = after[right] = self.merged(left + right) == ([left, right] if left else [right])
            self.n_pairs += 1
        return known

    def merged(self, text: str) -> list[str]:
        """Join the best neighbours, the first of equals, until none are a piece together."""
        parts, scores, ids = list(text), self.model.scores, self.ids
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _best(self, part: str) -> bytes:
        """The lightest path of a unigram model; of equals, the one whose last piece starts first."""
        ids, scores = self.ids, self.model.scores
        unknown = min(scores) - 10
        cost, back = [0.0] + [float("inf")] * len(part), [0] * (len(part) + 1)
        for end in range(1, len(part) + 1):
            for start in range(max(0, end - self.longest), end):
                i = ids.get(part[start:end])
                weight = -scores[i] if i is not None else -unknown if end == start + 1 else None
                if weight is not None and cost[start] + weight < cost[end]:
                    cost[end], back[end] = cost[start] + weight, start
        path, end = [], len(part)
        while end:
            path.append(part[back[end] : end])
            end = back[end]
        return self._written_ids(reversed(path))


class _Memo(dict):
    """Ids of the chunks met so far."""

    def __init__(self, owner: Transducer):
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        ids = self.owner.chunk_ids(chunk)
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids


_COMPILED: dict[bytes, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """The transducer of a model file, compiled once per process."""
    if data not in _COMPILED:
        _COMPILED[data] = Transducer(parse_model(data))
    return _COMPILED[data]


def read_model(path: str = MODEL_PATH) -> bytes:
    """The model file, read once by the driver and sent to the tasks with the code."""
    with open(path, "rb") as f:
        return f.read()


def _rows(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in more]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(more.values()), names + list(more))


def _ids_array(encoded: list[bytes | None]) -> pa.Array:
    sizes = np.array([len(x or b"") // 4 for x in encoded], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = np.frombuffer(b"".join(x or b"" for x in encoded), np.int32)
    gone = pa.array([x is None for x in encoded])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=gone)


def encode(docs: DataFrame, keep: list[str], model: bytes | None = None) -> DataFrame:
    """The columns ``keep`` and ``text`` with ``ids`` (array<int>) of each text.

    A null text has null ids and an empty text none. Equal texts have equal ids. No special ids are added.
    """
    data = model or read_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst = compiled(data)
        return _rows(batch, {"ids": _ids_array([t if t is None else fst.encode(t) for t in batch.column("text").to_pylist()])})

    picked = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "text"])])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    return map_texts(picked, run, f"{schema}, ids array<int>")


def decode(rows: DataFrame, model: bytes | None = None) -> DataFrame:
    """All columns with ``decoded``, the text of ``ids``; null for null."""
    data = model or read_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst = compiled(data)
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
        texts = [
            fst.decode(flat[offsets[i] : offsets[i + 1]].tolist()) if ids[i].is_valid else None for i in range(len(ids))
        ]
        return _rows(batch, {"decoded": pa.array(texts, pa.string())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "decoded")
    return map_batches(rows.drop("decoded"), run, f"{schema}, decoded string")


def round_trip(docs: DataFrame, model: bytes | None = None, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``doc_id``, columns ``keep``, ``n_tokens, n_bytes, exact, ids`` of every document, encoded and decoded again.

    ``exact`` says whether decoding gives the text as normalised, in which U+2581 is a space. ``n_bytes``
    counts byte fallbacks. Null texts have null ids, no tokens and are exact. A document without doc_id has a row like any
    other. Texts are encoded whole, one longer than a megabyte on its own. Repeated rows each get a
    row; an empty table gives an empty result; other columns are ignored.
    """
    data = model or read_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst = compiled(data)
        texts = batch.column("text").to_pylist()
        encoded = [t if t is None else fst.encode(t) for t in texts]
        is_byte = np.array([k == BYTE for k in fst.model.kinds])
        n_bytes, exact = [], []
        for text, ids in zip(texts, encoded):
            own = np.frombuffer(ids or b"", np.int32)
            n_bytes.append(int(is_byte[own].sum()))
            exact.append(fst.decode(own.tolist()) == (text or "").replace(SPACE, " "))
        return pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in names],
                pa.array([len(x or b"") // 4 for x in encoded], pa.int64()),
                pa.array(n_bytes, pa.int64()),
                pa.array(exact, pa.bool_()),
                _ids_array(encoded),
            ],
            [*names, "n_tokens", "n_bytes", "exact", "ids"],
        )

    picked = docs.select(F.col("doc_id").cast("long"), *[c for c in keep if c in docs.columns], "text")
    names = picked.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "text")
    return map_texts(picked, run, f"{schema}, n_tokens long, n_bytes long, exact boolean, ids array<int>")
