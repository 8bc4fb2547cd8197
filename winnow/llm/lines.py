"""Line dedup within an edit bound, by joining deletion neighbourhoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from winnow.llm.batches import map_texts, mix, powers
from winnow.sources.scratch import cut_lineage

#: Shorter lines (trimmed, in code points) are headings, bullets and blank lines: they always stay.
MIN_CHARS = 16
MAX_EDITS = 1
#: Bits of the filter of lines whose texts are read again; its size does not depend on the table.
FILTER_BITS = 24

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _place(doc: str = "doc_id", pos: str = "pos") -> Column:
    """Order of a line: by document, then by line number. Fixed width, so minima combine in hash tables."""
    return F.col(doc).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col(pos).cast("decimal(11,0)")


def _parts(doc: str) -> list[Column]:
    """The document and the line number of a place."""
    two = F.lit(1 << 31).cast("decimal(11,0)")
    pos = F.pmod(F.col("place"), two)
    return [((F.col("place") - pos) / two).cast("long").alias(doc), pos.cast("int").alias("pos")]


def _step(n: int) -> int:
    """A third of a line of ``n`` code points, rounded down so that most lengths share it with the next."""
    return n // 9 * 3


_SEEDS: dict[tuple[int, int], int] = {}


def gap_keys(line: str) -> list[tuple[int, int, int]]:
    """``gap, step, key`` of the line without each of three gaps.

    Two lines one edit apart agree before and after it, so both have a key with the edit inside its gap:
    the gap begins after 0, 1 or 2 steps and leaves 2, 1 or 0 steps at the end. A line whose length
    begins a new step also has the keys of the step below, for lines that are one shorter.
    """
    n = len(line)
    found = []
    for step in (_step(n), _step(n) - 3) if n % 9 == 0 else (_step(n),):
        for gap in range(3):
            seed = _SEEDS.get((gap, step))
            if seed is None:
                seed = _SEEDS[gap, step] = xxhash.xxh64_intdigest(f"{gap},{step}".encode(), 42)
            ends = line[: gap * step] + line[n - (2 - gap) * step :]
            found.append((gap, step, xxhash.xxh64_intdigest(ends.encode("utf-8", "replace"), seed)))
    return found


def _own_lines(batch: pa.RecordBatch, min_chars: int) -> dict[str, tuple[int, int]]:
    """The distinct lines of a batch that take part, with the first document and line number of each."""
    found: dict[str, tuple[int, int]] = {}
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        for pos, line in enumerate(text.split("\n")):
            line = line.strip(" ")
            if len(line) >= min_chars:
                place = (doc_id, pos)
                if found.setdefault(line, place) > place:
                    found[line] = place
    return found


def _taking_part(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")


def _classes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``place``: where each distinct line comes first."""
    return (
        _taking_part(docs)
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "pos", F.trim("line").alias("line"))
        .where(F.length("line") >= min_chars)
        .groupBy(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
        .agg(F.min(_place()).alias("place"))
        .select("place")
    )


def _shared_keys(docs: DataFrame, min_chars: int) -> np.ndarray:
    """A bit map, of fixed size, of the gap keys that at least two different lines have."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owners = [], []
        for line in _own_lines(batch, min_chars):
            own = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"))
            for _, _, key in gap_keys(line):
                keys.append(key)
                owners.append(own)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, owners)], ["key", "line"]
        )

    shared = (
        map_texts(_taking_part(docs), run, "key long, line long")
        .groupBy("key")
        .agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
        .where("lo <> hi")
    )
    slot = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    packed = (
        shared.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[packed["word"].to_numpy()] = packed["bits"].to_numpy().view(np.uint64)
    return bits


def _candidates(docs: DataFrame, min_chars: int) -> DataFrame:
    """``line, place, gaps``: distinct lines that share a gap key with another one, and which gaps (three bits a step)."""
    bits = _shared_keys(docs, min_chars)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, positions, lines, gaps = [], [], [], []
        for line, (doc_id, pos) in _own_lines(batch, min_chars).items():
            flags, top = 0, _step(len(line))
            for gap, step, key in gap_keys(line):
                slot = key >> 64 - FILTER_BITS
                if int(bits[slot >> 6]) >> (slot & 63) & 1:
                    flags |= 1 << (gap + 3 * (step < top))
            if flags:
                ids.append(doc_id)
                positions.append(pos)
                lines.append(line)
                gaps.append(flags)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(positions, pa.int32()), pa.array(lines, pa.string()), pa.array(gaps, pa.int32())],
            ["doc_id", "pos", "line", "gaps"],
        )

    found = map_texts(_taking_part(docs), run, "doc_id long, pos int, line string, gaps int")
    return found.groupBy("line").agg(F.min(_place()).alias("place"), F.bit_or("gaps").alias("gaps"))


def variant_hashes(line: str) -> tuple[int, np.ndarray]:
    """Hash of the line itself, and of the line without each of its characters in turn."""
    code = mix(np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * powers(_BASE, len(code)))))
    total = sums[-1:]
    less = sums[:-1] + (total - sums[1:]) * np.uint64(_INVERSE)
    return int(mix(total).view(np.int64)[0]), mix(less).view(np.int64)


def _variants(lines: DataFrame) -> DataFrame:
    """``key, at, place`` of the variants: the line itself (``at`` -1) and the line less one character of a shared gap."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ats, owners = [], [], []
        for i, (line, gaps) in enumerate(zip(batch.column("text").to_pylist(), batch.column("gaps").to_pylist())):
            whole, less = variant_hashes(line)
            n = len(less)
            inside = np.zeros(n, bool)
            for flag in range(6):
                if gaps >> flag & 1:
                    gap, step = flag % 3, _step(n) - 3 * (flag // 3)
                    inside[gap * step : n - (2 - gap) * step] = True
            at = np.flatnonzero(inside).astype(np.int32)
            keys += [np.array([whole]), less[at]]
            ats += [np.array([-1], np.int32), at]
            owners.append(np.full(len(at) + 1, i))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(keys)),
                pa.array(np.concatenate(ats)),
                batch.column("place").take(pa.array(np.concatenate(owners))),
            ],
            ["key", "at", "place"],
        )

    kind = lines.schema["place"].dataType.simpleString()
    return map_texts(lines.select(F.col("line").alias("text"), "place", "gaps"), run, f"key long, at int, place {kind}")


def _near(docs: DataFrame, min_chars: int) -> DataFrame:
    """``place`` of each distinct line that has an earlier line one edit away.

    Lines that lose the same character at the same place to the same rest differ in one character, and
    are all compared with the earliest of them. A line equal to another one less a character is compared
    with that one. So no pairs are formed within a group.
    """
    lines = cut_lineage(_candidates(docs, min_chars), "lines")
    rows = _variants(lines)
    own = Window.partitionBy("key", "at")
    whole = F.max(F.when(F.col("at") < 0, F.col("place"))).over(Window.partitionBy("key"))
    rows = rows.select("place", "at", whole.alias("whole"), F.min("place").over(own).alias("first")).where("at >= 0")
    pairs = rows.select(
        F.explode(
            F.array(
                F.struct("place", F.col("first").alias("witness")),
                F.struct(F.greatest("place", "whole").alias("place"), F.least("place", "whole").alias("witness")),
            )
        ).alias("pair")
    )
    pairs = pairs.select("pair.*").where("witness < place").distinct()
    texts = lines.select("place", "line")
    return (
        pairs.join(texts, "place")
        .join(texts.select(F.col("place").alias("witness"), F.col("line").alias("earlier")), "witness")
        .where(F.levenshtein("line", "earlier", MAX_EDITS) >= 0)
        .select("place")
        .distinct()
    )


def _by_document(places: DataFrame, column: str) -> DataFrame:
    """``__doc`` and the line numbers of the places in it."""
    return places.select(*_parts("__doc")).groupBy("__doc").agg(F.collect_list("pos").alias(column))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS) -> DataFrame:
    """All columns of the documents with ``text`` reduced to its first lines, and a struct ``line_counts``.

    A line (split at newlines, trimmed of spaces) of at least ``min_chars`` characters goes if an earlier
    line, by doc_id and line number, is within ``max_edits`` (0 or 1) insertions, deletions or
    substitutions of a character, whether that line itself stays or not. Equal lines are one class
    and only the first occurrence stays. Shorter lines stay. ``line_counts`` has ``lines`` and ``kept``.

    Null texts stay null with zero lines. Documents without doc_id have no place in the order: they stay
    as they are. Rows that share a doc_id are one document; a line number that stays in one stays in all. Texts and lines are
    taken whole, a text longer than a megabyte on its own.
    An empty table gives an empty result.
    """
    if max_edits not in (0, 1):
        raise ValueError("the edit bound is 0 or 1")
    stay = _by_document(_classes(docs, min_chars), "__kept")
    if max_edits:
        stay = stay.join(_by_document(_near(docs, min_chars), "__near"), "__doc", "left").select(
            "__doc", F.when(F.col("__near").isNull(), F.col("__kept")).otherwise(F.array_except("__kept", "__near")).alias("__kept")
        )
    joined = docs.join(stay, docs["doc_id"].cast("long") == stay["__doc"], "left").drop("__doc")
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        rows = zip(
            batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("__kept").to_pylist()
        )
        for doc_id, text, stay in rows:
            if text is None:
                texts.append(None)
                counts.append({"lines": 0, "kept": 0})
                continue
            lines, stay = text.split("\n"), set(stay or ())
            left = [x for i, x in enumerate(lines) if i in stay or doc_id is None or len(x.strip(" ")) < min_chars]
            texts.append("\n".join(left))
            counts.append({"lines": len(lines), "kept": len(left)})
        columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
        kind = pa.struct([("lines", pa.int64()), ("kept", pa.int64())])
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, kind)], [*names, "line_counts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "line_counts")
    if "line_counts" in names:
        names = [c for c in names if c != "line_counts"]
    return map_texts(joined, run, f"{schema}, line_counts struct<lines:bigint,kept:bigint>")


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_kept, text`` of every document after line dedup; every case as ``dedup_lines`` states it."""
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("long"), F.col("line_counts.lines").alias("n_lines"), F.col("line_counts.kept").alias("n_kept"), "text"
    )
