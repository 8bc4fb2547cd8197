"""Near duplicates by SimHash fingerprints, found by anchor points that cover the fingerprint space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from winnow.llm.batches import map_batches, map_texts
from winnow.llm.components import components
from winnow.sources.scratch import cut_lineage

BITS = 64
SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: An anchor's expected rows; the code gets finer as the table grows.
ANCHOR_ROWS = 1024
#: Rows of an anchor that are compared in one task; more are cut into blocks.
BLOCK_ROWS = 8192

#: Bit 8j + k of a byte value moved to byte k of a word, so that 255 values add up without a carry.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _hashes(text: str, width: int) -> list[int]:
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A to Z, and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - width or None].tolist(), ends[width - 1 :].tolist())]


def fingerprint_values(texts: list[str | None], width: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each text as an unsigned number; a text without words has 0.

    A bit is 1 if more than half of the shingle hashes set it. Shingles count as often as they occur.
    """
    each = [_hashes(t or "", width) for t in texts]
    counts = np.array([len(h) for h in each], np.int64)
    result = np.zeros(len(texts), np.uint64)
    if not counts.sum():
        return result
    # Runs of at most 255 shingles of one text, whose bits are added eight to a word.
    runs = -(-counts // 255)
    owner = np.repeat(np.arange(len(texts)), runs)
    first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    starts = begin[owner] + 255 * (np.arange(len(owner)) - first[owner])
    flat = np.fromiter((h for row in each for h in row), np.uint64, int(counts.sum())).view(np.uint8).reshape(-1, 8)
    full = np.flatnonzero(counts)
    bits = []
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[flat[:, byte]], starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits.append(np.add.reduceat(sums, first[full], axis=0))
    ones = 2 * np.concatenate(bits, axis=1) > counts[full, None]
    result[full] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return result


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_key, fp`` of every document: a hash of its text, and the bits of the fingerprint (long).

    Null texts count as empty, but have a hash of their own.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprint_values(batch.column("text").to_pylist(), width).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp)], ["doc_id", "text_key", "fp"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return map_texts(chosen, run, "doc_id long, text_key long, fp long")


#: Block lengths from coarse to fine; each has two or more blocks than the one before.
LADDER = [
    [7] * 7 + [5] * 3, [7] * 2 + [5] * 10, [5] * 11 + [3] * 3, [5] * 8 + [3] * 8, [5] * 5 + [3] * 13, [5] * 2 + [3] * 18,
    *([3] * n + [1] * (64 - 3 * n) for n in range(21, 9, -1)),
]


def anchor_rows(rows: int, sizes: list[int], max_bits: int = MAX_BITS) -> float:
    """Fingerprints that an anchor is expected to get, copies to several anchors included."""
    probe = np.random.default_rng(0).integers(0, 1 << 63, 64, np.uint64, endpoint=False) * np.uint64(2)
    return rows * len(replicas(probe, sizes, max_bits)[0]) / len(probe) / 2 ** len(sizes)


def block_sizes(rows: int, max_bits: int = MAX_BITS) -> list[int]:
    """Odd block lengths that add up to 64: coarse for few fingerprints, finer for more.

    The anchors are all words that are constant on every block, a covering code: a point's nearest
    anchor is its majority bit on every block, at most half of the bits away. A single bit is a block too, so the
    code gets finer until an anchor has few rows, whatever the table.
    """
    return next((sizes for sizes in LADDER if anchor_rows(rows, sizes, max_bits) <= ANCHOR_ROWS), LADDER[-1])


def replicas(fps: np.ndarray, sizes: list[int], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of each fingerprint: index into ``fps``, and anchor number.

    Two fingerprints within ``max_bits`` have a point between them that is within half of that
    (rounded up) of both. The anchor nearest to that point is within the covering radius plus half the
    threshold of both, and both are copied to every such anchor, so they meet there.
    """
    reach = -(-max_bits // 2)
    home = np.zeros(len(fps), np.int64)
    costs, at = [], 0
    for b, size in enumerate(sizes):
        ones = np.bitwise_count((fps >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64)
        home |= (2 * ones > size).astype(np.int64) << b
        costs.append((np.abs(2 * ones - size) + 1) // 2)  # bits to change until the majority turns
        at += size
    index, anchor, spent, last = np.arange(len(fps)), home, np.zeros(len(fps), np.int64), np.full(len(fps), -1)
    found = [(index, anchor)]
    cost = np.array(costs)
    for _ in range(reach):
        grown = []
        for b in range(len(sizes)):
            ok = (last < b) & (spent + cost[b][index] <= reach)
            if ok.any():
                grown.append((index[ok], anchor[ok] ^ (1 << b), (spent + cost[b][index])[ok], np.full(ok.sum(), b)))
        if not grown:
            break
        index, anchor, spent, last = (np.concatenate(x) for x in zip(*grown))
        found.append((index, anchor))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


#: Fingerprints that are compared with all others of an anchor at once.
STRIP_ROWS = 256


def _fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest labels over the links between ``a`` and ``b``, added to what is known."""
    while True:
        low = np.minimum(label[a], label[b])
        open_ = (label[a] != low) | (label[b] != low)
        if not open_.any():
            return label
        a, b, low = a[open_], b[open_], low[open_]
        for ends in (a, b):
            np.minimum.at(label, label[ends], low)
            np.minimum.at(label, ends, low)
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def local_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that is not the first of its local component, and that first one.

    The links of a strip go into the labels at once, so no more than those of one strip are held.
    """
    label = np.arange(len(fps))
    for start in range(0, len(fps), STRIP_ROWS):
        part = fps[start : start + STRIP_ROWS]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ fps[None, start:]) <= max_bits)
        keep = i < j
        label = _fold(label, i[keep] + start, j[keep] + start)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a, b`` that join all fingerprints of ``fp`` (long, distinct) within ``max_bits`` of each other.

    Within an anchor only a spanning forest is given, so a large group of near copies adds few rows.
    """
    spark = fps.sparkSession
    sizes = block_sizes(fps.count(), max_bits)

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column("fp").to_numpy().view(np.uint64)
        index, anchor = replicas(values, sizes, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(values[index].view(np.int64))], ["anchor", "fp"])

    spark_rows = map_batches(fps.select("fp"), spread, "anchor long, fp long")
    # Anchors with very many rows are cut into blocks, and every pair of blocks is a task of its own.
    large = (
        spark_rows.groupBy("anchor").count().where(F.col("count") > BLOCK_ROWS)
        .select("anchor", F.ceil(F.col("count") * 2 / BLOCK_ROWS).cast("int").alias("n"))
    )
    block = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pairs = (
        spark_rows.join(large, "anchor", "left")
        .select("anchor", "fp", F.coalesce("n", F.lit(1)).alias("n"))
        .select("anchor", "fp", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        .select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            a, b = local_links(np.unique(group).view(np.uint64), max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(parts, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fingerprints of each run of equal ``anchor, i, j``; runs may span batches."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in ("anchor", "i", "j")], axis=1)
        fp = batch.column("fp").to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
            now = tuple(keys[start].tolist())
            if now != key and held:
                yield np.concatenate(held)
                held = []
            key = now
            held.append(fp[start:stop])
    if held:
        yield np.concatenate(held)


def simhash_groups(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept, text_key, group`` of every document.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked; a component is named by
    its smallest doc_id and that document is kept. Texts without words have fingerprint zero and are
    linked like any other. Equal fingerprints are one node, so copies are never paired. Rows that
    share a doc_id each get a row, told apart by ``text_key``, a hash of the text, and may name two components alike, told apart
    by ``group``, the bits of a fingerprint of each; rows without a doc_id take part and are
    kept. Null texts count as empty. Texts are read whole, one longer than a megabyte on its own. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = cut_lineage(fingerprints(docs, width), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(fingerprint_links(nodes.select("fp"), max_bits))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.select("fp", "root").join(lowest, "root").select("fp", "component_id", F.col("root").alias("group"))
    return rows.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        "text_key",
        "group",
    )
