"""Benchmark decontamination by winnowed word n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from winnow.llm.batches import ALNUM, Words, map_texts, mix, powers, utf8

WINDOW_WORDS = 10
GRAM_WORDS = 8
_C = 0xD6E8FEB86659FD93
#: Bits of the filter of benchmark fingerprints; its size does not depend on the benchmark.
FILTER_BITS = 22
_HIT = "struct<gram:string,at:int,before:array<string>,after:array<string>>"


def grams(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether they all lie in one row."""
    n = len(hashes)
    value = np.zeros(n, np.uint64)
    whole = np.zeros(n, bool)
    if n >= width:
        scale = powers(_C, width)
        for j in range(width):
            value[: n - width + 1] += hashes[j : n - width + 1 + j] * scale[j]
        whole[: n - width + 1] = row[width - 1 :] == row[: n - width + 1]
    return mix(value), whole


def winnow(value: np.ndarray, row: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Which n-grams are kept: the last smallest of each run that covers ``window`` words of a row."""
    kept = np.zeros(len(value), bool)
    n = len(value) - window + 1
    if n <= 0:
        return kept
    best, at = value[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - gram + 1):
        lower = value[j : n + j] <= best
        best = np.where(lower, value[j : n + j], best)
        at[lower] = j
    kept[(np.arange(n) + at)[row[window - 1 :] == row[:n]]] = True
    return kept


def _hits(words: Words, kept: np.ndarray, gram: int, window: int) -> dict[int, list]:
    """For each row, the kept n-grams with up to ``window - gram`` words on either side."""
    reach, rows = window - gram, {}
    for i in np.flatnonzero(kept).tolist():
        r = int(words.row[i])
        lo, hi = int(words.first[r]), int(words.first[r] + words.counts[r])
        rows.setdefault(r, []).append(
            {
                "gram": words.text(i, i + gram),
                "at": i - lo,
                "before": [words.text(k, k + 1) for k in range(i - 1, max(lo, i - reach) - 1, -1)],
                "after": [words.text(k, k + 1) for k in range(i + gram, min(hi, i + gram + reach))],
            }
        )
    return rows


_ARROW_HIT = pa.list_(
    pa.struct(
        [("gram", pa.string()), ("at", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]
    )
)


def _item_grams(items: DataFrame, window: int, gram: int) -> DataFrame:
    """``item_id, n, hit`` for each fingerprint of each item; an item of fewer than ``window`` words is one n-gram."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(*utf8(batch.column("text")), ALNUM)
        value, _ = grams(words.hashes(), words.row, gram)
        rows = _hits(words, winnow(value, words.row, window, gram), gram, window)
        for r, n in enumerate(words.counts.tolist()):
            if 0 < n < window:
                start = int(words.first[r])
                rows[r] = [{"gram": words.text(start, start + n), "at": 0, "before": [], "after": []}]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("item_id"),
                pa.array(words.counts, pa.int32()),
                pa.array([rows.get(r, []) for r in range(batch.num_rows)], _ARROW_HIT),
            ],
            ["item_id", "n", "hits"],
        )

    found = map_texts(
        items.select(F.col("item_id").cast("string"), "text"), run, f"item_id string, n int, hits array<{_HIT}>"
    )
    return found.select("item_id", "n", F.explode("hits").alias("hit")).where("item_id IS NOT NULL").distinct()


def _filter(items: DataFrame, window: int, gram: int) -> dict[int, np.ndarray]:
    """For each n-gram length in use, a bit map of the n-grams of the benchmark. At most 2**16 rows a length."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(*utf8(batch.column("text")), ALNUM)
        hashes = words.hashes()
        value, _ = grams(hashes, words.row, gram)
        kept = winnow(value, words.row, window, gram)
        lengths, found = [np.full(kept.sum(), gram)], [value[kept]]
        for n in np.unique(words.counts[(words.counts > 0) & (words.counts < window)]).tolist():
            first = words.first[words.counts == n]
            lengths.append(np.full(len(first), -n))
            found.append(grams(hashes, words.row, n)[0][first])
        slot = np.concatenate(found) >> np.uint64(64 - FILTER_BITS)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(lengths)), pa.array(slot.astype(np.int64))], ["length", "slot"]
        )

    slots = map_texts(items.where("item_id IS NOT NULL").select("text"), run, "length long, slot long")
    packed = (
        slots.groupBy("length", F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
        .collect()
    )
    maps = {}
    for row in packed:
        maps.setdefault(row["length"], np.zeros(1 << (FILTER_BITS - 6), np.uint64))[row["word"]] = row["bits"] % (1 << 64)
    return maps


def _document_grams(docs: DataFrame, maps: dict[int, np.ndarray], window: int, gram: int) -> DataFrame:
    """``doc_id, key, n_words, hits``: per document the kept n-grams that the benchmark may hold."""

    def known(value: np.ndarray, bits: np.ndarray) -> np.ndarray:
        slot = value >> np.uint64(64 - FILTER_BITS)
        return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(*utf8(batch.column("text")), ALNUM)
        hashes = words.hashes()
        rows: dict[int, list] = {}
        for length, bits in maps.items():
            value, whole = grams(hashes, words.row, abs(length))
            if length > 0:
                found = _hits(words, winnow(value, words.row, window, gram) & known(value, bits), gram, window)
            else:
                found = _hits(words, whole & known(value, bits), -length, -length)
            for r, hits in found.items():
                rows.setdefault(r, []).extend(hits)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("key"),
                pa.array(words.counts, pa.int64()),
                pa.array([rows.get(r, []) for r in range(batch.num_rows)], _ARROW_HIT),
            ],
            ["doc_id", "key", "n_words", "hits"],
        )

    return map_texts(
        docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text"),
        run,
        f"doc_id long, key long, n_words long, hits array<{_HIT}>",
    )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, keyed: bool = False
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items`` of every document.

    Words are runs of digits, letters a to z (A to Z in lower case) and characters beyond ASCII. A
    document word is hit if it lies in an occurrence of ``window`` consecutive words of an item, or of
    a whole item that has fewer. Of every ``window`` words, documents and items both keep the n-gram of
    ``gram`` words with the smallest hash, so any shared window shares a kept n-gram at the same place.
    Kept n-grams are joined as texts and extended word by word on both sides.

    Null and empty texts have no words; items without words or without an item_id are never found. Rows
    that share a doc_id each get a row; with ``keyed`` a hash of the text, ``text_key``, tells them apart. A document without
    doc_id has a row like any other. Texts are read whole, one longer than a megabyte on its own. Empty tables give an empty
    result, or documents without hits. Other columns are ignored.
    """
    reach = window - gram
    items = items.select("item_id", "text")
    held = _document_grams(docs, _filter(items, window, gram), window, gram)
    # One row for the document itself and one for each n-gram; documents without any spread by their key.
    rows = held.select(
        "doc_id",
        "key",
        "n_words",
        F.explode(F.concat(F.array(F.lit(None).cast(_HIT)), "hits")).alias("hit"),
    ).select("doc_id", "key", "n_words", F.col("hit.*"))
    rows = rows.withColumn("lookup", F.coalesce("gram", F.concat(F.lit("\n"), F.col("key").cast("string"))))
    found = _item_grams(items, window, gram).select(
        "item_id",
        F.col("n").alias("item_words"),
        F.col("hit.gram").alias("lookup"),
        F.col("hit.before").alias("item_before"),
        F.col("hit.after").alias("item_after"),
    )
    joined = rows.join(found, "lookup", "left")
    left, right = _agree("before", "item_before", reach), _agree("after", "item_after", reach)
    short = F.col("item_words") < window
    spans = (
        joined.withColumn("l", F.when(short, 0).otherwise(left))
        .withColumn("r", F.when(short, 0).otherwise(right))
        .withColumn("full", F.coalesce(short | (F.col("l") + F.col("r") >= reach), F.lit(False)))
        .select(
            "doc_id",
            "key",
            "n_words",
            F.when(F.col("gram").isNull(), 1).otherwise(0).alias("row"),
            F.when(F.col("full"), F.col("item_id")).alias("item_id"),
            F.when(F.col("full"), F.col("at") - F.col("l")).alias("start"),
            F.when(F.col("full"), F.col("at") + F.when(short, F.col("item_words")).otherwise(gram + F.col("r"))).alias(
                "stop"
            ),
        )
        .where("row = 1 OR item_id IS NOT NULL")
        .groupBy("doc_id", "key", "n_words", "start", "stop", "item_id")
        .agg(F.sum("row").alias("row"))
    )
    order = Window.partitionBy("doc_id", "key").orderBy(F.asc_nulls_first("start"), "stop", "item_id")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0))))
    return (
        spans.withColumn("new", F.coalesce(new, F.lit(0)))
        .groupBy("doc_id", "key", "n_words")
        .agg(
            F.sum("new").cast("long").alias("n_hit"),
            F.array_sort(F.collect_set("item_id")).alias("items"),
            F.sum("row").alias("copies"),
        )
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            "items",
            *([F.col("key").alias("text_key")] if keyed else []),
            F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
        )
        .drop("copy")
    )


def _agree(ours: str, theirs: str, reach: int):
    """How many words from the n-gram on are the same."""
    same, total = F.lit(True), F.lit(0)
    for i in range(reach):
        same = same & F.coalesce(F.get(ours, F.lit(i)) == F.get(theirs, F.lit(i)), F.lit(False))
        total = total + F.when(same, 1).otherwise(0)
    return total
