"""How far each source of a language departs from the others, over terms found by iceberg prefix refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from winnow.llm.batches import LETTERS, Words, mix, pieces, powers, utf8
from winnow.operators.skew import top_per_key
from winnow.sources.scratch import cut_lineage

#: Documents of a language that a term needs.
MIN_DOCS = 3
#: Bytes of the prefixes of the first level; each further level doubles them.
FIRST_LEVEL = 8
#: Shares are whole numbers out of this.
SCALE = 1_000_000_000
#: Terms reported for each source.
TOP_TERMS = 200
#: Terms that are compared at once, and sources that are compared with all others at once.
BLOCK_TERMS = 4096
TILE_SOURCES = 256
#: Cells of terms by sources that a task holds at once.
CELLS = 1 << 20
#: Bit maps have 16 bits or more for each kept prefix, up to 32 MB. They only save work.
LEAST_BITS, MOST_BITS = 16, 28
#: Rows of counts that a task merges before it hands them on, and bytes of terms that it keeps for them.
HELD_ROWS, HELD_BYTES = 1 << 20, 64 << 20
#: Bits of a row in a piece, which may hold half as many texts with a term as it has bytes. Keys have the other bits.
ROW_BITS = 20
#: Below this, SCALE times a count fits into a long.
SMALL = 9_000_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Terms(Words):
    """The terms of a piece of texts, with keys of their prefixes in their language."""

    def __init__(self, column: pa.Array, langs: pa.Array):
        super().__init__(*utf8(column), LETTERS)
        self.lengths = self.ends - self.starts
        n = len(self.data)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self._sums[1:])
        self._shift = powers(_INVERSE, n + 1)[self.starts]
        encoded = langs.dictionary_encode()
        salts = np.array([_salt(x) for x in encoded.dictionary.to_pylist()], np.uint64)
        self._lang = salts[encoded.indices.to_numpy(zero_copy_only=False)][self.row] if len(langs) else self._shift

    def keys(self, level: int | None = None, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
        """A key of the first ``level`` bytes of the chosen terms and their language; the lowest bit says that the term goes on."""
        starts, ends = self.starts[chosen], self.ends[chosen]
        stops = ends if level is None else np.minimum(ends, starts + level)
        own = (self._sums[stops] - self._sums[starts]) * self._shift[chosen]
        mixed = mix((own + (stops - starts).astype(np.uint64)) ^ self._lang[chosen]) >> np.uint64(ROW_BITS)
        return (mixed & np.uint64(0xFFFFFFFFFFFFFFFE)) | (stops < ends).astype(np.uint64)


def _salt(lang: str) -> int:
    """A number for a language, the same on every machine."""
    value = 0xCBF29CE484222325
    for b in lang.encode("utf-8", "surrogatepass"):
        value = (value ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


class BitMap:
    """Which keys may be among some set: never misses one, and lets a few others pass."""

    def __init__(self, keys: DataFrame):
        wanted = 16 * keys.count()
        self.bits = max(LEAST_BITS, min(wanted.bit_length(), MOST_BITS))
        slot = F.shiftrightunsigned("key", 64 - ROW_BITS - self.bits)
        packed = (
            keys.select(slot.alias("slot"))
            .groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
            .toArrow()
        )
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[packed["word"].to_numpy()] = packed["bits"].to_numpy().view(np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slots = keys >> np.uint64(64 - ROW_BITS - self.bits)
        return (self.words[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _summed(keys: np.ndarray, *sums: np.ndarray) -> list[np.ndarray]:
    """The distinct keys in order, and the sums of each."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = _runs(keys)
    return [keys[starts], *(np.add.reduceat(x[order], starts) for x in sums)]


def _in_documents(keys: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The distinct keys in order, in how many rows each occurs, and how often."""
    pairs = np.sort(keys << np.uint64(ROW_BITS) | rows.astype(np.uint64))
    starts = _runs(pairs)
    times = np.diff(np.append(starts, len(pairs)))
    return [pairs[starts], times]


def _prefixes(docs: DataFrame, level: int, before: BitMap | None, min_docs: int) -> DataFrame:
    """``key`` of each prefix of a level that enough documents hold, and whose shorter prefix they hold too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in (p for batch in batches for p in pieces(batch, CELLS)):
            terms = Terms(piece.column("text"), piece.column("lang"))
            chosen = slice(None)
            if before is not None:
                chosen = np.flatnonzero(terms.lengths > level // 2)
                chosen = chosen[before.holds(terms.keys(level // 2, chosen))]
            pairs, _ = _in_documents(terms.keys(level, chosen), terms.row[chosen])
            if not len(pairs):
                continue
            keys = pairs >> np.uint64(ROW_BITS)
            starts = _runs(keys)
            held.append([keys[starts], np.diff(np.append(starts, len(keys)))])
            size += len(starts)
            if size > HELD_ROWS:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > HELD_ROWS // 2:
                    yield _keyed(held[0])
                    held, size = [], 0
        if held:
            yield _keyed(_summed(*map(np.concatenate, zip(*held))))

    found = docs.select("lang", "text").mapInArrow(run, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("key")


def _keyed(held: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], ["key", "n"])


def kept_keys(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``key`` of every complete term that enough documents of its language hold, with a few others by chance.

    A term is in no more documents than any of its prefixes. So prefixes of a few bytes are counted first, and
    a term is looked at again, with twice the bytes, only if its prefix was kept; until every kept term is complete.
    """
    complete, before, level = None, None, FIRST_LEVEL
    while True:
        kept = cut_lineage(_prefixes(docs, level, before, min_docs), "prefixes")
        goes_on = F.col("key").bitwiseAND(1) == 1
        own = kept.where(~goes_on)
        complete = own if complete is None else complete.unionByName(own)
        kept = kept.where(goes_on)
        if kept.isEmpty():
            return complete
        before, level = BitMap(kept), 2 * level


def _document_columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _merged(held: list[tuple]) -> tuple:
    """Counts by group and term of several pieces as one, over one dictionary of their terms."""
    low = np.uint64(0xFFFFFFFF)
    codes = [pa.DictionaryArray.from_arrays(pa.array((key & low).astype(np.int32)), words) for key, _, _, words in held]
    unified = pa.chunked_array(codes).unify_dictionaries()
    keys = [key & ~low | c.indices.to_numpy().astype(np.uint64) for (key, *_), c in zip(held, unified.chunks)]
    n, docs = (np.concatenate([h[i] for h in held]) for i in (1, 2))
    return *_summed(np.concatenate(keys), n, docs), unified.chunk(0).dictionary


def _counted(key: np.ndarray, n: np.ndarray, docs: np.ndarray, words: pa.Array, groups: list) -> Iterator[pa.RecordBatch]:
    langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
    for i in range(0, len(key), 1 << 16):
        some = slice(i, i + (1 << 16))
        group, code = pa.array((key[some] >> np.uint64(32)).astype(np.int64)), pa.array((key[some] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        term = words.take(code).cast(pa.binary()).view(pa.string())
        yield pa.RecordBatch.from_arrays(
            [langs.take(group), sources.take(group), term, pa.array(n[some]), pa.array(docs[some])],
            ["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, first`` of each kept term of a language and each source that has it.

    ``n`` counts its occurrences in the source, ``lang_n`` in the language; one row of each term is ``first``.
    """
    docs = _document_columns(docs)
    known = BitMap(kept_keys(docs, min_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, groups, size = [], {}, 0
        for piece in (p for batch in batches for p in pieces(batch, CELLS)):
            terms = Terms(piece.column("text"), piece.column("lang"))
            chosen = np.flatnonzero(known.holds(terms.keys()))
            if not len(chosen):
                continue
            encoded = terms.strings(chosen).dictionary_encode()
            own = zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist())
            of_row = np.array([groups.setdefault(g, len(groups)) for g in own])
            # once for each document and term, then once for each group and term
            pairs, times = _in_documents(encoded.indices.to_numpy().astype(np.uint64), terms.row[chosen])
            code, row = pairs >> np.uint64(ROW_BITS), pairs & np.uint64((1 << ROW_BITS) - 1)
            group = of_row[row.astype(np.int64)].astype(np.uint64)
            key, n, seen = _summed(group << np.uint64(32) | code, times, np.ones(len(times), np.int64))
            held.append((key, n, seen, encoded.dictionary))
            size += len(key)
            if size > HELD_ROWS or sum(h[3].nbytes for h in held) > HELD_BYTES:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD_ROWS // 2 or held[0][3].nbytes > HELD_BYTES // 2:
                    yield from _counted(*held[0], list(groups))
                    held, size = [], 0
        if held:
            yield from _counted(*_merged(held), list(groups))

    rows = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # dealt by term, so that sums by source, sums by term and both windows need no further shuffle
    each = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return (
        each.withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
        .withColumn("lang_n", F.sum("n").over(of_term))
        .withColumn("lang_docs", F.sum("docs").over(of_term))
        .where(F.col("lang_docs") >= min_docs)
        .select("lang", "source", "term", "n", "lang_n", "first")
    )


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exactly; a language without terms has no shares."""
    small = F.call_function("div", F.lit(SCALE).cast("long") * (n + 1), F.nullif(total + terms, F.lit(0)))
    wide = [c.cast("decimal(28,0)") for c in (n, total, terms)]
    large = F.call_function("div", F.lit(SCALE) * (wide[0] + 1), wide[1] + wide[2])
    return F.lit(1).cast("long") + F.when(n < SMALL, small).otherwise(large)


def _departure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def departures(sources: pa.Table, rows: pa.Table) -> pa.Table:
    """``lang, source, item, value``: sums over the terms of a block, of each source of a tile against each other one.

    ``sources`` holds each source's share of a term that it lacks, and the tile it belongs to; ``rows`` the shares of
    the terms that it has.
    """
    order = pc.sort_indices(sources["source"])
    sources = sources.take(order)
    names = sources["source"].combine_chunks()
    absent = sources["absent"].fill_null(1).to_numpy()
    own = np.flatnonzero(sources["own_tile"].to_numpy() == sources["tile"].to_numpy())
    total = np.zeros((len(own), len(names)), np.int64)
    if rows.num_rows:
        encoded = rows["term"].combine_chunks().dictionary_encode()
        column = pc.index_in(rows["source"].combine_chunks(), names).to_numpy(zero_copy_only=False)
        term, share = encoded.indices.to_numpy(), rows["p"].to_numpy()
        by_term = np.argsort(term, kind="stable")
        term, column, share = term[by_term], column[by_term], share[by_term]
        step = max(1, CELLS // len(names))
        for begin in range(0, len(encoded.dictionary), step):
            some = slice(*np.searchsorted(term, (begin, begin + step)))
            size = min(step, len(encoded.dictionary) - begin)
            shares = np.repeat(absent[:, None], size, axis=1)
            shares[column[some], term[some] - begin] = share[some]
            for i, g in enumerate(own):
                apart = shares[g] - shares
                total[i] += (apart * apart // shares).sum(axis=1)
    g, h = (x.ravel() for x in np.meshgrid(own, np.arange(len(names)), indexing="ij"))
    other = g != h
    lang = pa.array([sources["lang"][0].as_py()] * int(other.sum()), pa.string()) if len(names) else pa.array([], pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(g[other])), "item": names.take(pa.array(h[other])), "value": total.ravel()[other]})


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every source of every language.

    Terms are runs of letters and of characters beyond ASCII, A to Z in lower case. A language keeps the terms that at
    least ``min_docs`` of its documents hold. Source and language give each kept term the share
    p = 1 + floor(10**9 (n + 1) / (N + V)), n its occurrences there, N all of kept terms, V the number of kept terms.
    Part ``pair`` has each other source of the language and the sum over all kept terms of floor((p - q)**2 / q), q that
    source's share; part ``term`` the ``top_terms`` terms whose share in the source is above that in the language, with the
    same measure against the language. Ranks go by value from the top, ties by item in byte order. Sums are exact.

    Null lang, source and text count as empty; every row is a document, repeated rows and those without doc_id too. A
    source without any term, and a language without kept terms, have their pairs all the same (value 0 if V is 0).
    Whole texts are read, a text longer than a megabyte on its own; other columns are ignored; an empty table gives an
    empty result. A language's sources are compared with each other, so the result grows with their square by its nature;
    memory does not: terms are compared in blocks, sources in tiles.
    """
    counts = cut_lineage(term_counts(docs, min_docs), "terms")
    here = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum(F.col("first").cast("long")).alias("v"))
    groups = _document_columns(docs).select("lang", "source").distinct()
    zero = F.lit(0).cast("long")
    in_lang = Window.partitionBy("lang")
    groups = cut_lineage(
        groups.join(here, ["lang", "source"], "left")
        .join(whole, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n_source", "n_lang", "v")])
        .withColumn("own_tile", ((F.row_number().over(in_lang.orderBy("source")) - 1) / TILE_SOURCES).cast("int"))
        .withColumn("tiles", F.max("own_tile").over(in_lang) + 1)
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS).cast("int"))),
        "groups",
    )
    shares = (
        counts.join(groups, ["lang", "source"])
        .withColumn("p", _share(F.col("n"), F.col("n_source"), F.col("v")))
        .withColumn("q", _share(F.col("lang_n"), F.col("n_lang"), F.col("v")))
    )
    return _pairs(shares, groups).unionByName(_terms(shares, top_terms))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    blocks = (
        groups.select("*", tile)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("lang", "block", "tile", "own_tile", "source", _share(F.lit(0), F.col("n_source"), F.col("v")).alias("absent"))
    )
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    rows = shares.select("lang", block, tile, "source", "term", "p")
    sums = (
        blocks.groupBy("lang", "block", "tile")
        .cogroup(rows.groupBy("lang", "block", "tile"))
        .applyInArrow(departures, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))


def _terms(shares: DataFrame, top_terms: int) -> DataFrame:
    rows = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _departure(F.col("p"), F.col("q")).alias("value"))
    best = top_per_key(rows, ["lang", "source"], [F.desc("value"), F.col("item")], top_terms)
    return best.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int"))
