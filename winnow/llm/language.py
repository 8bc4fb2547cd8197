"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.batches import map_texts, mix

ORDER = 4
#: Expected number of documents per language to learn from (a bounded sample of labelled rows).
DOCS_PER_LANGUAGE = 1500
SYMBOLS = 1 << 16
SPACE, EDGE = 32, 1
UNKNOWN = "und"
#: Share of the calibration texts of a language and length band that are accepted.
ACCEPTED = 0.995
#: Symbols from which each band of lengths begins, and texts that a band needs for a limit of its own.
BANDS = np.array([1, 32, 64, 128, 256, 512, 1024])
BAND_TEXTS = 20
_MEMO_BITS = 17

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter as a symbol, or a space."""
    if not _LETTERS:
        found = np.full(0x110000, SPACE, np.uint64)
        for c in range(0x110000):
            if chr(c).isalpha():
                found[c] = max(ord(chr(c).lower()[0]) % SYMBOLS, SPACE + 1)
        _LETTERS.append(found)
    return _LETTERS[0]


class Grams(NamedTuple):
    keys: np.ndarray  # 16 bits for each of four symbols, the newest lowest
    first: np.ndarray  # index of the first key of each text
    counts: np.ndarray  # keys of each text
    letters: np.ndarray  # letters of each text


def grams(texts: list[str | None]) -> Grams:
    """The character 4-grams of each text: letters in lower case, every other run a space, an edge before."""
    texts = [t or "" for t in texts]
    gap = ORDER - 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = ("\0" * gap).join(["", *texts]).encode("utf-32-le", "replace")
    symbol = _letters()[np.frombuffer(joined, np.uint32)]
    first = np.cumsum(sizes + gap) - sizes
    edge = (first[:, None] - 1 - np.arange(gap)).ravel()
    symbol[edge] = EDGE
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != SPACE) | (symbol[:-1] != SPACE)
    place = np.concatenate(([0], np.cumsum(keep)))
    lo, hi = place[first], place[first + sizes]
    is_letter = np.concatenate(([0], np.cumsum(symbol[keep] > SPACE)))
    symbol = symbol[keep]
    keys = symbol.copy()
    for back in range(1, ORDER):
        keys[back:] |= symbol[: len(symbol) - back] << np.uint64(16 * back)
    inside = np.ones(len(keys), bool)
    inside[place[edge]] = False
    before = np.concatenate(([0], np.cumsum(inside)))
    return Grams(keys[inside], before[lo], before[hi] - before[lo], is_letter[hi] - is_letter[lo])


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashed = mix(keys)
    order = np.argsort(hashed)
    return hashed[order], values[order]


def _look(table: tuple[np.ndarray, np.ndarray], hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is in a sorted hash array, and its value."""
    held, values = table
    at = np.minimum(np.searchsorted(held, hashed), len(held) - 1)
    return held[at] == hashed, values[at]


class KneserNey:
    """An interpolated Kneser-Ney model of one language in sorted hash arrays, one pair for each order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        per_order = [(keys, counts.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):  # how many different symbols come before
            shorter, n = np.unique(per_order[0][0] & np.uint64((1 << 16 * order) - 1), return_counts=True)
            per_order.insert(0, (shorter, n.astype(np.float64)))
        self.floor = 0.0
        self.grams, self.contexts = [], []
        for order, (keys, counts) in enumerate(per_order, 1):
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
            context, owner = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(owner, counts)
            rest = discount * np.bincount(owner) / total
            if order == 1:
                self.floor = float(np.log2(rest[0] / SYMBOLS))
            lower = np.exp2(self.log2(keys, order - 1))
            self.grams.append(
                _sorted(keys, np.log2((counts - discount) / total[owner] + rest[owner] * lower))
            )
            self.contexts.append(_sorted(context, np.log2(rest)))

    def log2(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 probability of the newest symbol of each key after those before it."""
        value = np.full(len(keys), self.floor if order else -16.0)
        for k in range(1, order + 1):
            short = keys & np.uint64((1 << 16 * k) - 1)
            if k > 1:
                known, rest = _look(self.contexts[k - 1], mix(short >> np.uint64(16)))
                value = value + np.where(known, rest, 0.0)
            known, own = _look(self.grams[k - 1], mix(short))
            value = np.where(known, own, value)
        return value


class Identifier(NamedTuple):
    languages: list[str]
    models: list[KneserNey]
    sharpness: float  # turns differences of cross-entropy into a probability
    usual: np.ndarray  # cross-entropy of each language's own texts
    slack: np.ndarray  # what a text may lie above that, by language and length band


_MEMO: dict[int, tuple] = {}


def cross_entropy(found: Grams, models: list[KneserNey]) -> np.ndarray:
    """Bits per symbol of each text under each model; keys met before are looked up in a table."""
    memo = _MEMO.get(id(models))
    if memo is None or memo[0] is not models:
        _MEMO.clear()
        memo = (models, np.zeros(1 << _MEMO_BITS, np.uint64), np.zeros((1 << _MEMO_BITS, len(models))))
        _MEMO[id(models)] = memo
    _, held, values = memo
    slot = (mix(found.keys) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
    missing = np.flatnonzero(held[slot] != found.keys)
    bits = values[slot]
    if len(missing):
        new, where = np.unique(found.keys[missing], return_inverse=True)
        logs = np.stack([m.log2(new) for m in models], axis=1)
        bits[missing] = logs[where]
        slot = (mix(new) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        order = np.unique(slot, return_index=True)[1]
        held[slot[order]], values[slot[order]] = new[order], logs[order]
    sums = np.zeros((len(found.counts), len(models)))
    full = np.flatnonzero(found.counts)
    if len(full):
        sums[full] = np.add.reduceat(bits, found.first[full], axis=0)
    return -sums / np.maximum(found.counts, 1)[:, None]


def _remainder(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Identifier:
    """One model per language from a sample of labelled documents, and what a fourth of the sample calibrates.

    The sample holds ``docs_per_language`` documents of each language in expectation, all if there are
    fewer, chosen by a hash of doc_id; the bound does not depend on the size of the table.
    """
    labelled = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").where(
        _remainder("doc_id") != 1
    )
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Identifier([], [], 1.0, np.zeros(0), np.zeros((0, len(BANDS))))
    rate = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1 << 20, int(docs_per_language / sizes[l] * (1 << 20)) + 1))])
    sample = labelled.withColumn("draw", F.xxhash64("doc_id")).where(
        F.pmod("draw", F.lit(1 << 20)) < rate[F.col("lang")]
    )
    number = F.create_map(*[F.lit(x) for i, l in enumerate(languages) for x in (l, i)])[F.col("lang")]
    fourth = F.pmod(F.shiftright("draw", 20), F.lit(4)) == 0
    sample = sample.select("text", number.cast("long").alias("lang"), fourth.alias("held"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = grams(batch.column("text").to_pylist())
        owner = np.repeat(batch.column("lang").to_numpy(), found.counts)
        langs, keys, counts = [], [], []
        for lang in np.unique(owner).tolist():
            own, n = np.unique(found.keys[owner == lang], return_counts=True)
            langs.append(np.full(len(own), lang))
            keys.append(own.view(np.int64))
            counts.append(n)
        parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (langs, keys, counts)]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in parts], ["lang", "key", "n"])

    def table(rows: DataFrame) -> pa.Table:
        counted = map_texts(rows.select("text", "lang"), count, "lang long, key long, n long")
        return counted.groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()

    counts = table(sample.where("NOT held"))
    if not counts.num_rows or len(np.unique(counts["lang"].to_numpy())) < len(languages):
        counts = table(sample)  # too few rows to set a fourth of them aside
    lang, key, n = (counts[c].to_numpy() for c in ("lang", "key", "n"))
    order = np.argsort(key.view(np.uint64))
    lang, key, n = lang[order], key[order].view(np.uint64), n[order]
    models = [KneserNey(key[lang == i], n[lang == i]) if (lang == i).any() else None for i in range(len(languages))]
    languages = [l for l, m in zip(languages, models) if m]
    ids = {i: k for k, i in enumerate(i for i, m in enumerate(models) if m)}
    models = [m for m in models if m]
    if not models:
        return Identifier([], [], 1.0, np.zeros(0), np.zeros((0, len(BANDS))))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = grams(batch.column("text").to_pylist())
        bits = cross_entropy(found, models)
        return pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(found.counts), pa.array(found.letters), pa.array(list(bits))],
            ["lang", "n", "letters", "bits"],
        )

    seen = map_texts(sample.where("held").select("text", "lang"), measure, "lang long, n long, letters long, bits array<double>")
    rows = seen.where("letters > 0").toArrow()
    if not rows.num_rows:
        rows = map_texts(sample.select("text", "lang"), measure, seen.schema).where("letters > 0").toArrow()
    if not rows.num_rows:
        return Identifier(languages, models, 1.0, np.full(len(models), 16.0), np.full((len(models), len(BANDS)), 16.0))
    truth = np.array([ids.get(i, -1) for i in rows["lang"].to_pylist()])
    n, bits = rows["n"].to_numpy()[truth >= 0], np.array(rows["bits"].to_pylist())[truth >= 0]
    truth = truth[truth >= 0]
    return Identifier(languages, models, *_calibrate(truth, n, bits))


def _calibrate(truth: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sharpness by likelihood; usual cross-entropy and the most that texts of a language lie above it."""
    grid = 2.0 ** np.arange(-4, 7, 0.5)
    own = bits[np.arange(len(truth)), truth]
    loss = [np.mean(np.log(np.exp(-(bits - own[:, None]) * s).sum(axis=1))) + 1e-3 * s / 64 for s in grid]
    usual = np.array([np.median(own[truth == i]) if (truth == i).any() else np.median(own) for i in range(bits.shape[1])])
    above = own - usual[truth]
    return float(grid[int(np.argmin(loss))]), usual, _limits(truth, _band(n), above, len(usual))


def _band(n: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(BANDS, n, side="right") - 1, 0)


def _limits(truth: np.ndarray, band: np.ndarray, above: np.ndarray, languages: int) -> np.ndarray:
    """The quantile ACCEPTED of what texts lie above the usual, by language and length band.

    A band with few texts of a language takes those of all languages. One with few texts at all takes the
    limit of the next longer band, wider as means of fewer symbols spread, or of the next shorter one.
    """
    top = lambda x: max(float(np.quantile(x, ACCEPTED)), 0.0)
    limits = np.full((languages, len(BANDS)), np.nan)
    for i in range(languages):
        for k in range(len(BANDS)):
            every = band == k
            own = every & (truth == i)
            if own.sum() >= BAND_TEXTS:
                limits[i, k] = top(above[own])
            elif every.sum() >= BAND_TEXTS:
                limits[i, k] = top(above[every])
    empty = np.isnan(limits).all(axis=0)
    if empty.all():  # too few texts for any band
        limits[:, int(np.median(band))] = top(above)
        empty[int(np.median(band))] = False
    full = np.flatnonzero(~empty)
    for k in np.flatnonzero(empty).tolist():
        longer = full[full > k]
        source = int(longer[0]) if len(longer) else int(full[-1])
        limits[:, k] = limits[:, source] * np.sqrt(max(BANDS[source] / BANDS[k], 1.0))
    return limits


def identify(docs: DataFrame, model: Identifier, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns ``keep`` with ``lang_pred, score, bits, accepted`` of each text, named after ``prefix``.

    The language with the lowest cross-entropy per symbol, the first in order of name among equals;
    ``und`` with score 0 for texts without a letter. ``accepted`` is false for those and for texts whose
    cross-entropy lies further above the usual of the language than 99.5 % of the calibration texts of
    the language and length band did.
    """
    added = [f"{prefix}{c}" for c in ("lang_pred", "score", "bits", "accepted")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = grams(batch.column("text").to_pylist())
        n = batch.num_rows
        if model.models:
            bits = cross_entropy(found, model.models)
            best = bits.argmin(axis=1)
            low = bits[np.arange(n), best]
            chance = 1 / np.exp(-(bits - low[:, None]) * model.sharpness).sum(axis=1)
            fits = low - model.usual[best] <= model.slack[best, _band(found.counts)]
            have = found.letters > 0
        else:
            best = low = chance = np.zeros(n)
            fits = have = np.zeros(n, bool)
        predicted = [model.languages[int(i)] if h else UNKNOWN for i, h in zip(best, have)]
        return pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in keep],
                pa.array(predicted, pa.string()),
                pa.array(np.where(have, chance, 0.0)),
                pa.array(np.where(have, low, 0.0)),
                pa.array(have & fits),
            ],
            [*keep, *added],
        )

    picked = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "text"])])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name in keep)
    kinds = zip(added, ("string", "double", "double", "boolean"))
    return map_texts(picked, run, schema + "".join(f", `{c}` {kind}" for c, kind in kinds))


def language_report(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits, accepted`` of every document.

    Models learn from documents whose crc32(doc_id as text) mod 3 is not 1 (``held_out`` marks the
    others) and that have a language; documents without doc_id are never learned from and not held
    out. Null and empty texts, and those without a letter, are ``und``. Texts are read whole, one longer than a megabyte on its
    own. Repeated rows each get a row. Without labelled documents every prediction is ``und``; an empty
    table gives an empty result; other columns are ignored.
    """
    model = learn(docs, docs_per_language)
    ids = docs.select(F.col("doc_id").cast("long"), "text")
    held = F.coalesce(_remainder("doc_id") == 1, F.lit(False))
    found = identify(ids, model, ["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits", "accepted")
