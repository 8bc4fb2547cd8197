"""Secrets in texts: fixed patterns, and values beside credential words that would take many guesses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from winnow.llm.batches import LETTERS, PIECE_BYTES, Words, map_texts, pieces, utf8

#: log10 of the guesses from which a value beside a credential word counts as a secret.
MIN_GUESSES = 10.0
MIN_VALUE = 8
#: Characters that a repeat or a walk looks back at most; longer ones are cut into several.
LOOK_BACK = 256
LONGEST_UNIT = 32
#: More guesses than that (log10) are counted as that many, so a value is only read until it is so dear.
MOST_GUESSES = 40.0
#: The most frequent words of the corpus that every task holds, with their ranks; of so many letters.
CORPUS_WORDS = 100_000
WORD_LETTERS = (3, 24)
#: Words that a task counts before it hands them on.
HELD_WORDS = 500_000

# Fixed values of the contract: patterns of the base spans.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

#: Words that announce a credential, then a value up to a space or quote.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|access[_-]?key|private[_-]?key|auth)"""
    r"""["'\]]?\s{0,3}(?::=|=>|[:=]|\b(?P<is>is)\b)\s{0,3}["']?(?P<value>[^\s"'<>`,;]{8,})""",
    re.I | re.A,
)
_CUES = ("pass", "pwd", "secret", "token", "key", "credential", "auth")

#: Common words of passwords, the most common first.
COMMON = (
    "password 123456 qwerty admin welcome letmein login master hello dragon monkey football baseball sunshine princess "
    "shadow superman batman trustno1 iloveyou freedom whatever starwars cheese computer internet summer winter spring "
    "autumn secret test guest root user changeme default example sample temp dummy system server database service "
    "access account public private token value string true false null none undefined your here pass word key api "
    "house love money blue green black white red orange purple tiger lion eagle horse correct battery staple "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august "
    "september october november december the and for with from that this have what when where"
).split()
_RANK = {w: i + 1 for i, w in enumerate(COMMON)}
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_LEET = str.maketrans("@4310$5!7", "aaeiosslt")
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0\d|1[0-2])\1(?:[0-2]\d|3[01]))?|(?:[0-2]\d|3[01])([-/._]?)(?:0\d|1[0-2])\2(?:19|20)?\d\d")


def _neighbours() -> dict[str, set[str]]:
    """Keys that lie beside each other: in a row, and in the row below at the same or the next place."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(_ROWS):
        for c, key in enumerate(row):
            below = _ROWS[r + 1] if r + 1 < len(_ROWS) else ""
            # the digit row starts one key further left than the letters below it
            places = [(row, c + 1)] + [(below, c - k - (r == 0)) for k in (0, 1)]
            for other, at in places:
                if 0 <= at < len(other):
                    near.setdefault(key, set()).add(other[at])
                    near.setdefault(other[at], set()).add(key)
    for a, b in zip(_ALPHABET, _ALPHABET[1:]):
        near[a].add(b)
        near[b].add(a)
    return near


_NEAR = _neighbours()
_KEYS = math.log10(len(_NEAR))
_TURN = math.log10(sum(map(len, _NEAR.values())) / len(_NEAR))


def _case_cost(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or word[0].isupper() and upper == 1:
        return math.log10(2)
    return math.log10(sum(math.comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1)) or 2)


def guess_cost(value: str, words: dict[str, int] | None = None, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of a value takes, ``MOST_GUESSES`` at most.

    Dynamic programming over the places of the value; a segment is a word (its rank among common words, in
    ``words`` or in ``ranks``, capitals and digits for letters extra), a date, a repeat (what its unit costs alone and how often), a
    walk over neighbouring keys (first key and turns), or a brute-force character (ten guesses). A value of known words
    and separators alone, such as a path, costs as much as its rarest word. No segment is longer than ``LOOK_BACK``; so once
    all places of that many characters are too dear, the rest is not read.
    """
    return _cost(value, words, ranks, {})


def _cost(value: str, words: dict[str, int] | None, ranks: dict[str, int] | None, units: dict[str, float]) -> float:
    n = len(value)
    lower = value.lower()
    if len(lower) != n:  # a letter whose lower case is longer
        lower = "".join(c.lower()[0] for c in value)
    plain = lower.translate(_LEET)
    known = _known_words(lower, words, ranks)
    best = [0.0] + [math.inf] * n
    runs = [0] * (LONGEST_UNIT + 1)  # for each unit length, how many characters up to here equal those so far before
    for start in range(n + 1):
        if start:
            best[start] = min(best[start], best[start - 1] + 1.0)
            last = lower[start - 1]
            for size in range(1, min(start - 1, LONGEST_UNIT) + 1):
                if last != lower[start - 1 - size]:
                    runs[size] = 0
                    continue
                runs[size] += 1
                for times in range(2, min(runs[size], LOOK_BACK - size) // size + 2):
                    first = start - times * size
                    unit = lower[first : first + size]
                    alone = units.get(unit)
                    if alone is None:
                        alone = units[unit] = 1.0 if size == 1 else min(float(size), _cost(unit, words, ranks, units))
                    best[start] = min(best[start], best[first] + alone + math.log10(times))
            if start % 64 == 0 and start >= LOOK_BACK and min(best[start - LOOK_BACK : start + 1]) >= MOST_GUESSES:
                best[n] = MOST_GUESSES
                break
        for end in range(start + 3, min(n, start + 24) + 1):
            rank, extra = _rank(lower[start:end], words, ranks), 0.0
            if rank is None and plain[start:end] != lower[start:end]:
                rank = _rank(plain[start:end], words, ranks)
                extra = math.log10(2) * sum(a != b for a, b in zip(plain[start:end], lower[start:end]))
            if rank is not None:
                best[end] = min(best[end], best[start] + math.log10(rank + 1) + extra + _case_cost(value[start:end]))
        found = _DATE.match(value, start)
        if found:
            marked = any(found.groups())
            cost = math.log10(365 * 50 * (4 if marked else 1) if found.end() - start > 4 else 100)
            best[found.end()] = min(best[found.end()], best[start] + cost)
        end = start + 1
        turns, direction = 0, None
        while end < min(n, start + LOOK_BACK) and lower[end] in _NEAR.get(lower[end - 1], ()):
            step = (ord(lower[end]) - ord(lower[end - 1]))
            turns += step != direction
            direction = step
            end += 1
            if end - start >= 3:
                best[end] = min(best[end], best[start] + _KEYS + turns * _TURN + math.log10(end - start))
    return min(best[n], known, MOST_GUESSES)


_SEPARATED = re.compile(r"[^\W\d_]+")


def _known_words(lower: str, words: dict[str, int] | None, ranks: dict[str, int] | None) -> float:
    """What the rarest word costs, if a value is nothing but known words and separators."""
    if re.search(r"[^\W_]", _SEPARATED.sub("", lower)):  # digits
        return math.inf
    found = [_rank(w, words, ranks) for w in _SEPARATED.findall(lower) if len(w) >= WORD_LETTERS[0]]
    short = sum(len(w) < WORD_LETTERS[0] for w in _SEPARATED.findall(lower))
    if not found or None in found or short > len(found):
        return math.inf
    return math.log10(max(found) + 1) + short


def _rank(word: str, words: dict[str, int] | None, ranks: dict[str, int] | None) -> int | None:
    found = [r for r in (_RANK.get(word), words and words.get(word), ranks and ranks.get(word)) if r]
    return min(found) if found else None


def _outside(text: str) -> str:
    """A text without the values beside credential words, so that no secret makes itself a word."""
    parts, at = [], 0
    for m in CONTEXT.finditer(text):
        parts.append(text[at : m.start("value")])
        at = m.end("value")
    return " ".join([*parts, text[at:]]) if parts else text


def _own_words(text: str) -> dict[str, int]:
    """Rank of each word of letters that a text repeats outside the values beside credential words, the most frequent first."""
    counts = Counter(re.findall(r"[^\W\d_]{3,24}", _outside(text).lower()))
    return {w: i + 1 for i, (w, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))) if c > 1}


def corpus_words(docs: DataFrame, most: int = CORPUS_WORDS) -> dict[str, int]:
    """The ``most`` words that the most documents hold outside values beside credential words, two at least, and their ranks.

    Documents are counted over the whole table; the words are as many as the parameter says, whatever its size.
    """
    low, high = WORD_LETTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def handed() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).view(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for piece in (p for batch in batches for p in pieces(batch, PIECE_BYTES)):
            column = piece.column("text")
            if any(cue in (t or "").lower() for t in column.to_pylist() for cue in _CUES):
                column = pa.array([_outside(t or "") for t in column.to_pylist()], pa.string())
            words = Words(*utf8(column), LETTERS)
            size = words.ends - words.starts
            chosen = np.flatnonzero((size >= low) & (size <= high))
            encoded = words.strings(chosen).dictionary_encode()
            pairs = np.unique(encoded.indices.to_numpy().astype(np.int64) * piece.num_rows + words.row[chosen])
            held = np.bincount(pairs // piece.num_rows, minlength=len(encoded.dictionary))
            counts.update(dict(zip(encoded.dictionary.to_pylist(), held.tolist())))
            if len(counts) > HELD_WORDS:
                yield handed()
                counts.clear()
        if counts:
            yield handed()

    found = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = found.where("n >= 2").orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()["word"].to_pylist()
    return {word: i + 1 for i, word in enumerate(best)}


def scan(
    text: str, min_guesses: float = MIN_GUESSES, ranks: dict[str, int] | None = None
) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Base spans and added spans (start, kind, end), and the highest guess cost of a value."""
    base, added, most = [], [], 0.0
    low = text.lower()
    cue = any(c in low for c in _CUES)
    if cue:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if cue:
        words = None
        for m in CONTEXT.finditer(text):
            value = m["value"].rstrip(".)]}!?:")
            if len(value) < MIN_VALUE or m["is"] and _prose(text, m, value):
                continue
            if words is None:
                words = _own_words(text)
            cost = guess_cost(value, words, ranks)
            most = max(most, cost)
            start, end = m.start("value"), m.start("value") + len(value)
            if cost >= min_guesses and not any(s <= start and end <= e for s, _, e in base):
                added.append((start, 3, end))
    return sorted(base), added, most


_GOES_ON = re.compile(r"[.,;:!?)]*\s+[a-z]|[.,;:!?)]+(?:\s|$)")


def _prose(text: str, m: re.Match, value: str) -> bool:
    """Whether a value after "is" is a word of a sentence: lower-case letters without quotes, and the sentence goes on or ends."""
    quoted = text[m.start("value") - 1] in "\"'"
    return not quoted and value.isalpha() and value.islower() and bool(_GOES_ON.match(text, m.start("value") + len(value)))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame, min_guesses: float = MIN_GUESSES, words: int = CORPUS_WORDS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_guess, guesses, base, spans`` of every document.

    ``base`` and ``spans`` are ``kind:start:end`` by start, then kind, joined by commas, in code points and
    end exclusive. Base spans match fixed patterns, leftmost and non-overlapping per kind; a whole
    ``name = value`` match is an assign span. A guess span is a value after a credential word that
    lies in no base span and takes at least 10 ** ``min_guesses`` guesses; it goes to the value's end, past that
    of a base span too. Cheap are words that many documents of the table hold (the ``words`` most frequent ones, by a count
    over all), and words that the text repeats, both outside such values; so are paths of them. A lower-case word
    after "is" in a sentence that goes on is no value. ``guesses`` is the highest log10 of the guesses of any such value, 0
    without one and 40 at most.

    Null texts count as empty. A document without doc_id has a row like any other. Texts are read whole, one longer than a
    megabyte on its own; a value is priced in time linear in its length. Repeated rows each get a row; an empty table gives an
    empty result; other columns are ignored.
    """
    ranks = corpus_words(docs, words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, base, spans, most = [[], [], [], []], [], [], []
        for text in batch.column("text").to_pylist():
            found, added, cost = scan(text or "", min_guesses, ranks)
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in found) + sum(x[1] == k for x in added))
            base.append(_joined(found))
            spans.append(_joined(found + added))
            most.append(cost)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(most), pa.array(base), pa.array(spans)],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "guesses", "base", "spans"],
        )

    return map_texts(
        docs.select(F.col("doc_id").cast("long"), "text"),
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, guesses double, base string, spans string",
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """The findings with ``base_sha256``, the digest of the base spans."""
    found = find_secrets(docs)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_guess", "guesses"
    )
