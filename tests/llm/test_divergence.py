"""Source divergence against a plain count over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from winnow.llm import divergence

from .tables import documents, empty, rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(docs, top=200):
    """The contract, on a list of ``lang, source, text``."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    found = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= 3]

        def shares(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        each = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum((each[s][t] - each[o][t]) ** 2 // each[o][t] for t in kept), o.encode()) for o in sources - {s}]
            term = [
                (-((each[s][t] - whole[t]) ** 2 // whole[t]), t.encode())
                for t in kept if counts[lang, s][t] and each[s][t] > whole[t]
            ]
            for part, values in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                found += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(values)]
    return sorted(found)


def sample():
    rng = random.Random(11)
    stems = ["a", "Éa", "straße", "the", "theatre", "theatres", "internationalisation", "internationalisations", "日本語", "x" * 40, "x" * 41]
    words = stems + ["".join(rng.choices("abcde", k=rng.randrange(1, 20))) for _ in range(300)]
    made = []
    for i in range(500):
        lang, source = rng.choice(["en", "en", "de", None, "", "fr"]), rng.choice(["hot"] * 8 + ["b", "Ö", "z", None, ""])
        text = rng.choice([" ", "1", "-"]).join(rng.choices(words, k=rng.randrange(0, 40)))
        made.append((i, text, lang, source))
    made += [(None, None, "no terms", s) for s in ("a", "b", None)] + [(3, "once only", "no terms", "c")]
    made += [(4, "alone " * 3, "one", "s")] * 3  # repeated rows are documents
    made += [(5, ("long " * 400_000) + "y" * 100_000, "en", "long"), (6, "long", "en", "b"), (7, "LONG", "en", "b")]
    return made


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_TERMS": 7, "TILE_SOURCES": 2, "CELLS": 30, "HELD_ROWS": 50, "FIRST_LEVEL": 1}])
def test_source_divergence(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    made = sample()
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(5)
    found = sorted(map(tuple, divergence.source_divergence(docs).collect()))
    assert found == plainly([(lang, source, text) for _, text, lang, source in made])
    assert ("no terms", "", "pair", "a", 0, 1) in found


def test_cases(spark):
    found = sorted(map(tuple, divergence.source_divergence(documents(spark)).collect()))
    assert found == plainly([(r[2], r[3], r[1]) for r in rows()])
    assert divergence.source_divergence(empty(spark)).count() == 0


def test_top_terms(spark):
    made = sample()
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    found = sorted(map(tuple, divergence.source_divergence(docs, top_terms=3).collect()))
    assert found == plainly([(lang, source, text) for _, text, lang, source in made], 3)


def test_refinement_drops_rare_prefixes_and_no_kept_term(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FIRST_LEVEL", 2)
    texts = ["abcdefgh abcdxyzw"] * 3 + [f"abcdefg{c} qq{c}{c}{c}{c}" for c in "ijklmnop"]
    docs = spark.createDataFrame([("en", "s", t) for t in texts], "lang string, source string, text string")
    levels, real = [], divergence._prefixes

    def counted(docs, level, before, min_docs):
        kept = real(docs, level, before, min_docs)
        levels.append((level, kept.count()))
        return kept

    monkeypatch.setattr(divergence, "_prefixes", counted)
    keys = {r.key for r in divergence.kept_keys(docs).collect()}
    # ab, qq; abcd; abcdefgh, abcdxyzw: complete at eight bytes, so nothing goes on
    assert levels == [(2, 2), (4, 1), (8, 2)] and len(keys) == 2


def test_shares_are_exact_beyond_double_precision(spark):
    frame = spark.createDataFrame([(10**13 + 1, 10**15 + 3, 10**8 + 7)], "n long, total long, v long")
    found = frame.select(divergence._share(F.col("n"), F.col("total"), F.col("v")).alias("p")).first().p
    assert found == 1 + 10**9 * (10**13 + 2) // (10**15 + 3 + 10**8 + 7)
