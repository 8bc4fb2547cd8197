"""Small tables with the cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, kept boolean, line_counts string, fp int, ids int"
PROSE = "the river runs past old stone houses and under a bridge where children wait for slow boats to pass by".split()


def rows() -> list[tuple]:
    rng = random.Random(7)
    texts = [None, "", " ", "\n\n", "a", "ÀÉ ö", "😀 \x01 ▁", "x" * 50_000, ("word " * 20_000).strip()]
    texts += [" ".join(rng.choices(PROSE, k=60)) for _ in range(20)]
    texts += texts[9:13]  # copies
    made = [(i, t, rng.choice(["en", "de", None]), "s", len(t or ""), 0.5, 1, False, "x", 1, 1) for i, t in enumerate(texts)]
    made += [made[10], made[10]]  # repeated rows
    made += [(None, texts[11], "en", *[None] * 8), (None,) * 11]
    return made


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
