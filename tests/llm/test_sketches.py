"""Document fingerprints against plain edits of strings and plain sets of paragraph digests."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from winnow.llm import queries, sketches

from .tables import documents, empty, rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def joined(texts):
    held = [t.encode() for t in texts]
    return np.frombuffer(b"".join(held), np.uint8), np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int64)


def passages(text):
    """The paragraphs of one text as strings."""
    data, offsets = joined([text])
    return [data[a:b].tobytes() for a, b in zip(*sketches.paragraphs(data, offsets))]


def alike(a, b):
    """Shared paragraphs out of all of both, with repeats."""
    a, b = Counter(passages(a)), Counter(passages(b))
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0, sum((b - a).values()), sum((a - b).values())


def plainly(docs):
    """The contract, for documents in their order."""
    found = []
    texts = [t or "" for _, t in docs]
    for (doc_id, _), text, after in zip(docs, texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        near, added, removed = alike(text, edit)
        found.append((doc_id, len(text), sha(edit), near, alike(text, after)[0], added, removed))
    return found


def sample():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgß😀É", k=rng.randrange(1, 9))) for _ in range(400)]
    made = [(i * 7 - 500, " ".join(rng.choices(words, k=rng.randrange(1, 120)))) for i in range(300)]
    made += [(5000 + i, "\n".join(" ".join(rng.choices(words, k=9)) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    made += [(6000, None), (6001, ""), (6002, ""), (6003, "x"), (6004, "xy"), (6005, "same\n" * 500), (6006, "same\n" * 480)]
    made += [(7000, "word and another " * 60_000), (7001, " " * 1000), (None, "without id")]
    return made


def test_report(spark):
    made = sample()
    random.Random(1).shuffle(made)
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(7)
    found = sketches.version_report(docs).collect()
    in_order = sorted(made, key=lambda r: (r[0] is None, -(r[0] or 0)))
    own = {r.doc_id: (r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_added, r.n_removed) for r in found}
    assert len(found) == len(made)
    for wanted in plainly(in_order):
        assert own[wanted[0]] == pytest.approx(wanted, abs=1e-12), wanted[0]


def test_equal_texts_have_equal_fingerprints(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "a b c e"), (4, None), (5, "")], "doc_id long, text string")
    found = {r.doc_id: r.fingerprint for r in sketches.fingerprints(docs).collect()}
    assert found[1] == found[2] != found[3] and found[4] == found[5] and set(found[4]) == {"0"}
    again = {r.doc_id: r.fingerprint for r in sketches.version_report(docs).collect()}
    assert again == found


def test_cases(spark):
    found = sketches.version_report(documents(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in rows())
    # equal rows lie side by side; which documents come in between is told by doc_id
    assert {r.near_next for r in found if r.doc_id == 10} >= {1.0}
    assert sketches.version_report(empty(spark)).count() == 0


def test_one_document_comes_after_itself(spark):
    one = sketches.version_report(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, sha("abcabc"))]


def test_repeated_rows_over_many_ranges(spark):
    made = [(9, "copy of a text")] * 400 + [(8, "other"), (10, "before")]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(6)
    found = Counter((r.doc_id, r.edited_sha256, r.near_next) for r in sketches.version_report(docs).collect())
    assert found[9, sha("copy of" + "copy of"), 1.0] == 399
    assert sorted(found.values()) == [1, 1, 1, 399]


def test_paragraphs_are_the_whole_text():
    for _, text in sample():
        assert b"".join(passages(text or "")) == (text or "").encode()


@pytest.mark.parametrize("size", [0, 1, 3, 8, 40, 300, 20_000])
def test_peeling_recovers_what_differs(size):
    rng = np.random.default_rng(size)
    shared = rng.integers(0, 2**64, 5000, np.uint64, endpoint=False)
    first, second = (rng.integers(0, 2**64, size, np.uint64) for _ in range(2))

    def digests(*parts):
        keys = np.concatenate(parts)
        return sketches.Digests(np.concatenate((keys, shared[:7])), np.concatenate((np.zeros(len(keys), int), np.full(7, 1))), 2)

    found = sketches.differences(digests(shared, first), digests(second, shared))
    assert sorted(found.keys[found.sign > 0].tolist()) == sorted(first.tolist())
    assert sorted(found.keys[found.sign < 0].tolist()) == sorted(second.tolist())
    assert not found.row.any()


def test_small_sketches_are_retried(monkeypatch):
    widths, real = [], sketches.Sketches.of
    monkeypatch.setattr(sketches.Sketches, "of", classmethod(lambda cls, found, width: widths.append(width) or real(found, width)))
    one = sketches.digests(*joined(["a\nb\nc\n", "\n".join(map(str, range(200)))]))
    other = sketches.digests(*joined(["a\nb\nd\n", "\n".join(map(str, range(100, 300)))]))
    found = sketches.differences(one, other)
    assert np.bincount(found.row).tolist() == [2, 200 + np.bincount(found.row)[1] - 200]
    assert widths[0] == sketches.WIDTH and widths[-1] >= 64  # the first needs no more cells, the second some 200 x 1.3
    assert sketches.likeness(one, other, found)[0] > 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries.queries()["op13_document_fingerprints"](spark, folder).collect()}
    for wanted in plainly(sorted(map(tuple, docs), reverse=True)):
        r = found.pop(wanted[0])
        assert (r.n_chars, r.edited_sha256, r.n_added, r.n_removed) == (wanted[1], wanted[2], *wanted[5:])
        assert (r.near_edited, r.near_next) == pytest.approx(wanted[3:5], abs=1e-12)
    assert not found
