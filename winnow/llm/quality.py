"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.batches import SPACED, Words, map_texts, utf8

#: Expected number of labelled documents to learn from (a bounded sample).
TRAINING_DOCS = 4000
THRESHOLD = 0.3
ROUNDS = 150
RIDGE = 1e-4

_CLASSES = {
    "lower": [*range(97, 123), *range(128, 256)],
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (9, 11, 12, 13, 32),
    "sentence": map(ord, ".,;:?'\"-()"),
    "pipe": map(ord, "|\t"),
    "shout": map(ord, "!"),
}
_CLASS = np.full(256, len(_CLASSES), np.int64)  # everything else: symbols
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _i
_N_CLASSES = len(_CLASSES) + 1
#: Features of a line: shares of character classes, size, words, repeats, first and last character, equal neighbour.
N_OWN = _N_CLASSES + 8


class Lines(NamedTuple):
    features: np.ndarray  # one row per line: its own features, those of the line before and of the line after
    weight: np.ndarray  # bytes of each line, at least one
    first: np.ndarray  # first line of each text
    counts: np.ndarray  # lines of each text; an empty text has one empty line


def line_features(column: pa.Array) -> Lines:
    """Features of the lines of each text, all from bytes of the text."""
    data, offsets = utf8(column)
    newline = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, newline, side="right") - 1
    n_texts = len(offsets) - 1
    counts = 1 + np.bincount(owner, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    total = int(counts.sum())
    starts, ends = np.zeros(total, np.int64), np.zeros(total, np.int64)
    starts[first] = offsets[:-1]
    ends[first + counts - 1] = offsets[1:]
    is_first = np.zeros(total, bool)
    is_first[first] = True
    starts[~is_first] = newline + 1
    is_last = np.zeros(total, bool)
    is_last[first + counts - 1] = True
    ends[~is_last] = newline
    size = ends - starts

    own = np.zeros((total, N_OWN))
    sums = np.zeros(len(data) + 1, np.int64)
    kind = _CLASS[data]
    for k in range(_N_CLASSES):
        np.cumsum(kind == k, out=sums[1:])
        own[:, k] = (sums[ends] - sums[starts]) / np.maximum(size, 1)
    words = Words(data, np.append(starts, len(data)), SPACED)  # each line with its newline is a row
    n_words = words.counts
    hashes = words.hashes()
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        same[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1]))
    repeats = np.where(n_words > 1, same[np.minimum(words.first + n_words, len(hashes))] - same[np.minimum(words.first + 1, len(hashes))], 0)
    k = _N_CLASSES
    own[:, k] = np.log1p(size) / 8
    own[:, k + 1] = np.log1p(n_words) / 6
    own[:, k + 2] = repeats / np.maximum(n_words - 1, 1)
    own[:, k + 3] = np.minimum(size / np.maximum(n_words, 1), 30) / 10
    full = size > 0
    if len(data):
        begin, last = kind[np.minimum(starts, len(data) - 1)], kind[np.maximum(ends - 1, 0)]
        own[:, k + 4] = full & (begin == 1)
        own[:, k + 5] = full & (last == 4)
    joined = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes, out=joined[1:])
    whole = joined[words.first + n_words] - joined[words.first]
    equal = np.zeros(total, bool)
    equal[1:] = (whole[1:] == whole[:-1]) & full[1:] & (size[1:] == size[:-1]) & ~is_first[1:]
    own[:, k + 6] = equal
    own[:, k + 7] = ~full
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][~is_first[1:]] = own[:-1][~is_first[1:]]
    after[:-1][~is_last[:-1]] = own[1:][~is_last[:-1]]
    features = np.concatenate((own, before, after, is_first[:, None], is_last[:, None], np.ones((total, 1))), axis=1)
    return Lines(features, np.maximum(size, 1).astype(np.float64), first, counts)


def _steps(first: np.ndarray, counts: np.ndarray):
    """Line numbers at each place, over the texts that are that long; the texts longest first."""
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    for t in range(int(lengths[0]) if len(lengths) else 0):
        yield first[order[: np.searchsorted(-lengths, -t, side="left")]] + t


def forward_backward(emit: np.ndarray, change: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of the good label for each line, and the expected number of each pair of neighbouring labels.

    ``emit`` is the score of the good label at each line (the bad label has 0), ``change`` the score of
    each pair of labels.
    """
    n = len(emit)
    score = np.stack((np.zeros(n), emit), axis=1)
    alpha, beta = score.copy(), np.zeros((n, 2))
    steps = list(_steps(first, counts))
    for at in steps[1:]:
        before = alpha[at - 1]
        alpha[at] += np.logaddexp(before[:, :1] + change[0], before[:, 1:] + change[1])
    for at in reversed(steps[1:]):
        after = score[at] + beta[at]
        beta[at - 1] = np.logaddexp(change[:, 0] + after[:, :1], change[:, 1] + after[:, 1:])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    pairs = np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    if len(at):
        joint = alpha[at - 1][:, :, None] + change[None] + (score[at] + beta[at])[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return good, pairs


class Scorer(NamedTuple):
    weights: np.ndarray
    change: np.ndarray
    slope: float
    offset: float


def _document_means(good: np.ndarray, lines: Lines) -> np.ndarray:
    """Mean of the marginals of each text's lines, weighted by their length."""
    return np.add.reduceat(good * lines.weight, lines.first) / np.add.reduceat(lines.weight, lines.first)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(lines: Lines, labels: np.ndarray, held: np.ndarray) -> Scorer:
    """Fit the field to texts whose lines all carry the label of the text; calibrate on ``held`` texts."""
    n_texts, dim = len(labels), lines.features.shape[1]
    weights, change = np.zeros(dim), np.zeros((2, 2))
    rate = float(np.clip(labels.mean(), 0.01, 0.99)) if n_texts else 0.5
    if n_texts == 0 or labels.min() == labels.max():
        return Scorer(weights, change, 0.0, float(np.log(rate / (1 - rate))))
    fit = ~held if (~held).any() and len(np.unique(labels[~held])) == 2 else np.ones(n_texts, bool)
    member = np.repeat(fit, lines.counts)
    x = lines.features[member]
    counts = lines.counts[fit]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    y = np.repeat(labels[fit], counts).astype(np.float64)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (counts[labels[fit] == label] - 1).sum()
    step, n = [np.zeros(dim + 4), np.zeros(dim + 4)], len(y)
    for i in range(1, ROUNDS + 1):  # Adam
        good, pairs = forward_backward(x @ weights, change, first, counts)
        gradient = np.concatenate((x.T @ (y - good), (seen - pairs).ravel())) / n
        gradient -= RIDGE * np.concatenate((weights, change.ravel()))
        step[0] = 0.9 * step[0] + 0.1 * gradient
        step[1] = 0.99 * step[1] + 0.01 * gradient**2
        move = 0.2 * (step[0] / (1 - 0.9**i)) / (np.sqrt(step[1] / (1 - 0.99**i)) + 1e-8)
        weights, change = weights + move[:dim], change + move[dim:].reshape(2, 2)
    good, _ = forward_backward(lines.features @ weights, change, lines.first, lines.counts)
    mean = _logit(_document_means(good, lines))
    use = held if held.any() and len(np.unique(labels[held])) == 2 else np.ones(n_texts, bool)
    return Scorer(weights, change, *_calibrate(mean[use], labels[use].astype(np.float64)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((y - p) * x).sum() - 0.01 * (a - 1), (y - p).sum() - 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        move = np.linalg.solve(h, g)
        a, b = a + float(np.clip(move[0], -1, 1)), b + float(np.clip(move[1], -1, 1))
    return max(a, 0.0), b


def _remainder(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS) -> Scorer:
    """Fit on a sample of labelled documents, about ``training_docs`` of them whatever the size of the table."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(_remainder("doc_id") != 0)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    )
    rate = min(1.0, training_docs / max(known.count(), 1))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = known.where(draw < int(rate * (1 << 20)) + 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = line_features(batch.column("text"))
        rows = [
            lines.features[f : f + n, :].astype(np.float32).tobytes() for f, n in zip(lines.first.tolist(), lines.counts.tolist())
        ]
        weights = [lines.weight[f : f + n].tobytes() for f, n in zip(lines.first.tolist(), lines.counts.tolist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary()), pa.array(weights, pa.binary())],
            ["doc_id", "label", "features", "weights"],
        )

    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    got = map_texts(
        chosen.select("doc_id", "label", "text"), run, "doc_id long, label int, features binary, weights binary"
    ).toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    blobs, sizes = got["features"].to_pylist(), got["weights"].to_pylist()
    weight = [np.frombuffer(sizes[i]) for i in order]
    counts = np.array([len(w) for w in weight], np.int64)
    dim = 3 * N_OWN + 3
    features = np.concatenate([np.frombuffer(blobs[i], np.float32).reshape(-1, dim) for i in order] or [np.zeros((0, dim))])
    first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    lines = Lines(features.astype(np.float64), np.concatenate(weight or [np.zeros(0)]), first, counts)
    return train(lines, got["label"].to_numpy()[order], np.arange(len(counts)) % 4 == 0)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, score, good_lines, n_lines``: quality of each text, and its lines more likely good than bad."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = line_features(batch.column("text"))
        good, _ = forward_backward(lines.features @ scorer.weights, scorer.change, lines.first, lines.counts)
        mean = _logit(_document_means(good, lines))
        value = 1 / (1 + np.exp(-np.clip(scorer.slope * mean + scorer.offset, -500, 500)))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(value),
                pa.array(np.add.reduceat((good > 0.5).astype(np.int64), lines.first)),
                pa.array(lines.counts.astype(np.int64)),
            ],
            ["doc_id", "score", "good_lines", "n_lines"],
        )

    return map_texts(
        docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, good_lines long, n_lines long"
    )


def quality_report(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted, good_lines, n_lines`` of every document.

    A conditional random field labels every line good or bad from its own features, those of its
    neighbours and the labels beside it; the marginals of the good label, weighted by the length of the
    lines, make the score, calibrated to a probability. It learns from a bounded sample of labels whose
    crc32(doc_id as text) mod 5 is not 0; the others are ``held_out``. Documents without doc_id are not.

    Null and empty texts count as one empty line and are scored as such. Texts are scored whole, one longer than a
    megabyte on its own. Without labels, or with one
    kind only, the score is their share of good documents, or a half. Repeated rows each get a row; an
    empty table gives an empty result; other columns are ignored.
    """
    found = score(docs, learn(docs, labels, training_docs))
    held = F.coalesce(_remainder("doc_id") == 0, F.lit(False))
    return found.select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "good_lines",
        "n_lines",
    )
