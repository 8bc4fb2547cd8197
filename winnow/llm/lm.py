"""Corpus word counts and a gated recurrent language model with a class-factored softmax."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.batches import SPACED, Words, map_texts, pieces, utf8
from winnow.sources.scratch import cut_lineage

#: Words with an output of their own: so many at least, and all whose share of the N training tokens is 1 / sqrt(N) or more,
#: so outputs grow with the texts, and the work for a token much slower. The others share one output for each kind of ending.
VOCABULARY = 4032
ENDINGS = 64
#: Classes of outputs, or the root of the number of outputs if that is more.
CLASSES = 64
HIDDEN = 16
#: Counts that every task holds; the others are joined.
HEAD_WORDS = 1 << 18
#: Expected number of tokens that the network starts from; after that it learns from all training texts.
TRAINING_TOKENS = 300_000
EPOCHS = 3
LANES = 128
#: Steps after which gradients are cut off; the state goes on.
WINDOW = 16
RATE = 0.02
#: All training texts are dealt over so many rounds, after each of which the weights of the learners are averaged.
ROUNDS = 4
ROUND_RATE = 0.03
ROUND_LANES = 2048
#: Expected tokens that a learner meets in a round: so many, or so many for each weight that it hands back.
LEARNER_TOKENS = 1 << 20
TOKENS_PER_WEIGHT = 2
#: Weights in a row of what a task hands back, and the part of one that their sums are exact to.
BLOCK = 1 << 15
UNIT = 2.0**-32
#: Steps and texts that are scored side by side, and tokens that a task holds for that; the state goes on.
SCORE_WINDOW = 32
SCORE_LANES = 512
SCORE_TOKENS = 1 << 22
PIECE_BYTES = 4 << 20

END = 0x7FFFFFFFFFFFFFC0
_LOG10 = float(np.log(10))

class Tokens(NamedTuple):
    keys: np.ndarray  # of each token, with the kind of ending in the lowest bits
    first: np.ndarray
    counts: np.ndarray  # tokens of each text, the end included


def tokens(column: pa.Array) -> Tokens:
    """Words between ASCII white space with A to Z in lower case, then one end for each text."""
    words = Words(*utf8(column), SPACED)
    keys = words.hashes() & np.uint64(~(ENDINGS - 1) & 0x7FFFFFFFFFFFFFFF)
    if len(words):
        last = words.data[words.ends - 1].astype(np.uint64)
        prior = words.data[np.maximum(words.ends - 2, words.starts)].astype(np.uint64)
        keys |= (last * np.uint64(31) + prior * np.uint64(17)) & np.uint64(ENDINGS - 1)
    counts = words.counts + 1
    first = np.cumsum(counts) - counts
    joined = np.full(int(counts.sum()), END, np.int64)
    is_word = np.ones(len(joined), bool)
    is_word[first + counts - 1] = False
    joined[is_word] = keys.view(np.int64)
    return Tokens(joined, first, counts)


def _remainder(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def count_tokens(docs: DataFrame) -> DataFrame:
    """``key, c`` of every distinct token of all texts."""

    def run(batches):
        held = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held])
            n = np.concatenate([c for _, c in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[starts], np.add.reduceat(n, starts)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.unique(tokens(batch.column("text")).keys, return_counts=True)
            held.append(own)
            size += len(own[0])
            if size > 1 << 20:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "c"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["key", "c"])

    def small(batches):
        yield from run(piece for batch in batches for piece in pieces(batch, PIECE_BYTES))

    return docs.select("text").mapInArrow(small, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


class Counts(NamedTuple):
    total: int
    distinct: int
    keys: np.ndarray  # the most frequent tokens, sorted by key
    counts: np.ndarray
    symbols: np.ndarray  # their outputs in the network, -1 without one
    sizes: np.ndarray  # training tokens of each symbol, falling
    ending_symbols: np.ndarray  # the output of each ending
    symbol_ending: np.ndarray  # the ending of each symbol, -1 of a word
    ending_tokens: np.ndarray  # of the tokens without an output, by ending: how many, and how many distinct
    ending_words: np.ndarray


def head(counts: DataFrame, most: int = HEAD_WORDS) -> Counts:
    """Totals, and the most frequent tokens as far as they are fewer than ``most``: all above some count.

    Symbols are numbered from the most frequent down, so that the symbols of a class lie side by side.
    """
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = sorted(
        counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect(), reverse=True
    )
    total, distinct = sum(r["c"] for r in levels), sum(r["n"] for r in levels)
    lowest, held = None, 0
    for r in levels:
        held += r["n"]
        if held > most:
            break
        lowest = r["level"]
    top = counts.where(level >= lowest).toArrow() if lowest is not None else pa.table({"key": [], "c": []})
    keys, n = top["key"].to_numpy().astype(np.int64), top["c"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    best = np.lexsort((keys, -n))[: max(VOCABULARY - 1, int((n >= np.sqrt(total)).sum()))]
    if len(keys) and END not in keys[best] and END in keys:
        best = np.append(best, np.searchsorted(keys, END))
    per_ending = counts.groupBy(F.col("key").bitwiseAND(ENDINGS - 1).cast("int").alias("e")).agg(
        F.sum("c").alias("c"), F.count("*").alias("n")
    )
    ending_tokens, ending_words = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in per_ending.collect():
        ending_tokens[r["e"]], ending_words[r["e"]] = r["c"], r["n"]
    np.subtract.at(ending_tokens, keys[best] & (ENDINGS - 1), n[best])
    np.subtract.at(ending_words, keys[best] & (ENDINGS - 1), 1)
    sizes = np.concatenate((n[best].astype(np.float64), ending_tokens))
    falling = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int32)
    rank[falling] = np.arange(len(sizes), dtype=np.int32)
    symbols = np.full(len(keys), -1, np.int32)
    symbols[best] = rank[: len(best)]
    symbol_ending = np.full(len(sizes), -1, np.int32)
    symbol_ending[rank[len(best) :]] = np.arange(ENDINGS)
    return Counts(
        int(total), int(distinct), keys, n, symbols, sizes[falling], rank[len(best) :], symbol_ending, ending_tokens, ending_words
    )


def look_up(keys: np.ndarray, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each token is among the held counts, its count, and its symbol in the network."""
    rest = counts.ending_symbols[keys & (ENDINGS - 1)]
    if not len(counts.keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys)), rest
    at = np.minimum(np.searchsorted(counts.keys, keys), len(counts.keys) - 1)
    found = counts.keys[at] == keys
    symbol = np.where(found, counts.symbols[at], -1)
    return found, np.where(found, counts.counts[at], 0), np.where(symbol < 0, rest, symbol)


class Network(NamedTuple):
    """A gated recurrent unit over symbols; a symbol's class is predicted first, then the symbol in its class."""

    inputs: np.ndarray  # 3 x symbols x H: what each symbol adds to the gates z, r and to the new state
    recur: np.ndarray  # 3 x H x H
    to_class: np.ndarray  # H x C
    class_bias: np.ndarray
    to_symbol: np.ndarray  # symbols x H
    symbol_bias: np.ndarray
    bounds: np.ndarray  # the symbols of class c are bounds[c] to bounds[c + 1] - 1
    symbol_class: np.ndarray

    def size(self) -> int:
        return sum(w.size for w in self[:6])


def new_network(sizes: np.ndarray, hidden: int = HIDDEN, classes: int | None = None) -> Network:
    """Classes of about equal frequency over falling ``sizes``; biases give the frequencies, so it begins as a unigram model."""
    classes = classes or max(CLASSES, int(np.sqrt(len(sizes))))
    rng = np.random.default_rng(0)
    share = (sizes + 0.5) / (sizes + 0.5).sum()
    wanted = np.minimum(((np.cumsum(share) - share / 2) * classes).astype(int), classes - 1)
    # No class may be much larger than the others, or its softmax would be slow.
    largest = max(2 * -(-len(sizes) // classes), 1)
    bounds = [0]
    for symbol in range(1, len(sizes)):
        if wanted[symbol] != wanted[symbol - 1] or symbol - bounds[-1] >= largest:
            bounds.append(symbol)
    bounds = np.array([*bounds, len(sizes)])
    symbol_class = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    mass = np.add.reduceat(share, bounds[:-1])
    scale = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
    return Network(
        scale(3, len(sizes), hidden),
        scale(3, hidden, hidden),
        np.zeros((hidden, len(mass)), np.float32),
        np.log(mass).astype(np.float32),
        np.zeros((len(sizes), hidden), np.float32),
        np.log(share / mass[symbol_class]).astype(np.float32),
        bounds,
        symbol_class,
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def step(net: Network, gates: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state from what the inputs add to the gates, and the parts that gradients need."""
    own = np.matmul(state, net.recur)
    zr = _sigmoid(gates[:2] + own[:2])
    new = zr[1] * own[2]
    new += gates[2]
    np.tanh(new, out=new)
    after = state - new
    after *= zr[0]
    after += new
    return after, zr[0], zr[1], new, own[2]


#: Logits stay within this, where their exponentials neither overflow nor all vanish.
_MOST = np.float32(60)


def _exponentials(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logits at the place ``at`` of each row and the sums of all exponentials, which take the place of ``x``."""
    np.maximum(x, -_MOST, out=x)
    np.minimum(x, _MOST, out=x)
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return own, x @ np.ones(x.shape[1], x.dtype)


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log chance of the place ``at`` of each row, and in place of ``x`` the chances of all."""
    own, total = _exponentials(x, at)
    x *= (1 / total)[:, None]
    return own - np.log(total), x


def _log_softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log chance of the place ``at`` of each row; ``x`` is used up."""
    own, total = _exponentials(x, at)
    return own - np.log(total)


#: Rows whose class softmax is worked out at once, so that it stays near the core.
_ROWS = 2048


def log_chance(net: Network, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each target after each state."""
    own_class = net.symbol_class[targets]
    value = np.empty(len(targets))
    for i in range(0, len(targets), _ROWS):
        some = slice(i, i + _ROWS)
        value[some] = _log_softmax(states[some] @ net.to_class + net.class_bias, own_class[some])
    order = np.argsort(targets, kind="stable")
    cuts = np.searchsorted(targets[order], net.bounds)
    sorted_states, place = states[order], targets[order] - net.bounds[own_class[order]]
    within = np.zeros(len(targets))
    for c in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(net.bounds) > 1)).tolist():
        a, b, some = net.bounds[c], net.bounds[c + 1], slice(cuts[c], cuts[c + 1])
        within[some] = _log_softmax(sorted_states[some] @ net.to_symbol[a:b].T + net.symbol_bias[a:b], place[some])
    value[order] += within
    return value


def text_scores(net: Network, symbols: np.ndarray, first: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """Natural log probability of each text's symbols.

    Texts are laid end to end in lanes of about equal length, longest first; the state is carried from window to
    window and starts anew with each text, after the end of the one before.
    """
    total = np.zeros(len(counts))
    if not len(counts):
        return total
    order = np.argsort(-counts, kind="stable")
    # no more lanes than the longest text leaves work for: then what they hold is little more than the texts
    lanes = min(SCORE_LANES, len(counts), -(-int(counts.sum()) // int(counts.max())))
    lane, begin = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    used = [(0, k) for k in range(lanes)]
    for text, n in zip(order.tolist(), counts[order].tolist()):  # each to the shortest lane
        begin[text], lane[text] = used[0]
        heapq.heapreplace(used, (used[0][0] + n, used[0][1]))
    lengths = np.array([n for n, _ in sorted(used, key=lambda x: x[1])])
    ranked = np.argsort(-lengths, kind="stable")
    place = np.empty(lanes, np.int64)
    place[ranked] = np.arange(lanes)
    steps = int(lengths.max())
    size = lengths[ranked]
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    grid = np.zeros((steps, lanes), np.int32)
    owner = np.zeros((steps, lanes), np.int32)
    token_step, token_lane = begin[rows] + at, place[lane[rows]]
    grid[token_step, token_lane] = symbols[np.repeat(first, counts) + at]
    owner[token_step, token_lane] = rows
    starts = np.zeros((steps, lanes), bool)
    starts[begin, place[lane]] = True
    state = np.zeros((lanes, net.recur.shape[1]), np.float32)
    previous = np.full(lanes, end, np.int32)
    for start in range(0, steps, SCORE_WINDOW):
        states, targets, owners = [], [], []
        for t in range(start, min(start + SCORE_WINDOW, steps)):
            active = int(np.searchsorted(-size, -t, side="left"))
            before, new = state[:active], starts[t, :active]
            previous = previous[:active]
            if new.any():
                before, previous = before * ~new[:, None], np.where(new, end, previous)
            state = step(net, np.take(net.inputs, previous, axis=1), before)[0]
            previous = grid[t, :active]
            states.append(state)
            targets.append(previous)
            owners.append(owner[t, :active])
        logs = log_chance(net, np.concatenate(states), np.concatenate(targets))
        total += np.bincount(np.concatenate(owners), logs, minlength=len(total))
    return total


class Gradients(NamedTuple):
    parts: list[np.ndarray]  # of the first six arrays of the network
    rows: list  # which part of each they are of


def _window(net: Network, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray, end: int) -> tuple[Gradients, np.ndarray, float]:
    """Gradients of the mean loss over a window (steps x lanes), the last state, and the loss.

    A text begins with the end of another one as its input, and with an empty state. Inputs that do not
    occur and outputs of classes that do not occur have no rows.
    """
    steps, lanes = inputs.shape
    hidden = state.shape[1]
    n = steps * lanes
    kept, befores = [], []
    flat = np.empty((steps, lanes, hidden), state.dtype)
    g_flat = np.empty((steps, lanes, hidden), state.dtype)
    goes_on = (inputs != end).astype(state.dtype)[:, :, None]
    g_to_class, g_class_bias = np.zeros_like(net.to_class), np.zeros_like(net.class_bias)
    own_class = net.symbol_class[targets]
    loss, rows, ones = 0.0, np.arange(lanes), np.ones(lanes, state.dtype)
    for t in range(steps):
        befores.append(state * goes_on[t])
        state, *parts = step(net, np.take(net.inputs, inputs[t], axis=1), befores[-1])
        kept.append(parts)
        flat[t] = state
        logs, error = _softmax(state @ net.to_class + net.class_bias, own_class[t])
        loss -= float(logs.sum())
        error[rows, own_class[t]] -= 1
        g_to_class += state.T @ error
        g_class_bias += ones @ error
        np.matmul(error, net.to_class.T, out=g_flat[t])
    goal = targets.ravel()
    order = np.argsort(goal, kind="stable")
    cuts = np.searchsorted(goal[order], net.bounds)
    sorted_states, place = flat.reshape(n, hidden)[order], goal[order] - net.bounds[own_class.ravel()[order]]
    back = np.zeros_like(sorted_states)
    met = np.zeros(len(net.symbol_bias), bool)
    g_to_symbol, g_symbol_bias = [net.to_symbol[:0]], [net.symbol_bias[:0]]
    for c in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(net.bounds) > 1)).tolist():
        a, b, some = net.bounds[c], net.bounds[c + 1], slice(cuts[c], cuts[c + 1])
        outputs, own = net.to_symbol[a:b], sorted_states[some]
        logs, error = _softmax(own @ outputs.T + net.symbol_bias[a:b], place[some])
        loss -= float(logs.sum())
        error[np.arange(len(own)), place[some]] -= 1
        met[a:b] = True
        g_to_symbol.append(error.T @ own)
        g_symbol_bias.append(np.ones(len(own), error.dtype) @ error)
        np.matmul(error, outputs, out=back[some])
    g_flat.reshape(n, hidden)[order] += back
    g_recur, g_state = np.zeros_like(net.recur), np.zeros_like(state)
    g_gates = np.empty((3, steps, lanes, hidden), state.dtype)
    through = np.empty((3, lanes, hidden), state.dtype)
    back_recur = net.recur.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        before, (z, r, new, own) = befores[t], kept[t]
        g = g_state + g_flat[t]
        g_new = g_gates[2, t]
        np.multiply(g * (1 - z), 1 - new * new, out=g_new)
        np.multiply(g * (before - new), z * (1 - z), out=g_gates[0, t])
        np.multiply(g_new * own, r * (1 - r), out=g_gates[1, t])
        through[:2] = g_gates[:2, t]
        np.multiply(g_new, r, out=through[2])
        g_recur += np.matmul(before.T, through)
        g_state = g * z
        g_state += np.matmul(through, back_recur).sum(axis=0)
        g_state *= goes_on[t]
    order = np.argsort(inputs.ravel(), kind="stable")
    held = inputs.ravel()[order]
    starts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    g_inputs = np.add.reduceat(np.take(g_gates.reshape(3, n, hidden), order, axis=1), starts, axis=1)
    outputs = np.flatnonzero(met)
    grads = [g_inputs, g_recur, g_to_class, g_class_bias, np.concatenate(g_to_symbol), np.concatenate(g_symbol_bias)]
    some = (slice(None), held[starts])
    return Gradients([g / n for g in grads], [some, ..., ..., ..., outputs, outputs]), state, loss / n


def _gradients(
    net: Network, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray, end: int
) -> tuple[list[np.ndarray], np.ndarray, float]:
    """The gradients of a window for all rows, the last state, and the loss."""
    found, state, loss = _window(net, inputs, targets, state, end)
    grads = []
    for w, g, rows in zip(net[:6], *found):
        whole = np.zeros_like(w)
        whole[rows] = g
        grads.append(whole)
    return grads, state, loss


class Learner:
    """A network and the moments of its Adam steps; rows without a gradient stay as they are."""

    def __init__(self, net: Network):
        self.net, self.steps = net, 0
        self.first, self.second = ([np.zeros_like(w) for w in net[:6]] for _ in range(2))

    def learn(self, stream: np.ndarray, lanes: int, end: int, rate) -> None:
        """Truncated backpropagation through time over a stream of whole texts, cut into lanes of equal length."""
        targets = np.ascontiguousarray(stream.reshape(lanes, -1).T)
        inputs = np.vstack((np.full((1, lanes), end, targets.dtype), targets[:-1]))
        state = np.zeros((lanes, self.net.recur.shape[1]), np.float32)
        for begin in range(0, len(targets), WINDOW):
            grads, state, _ = _window(self.net, inputs[begin : begin + WINDOW], targets[begin : begin + WINDOW], state, end)
            self.steps += 1
            self._move(grads, rate(self.steps))

    def _move(self, grads: Gradients, rate: float) -> None:
        norm = float(np.sqrt(sum(np.vdot(g, g) for g in grads.parts)))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-8)))
        rate = np.float32(rate / (1 - 0.9**self.steps))
        spread = np.float32(1 / np.sqrt(1 - 0.999**self.steps))
        for w, a, b, g, rows in zip(self.net[:6], self.first, self.second, *grads):
            g *= scale
            near, wide = a[rows], b[rows]
            near = near + np.float32(0.1) * (g - near)
            g *= g
            wide = wide + np.float32(0.001) * (g - wide)
            a[rows], b[rows] = near, wide
            np.sqrt(wide, out=wide)
            wide *= spread
            wide += np.float32(1e-8)
            near *= rate
            near /= wide
            w[rows] -= near


def train(sizes: np.ndarray, texts: list[np.ndarray], end: int, epochs: int = EPOCHS) -> Network:
    """A new network that learns from streams of whole texts."""
    learner = Learner(new_network(sizes))
    if not texts:
        return learner.net
    stream = np.concatenate(texts)
    lanes = max(1, min(LANES, len(stream) // (2 * WINDOW)))
    length = len(stream) // lanes
    updates = epochs * -(-length // WINDOW)
    for _ in range(epochs):
        learner.learn(stream[: lanes * length], lanes, end, lambda i: RATE * (1 - 0.9 * i / updates))
    return learner.net


def _flat(net: Network) -> np.ndarray:
    return np.concatenate([w.ravel() for w in net[:6]])


def _with_weights(net: Network, flat: np.ndarray) -> Network:
    ends = np.cumsum([w.size for w in net[:6]])
    return Network(*[flat[e - w.size : e].reshape(w.shape).copy() for w, e in zip(net[:6], ends)], *net[6:])


def learners(net: Network, total: int) -> int:
    """Learners of a round: by the training tokens and the weights alone, not by partitions or cores.

    A learner meets at least ``TOKENS_PER_WEIGHT`` tokens for each weight that it hands back, so what is handed back
    stays a small part of the texts.
    """
    return max(1, round(total / ROUNDS / max(LEARNER_TOKENS, TOKENS_PER_WEIGHT * net.size())))


def train_on_all(rows: DataFrame, net: Network, end: int, total: int) -> tuple[Network, int]:
    """The network after it met every token of all rows' ``symbols`` once, and how many these were.

    Each round takes a share of the texts by a hash of doc_id and deals it over learners by another. A learner goes on
    from the shared weights over its texts, in an order of their own; then the weights of all learners are averaged. Sums are
    exact, so neither partitions nor the order of tasks change the result.
    """
    number = learners(net, total)
    texts = rows.where("training").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).alias("round"),
        F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(number)).cast("int").alias("learner"),
        F.xxhash64(F.lit(2), "doc_id").alias("place"),
        "symbols",
    )
    learned = 0
    for r in range(ROUNDS):
        own = texts.where(F.col("round") == r).drop("round").repartitionById(number, F.col("learner"))
        own = own.sortWithinPartitions("learner", "place", "symbols").select("learner", "symbols")
        run = _round(net, end, ROUND_RATE * (1 - r / ROUNDS))
        handed = cut_lineage(own.mapInArrow(run, "block int, learners long, tokens long, sums binary"), "weights")
        summed = handed.groupBy("block").applyInArrow(_sum_blocks, "block int, learners long, tokens long, sums binary")
        sums = np.zeros(net.size(), np.int64)
        met, tokens = 0, 0
        for row in summed.toArrow().to_pylist():
            part = np.frombuffer(row["sums"], np.int64)
            sums[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
            met, tokens = row["learners"], row["tokens"]
        if met:
            net, learned = _with_weights(net, (sums * (UNIT / met)).astype(np.float32)), learned + tokens
    return net, learned


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a block over all tasks, one row at a time."""
    block, met, tokens, sums = None, 0, 0, None
    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(row["sums"], np.int64)
            block, met, tokens = row["block"], met + row["learners"], tokens + row["tokens"]
            sums = part.copy() if sums is None else sums + part
    yield _weight_rows([block], met, tokens, [sums])


def _weight_rows(blocks: list[int], met: int, tokens: int, sums: list[np.ndarray]) -> pa.RecordBatch:
    columns = [
        pa.array(blocks, pa.int32()),
        pa.array([met] * len(blocks), pa.int64()),
        pa.array([tokens] * len(blocks), pa.int64()),
        pa.array([x.tobytes() for x in sums], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "learners", "tokens", "sums"])


def _round(net: Network, end: int, rate: float):
    """What a task of a round does: each learner's pass over its texts, then the sums of their weights in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, met, tokens = np.zeros(net.size(), np.int64), 0, 0
        kind_of = _stored(len(net.symbol_class))
        learner, held, size, current = None, [], 0, None

        def learn(stream: np.ndarray) -> None:
            lanes = max(1, min(ROUND_LANES, len(stream) // (2 * WINDOW)))
            cut = len(stream) // lanes * lanes
            learner.learn(stream[:cut], lanes, end, lambda i: rate)
            if cut < len(stream):  # fewer than the lanes
                learner.learn(stream[cut:], 1, end, lambda i: rate)

        def finish() -> None:
            nonlocal met, sums
            if held:
                learn(np.concatenate(held))
            if learner is not None:
                met += 1
                sums += np.rint(_flat(learner.net).astype(np.float64) / UNIT).astype(np.int64)

        for batch in batches:
            for i, symbols in zip(batch.column("learner").to_pylist(), batch.column("symbols").to_pylist()):
                if i != current:
                    finish()
                    learner, held, size, current = Learner(_with_weights(net, _flat(net))), [], 0, i
                own = np.frombuffer(symbols, kind_of).astype(np.int32)
                held.append(own)
                size, tokens = size + len(own), tokens + len(own)
                if size >= LEARNER_TOKENS:
                    learn(np.concatenate(held))
                    held, size = [], 0
        finish()
        if met:
            parts = [sums[i : i + BLOCK] for i in range(0, len(sums), BLOCK)]
            for i, part in enumerate(parts):
                yield _weight_rows([i], met, tokens, [part])

    return run


def _sample(rows: DataFrame, counts: Counts, most: int) -> list[np.ndarray]:
    """Symbols of a sample of whole texts with about ``most`` tokens in expectation, whatever the table's size."""
    rate = min(1.0, most / max(counts.total, 1))
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 24))
    chosen = rows.where("training").where(draw < int(rate * (1 << 24)) + 1).select(F.xxhash64(F.lit(4), "doc_id").alias("place"), "symbols")
    # by a hash of doc_id, so that neither order nor partitions matter
    found = sorted((r["place"], bytes(r["symbols"])) for r in chosen.collect())
    return [np.frombuffer(symbols, _stored(len(counts.sizes))).astype(np.int32) for _, symbols in found]


def _stored(symbols: int) -> type:
    """How the symbols of a text are written: two bytes each, or four if there are many."""
    return np.uint16 if symbols <= 1 << 16 else np.uint32


def _prepare(docs: DataFrame, counts: Counts) -> DataFrame:
    """Each text's symbols as bytes, and its parts of the scores that the held counts give.

    ``row, doc_id, training, n_tokens, n_known, base_score, within, rest, symbols``; ``rest`` are tokens whose counts are not held.
    """
    base = float(np.log10(counts.total + 0.5 * (counts.distinct + 1)))
    ending = np.log10(counts.ending_tokens + 0.5 * (counts.ending_words + 1))
    kind_of = _stored(len(counts.sizes))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = tokens(batch.column("text"))
        found, c, symbol = look_up(own.keys, counts)
        log = np.log10(c + 0.5) * found  # the share of tokens looked up later is added then
        kind = counts.symbol_ending[symbol]
        within = np.where(kind >= 0, log - ending[kind], 0.0)
        rows = np.repeat(np.arange(len(own.counts)), own.counts)
        n = len(own.counts)
        sizes = np.bincount(rows, ~found, minlength=n).astype(np.int64)
        rest = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        held = symbol.astype(kind_of)
        bytes_of = np.concatenate(([0], held.itemsize * np.cumsum(own.counts))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(own.counts.astype(np.int64)),
                pa.array(np.bincount(rows, found, minlength=n).astype(np.int64)),
                pa.array(np.bincount(rows, log, minlength=n) - base * own.counts),
                pa.array(np.bincount(rows, within, minlength=n)),
                pa.ListArray.from_arrays(pa.array(rest), pa.array(own.keys[~found])),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bytes_of), pa.py_buffer(held)]),
            ],
            ["doc_id", "n_tokens", "n_known", "base_score", "within", "rest", "symbols"],
        )

    schema = "doc_id long, n_tokens long, n_known long, base_score double, within double, rest array<long>, symbols binary"
    found = map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, schema, PIECE_BYTES)
    training = F.coalesce(_remainder("doc_id") != 1, F.lit(False))
    return found.withColumns({"row": F.monotonically_increasing_id(), "training": training})


def _network_scores(rows: DataFrame, net: Network, end: int) -> DataFrame:
    """The rows, without their symbols, with ``score``: the log10 probability of the symbols."""
    kept = [c for c in rows.columns if c != "symbols"]
    kind_of = _stored(len(net.symbol_class))

    def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        streams = table["symbols"].to_pylist()
        counts = table["n_tokens"].to_numpy()
        symbols = np.frombuffer(b"".join(streams), kind_of).astype(np.int32)
        logs = text_scores(net, symbols, np.cumsum(counts) - counts, counts, end) / _LOG10
        # single precision depends on the texts scored together, so equal rows would differ in the last digits
        return table.select(kept).append_column("score", pa.array(np.round(logs, 3))).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(batch.column("n_tokens").to_numpy())
            start = 0
            while start < batch.num_rows:  # whole rows, up to a number of tokens or one row
                before = int(ends[start - 1]) if start else 0
                stop = max(int(np.searchsorted(ends, before + SCORE_TOKENS - size, side="right")), start + (not held))
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    size += int(ends[stop - 1]) - before
                    start = stop
                if start < batch.num_rows:
                    yield scored(held)
                    held, size = [], 0
        if held:
            yield scored(held)

    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(kept).dtypes)
    return rows.select(*kept, "symbols").mapInArrow(run, f"{kinds}, score double")


def score_texts(docs: DataFrame, training_tokens: int = TRAINING_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Tokens are words between ASCII white space (A to Z in lower case) and one end for each text. Counts
    come from all documents whose crc32(doc_id as text) mod 5 is not 1; the others are ``held_out``.
    ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))). ``score`` is the log10 probability under a gated
    recurrent network, state carried over the whole text. Frequent words have outputs of their own; any
    other word is the output of its ending times its share (c + 0.5) / (n + 0.5 (v + 1)) of the n tokens
    and v words with that ending. The network starts from a sample of about ``training_tokens`` and then
    learns from all training texts, in rounds of learners whose number follows from the tokens alone. So the way rows are
    dealt over partitions does not change ``score``, but for single precision (it is rounded to three places).

    Null and empty texts have the end only. A text is scored whole however long it is; its state takes as long as it has
    tokens, side by side with other texts. Documents without doc_id are scored, not learned from and
    not held out. Without training texts all counts are 0. Repeated rows each get a row; an empty table
    gives an empty result; other columns are ignored.
    """
    training = docs.select("doc_id", "text").where(_remainder("doc_id") != 1)
    table = cut_lineage(count_tokens(training), "counts")
    counts = head(table)
    end = int(look_up(np.array([END]), counts)[2][0])
    rows = cut_lineage(_prepare(docs, counts), "symbols")
    net = train(counts.sizes, _sample(rows, counts, training_tokens), end)
    net = train_on_all(rows, net, end, counts.total)[0]
    scored = cut_lineage(_network_scores(rows.drop("rest", "training"), net, end), "scores")
    rare = rows.select("row", F.explode("rest").alias("key")).join(table, "key", "left")
    added = rare.groupBy("row").agg(
        F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log")
    )
    log = F.coalesce("log", F.lit(0.0))
    return scored.join(added, "row", "left").select(
        "doc_id",
        F.coalesce(_remainder("doc_id") == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + log).alias("base_score"),
        (F.col("score") + F.col("within") + log).alias("score"),
    )
