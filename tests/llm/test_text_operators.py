"""Operators on single texts against brute force."""

import hashlib
import ipaddress
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece as library

from winnow.llm import language, lm, personal, quality, secrets, sentencepiece

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(DOCUMENTS).select("doc_id", "text").collect()}


# --- secrets


def base_secrets(text):
    found = []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_secrets(spark):
    rng = random.Random(1)
    parts = ["password", "Token", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "abc123", "0123456789abcdef", "AKIA", "ABCDEFGH12", "\n", "é"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(made + list(texts(spark).values()))), "doc_id long, text string")
    every = dict(docs.collect())
    for r in secrets.secret_report(docs).collect():
        wanted = base_secrets(every[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest()
        assert set(filter(None, wanted.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(
    ("value", "low", "high"),
    [("password", 0, 1), ("aaaaaaaaaaaa", 1, 3), ("qwertyuiop", 3, 6), ("2019-12-31", 3, 6), ("e31f8f02dead059b5a", 15, 18), ("hunter2hunter2", 6, 8), ("", 0, 0)],
)
def test_guess_cost(value, low, high):
    assert low <= secrets.guess_cost(value) <= high


def test_cost_is_the_least_over_all_cuts():
    """A value costs at most what any cut of it costs, and words of the text are cheap."""
    for value in ("summer2019!", "xk3redredred", "qwerty77zz"):
        whole = secrets.guess_cost(value)
        assert all(whole <= secrets.guess_cost(value[:k]) + secrets.guess_cost(value[k:]) + 1e-9 for k in range(len(value)))
    assert secrets.guess_cost("thonerand") > secrets.guess_cost("thonerand", {"thonerand": 3})


def test_added_spans():
    text = 'pwd: "xK9$mQ2!vLp7" and the password is wonderful; secret: password password1'
    base, added, _ = secrets.scan(text)
    assert base == [] and [text[s:e] for s, _, e in added] == ["xK9$mQ2!vLp7"]


def test_whole_values_are_covered():
    rng = random.Random(5)
    value = "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=600))
    assert secrets.scan(f"auth: {value} end")[1] == [(6, 3, 606)]
    text = "password=Tr0ub4dor3xx$9!kQz#77"
    base, added, _ = secrets.scan(text)
    assert base and added == [(9, 3, len(text))]


def test_a_repeated_secret_is_no_word():
    assert [s for s, _, _ in secrets.scan("pwd: kqzvbnrtxwpl\nand again\npwd: kqzvbnrtxwpl")[1]] == [5, 33]


CLEAN = [
    "the secret is extraordinarily well kept", "the password is unfortunately forgotten",
    "auth: internationalization", "access_key: /usr/local/share/documents",
]


def test_planted_secrets_and_ordinary_prose(spark):
    """Words that other documents hold are no secrets, whatever they stand beside; random values are."""
    rng = random.Random(17)
    prose = "we found that the extraordinarily long path /usr/local/share/documents needs internationalization, unfortunately. it was forgotten and kept well"
    words = re.findall("[a-z]+", prose)
    made = [prose, prose.upper()] + [" ".join(rng.choices(words, k=30)) for _ in range(60)]
    clean = CLEAN + [f"{cue} {rng.choice(words)}{sep}{rng.choice(words)}" for cue in ("token:", "pwd =", "credentials:") for sep in ("/", ".", "_", "-") for _ in range(5)]
    alphabet = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789$!#%"
    cues = ["pwd: ", "credentials = ", "the passcode is ", "private_key: ", "auth: ", "passphrase => "]
    values = ["".join(rng.choices(alphabet, k=rng.randrange(12, 30))) for _ in range(60)]
    values = [v for v in values if v[-1] not in ".)]}!?:"]
    planted = [f"{rng.choice(words)} {rng.choice(cues)}{v} {rng.choice(words)}" for v in values]
    docs = spark.createDataFrame(list(enumerate(made + clean + planted)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    first = len(made) + len(clean)
    assert [i for i in range(first) if found[i].n_guess or found[i].spans != found[i].base] == []
    assert all(not found[i].spans for i in range(len(made) + len(CLEAN)))
    caught = 0
    for i, (text, value) in enumerate(zip(planted, values), first):
        at = text.index(value)
        caught += any(int(s) <= at and at + len(value) <= int(e) for _, s, e in (x.split(":") for x in found[i].spans.split(",") if x))
    assert caught == len(planted)


def test_corpus_words(spark):
    docs = spark.createDataFrame(
        [(1, "apple Apple pear pwd: kqzvbnrtxwpl"), (2, "apple kqzvbnrtxwpl x"), (3, "Pear apple éclair " + "y" * 40), (4, None), (5, "éclair")],
        "doc_id long, text string",
    )
    assert secrets.corpus_words(docs) == {"apple": 1, "pear": 2, "éclair": 3}
    assert secrets.corpus_words(docs, 1) == {"apple": 1}


def test_long_values_are_priced_in_linear_time():
    rng = random.Random(2)
    for value in ("abcdefgh" * 125_000, "".join(rng.choices("xz", k=1_000_000)), "password" * 125_000, "qwerty1" * 150_000):
        start = time.process_time()
        assert secrets.scan(f"pwd: {value}")[1] == [(5, 3, 5 + len(value))] and time.process_time() - start < 2


def test_a_repeat_costs_its_unit_alone():
    unit = secrets.guess_cost("xk3pq9")
    assert secrets.guess_cost("summerxk3pq9xk3pq9") <= secrets.guess_cost("summer") + unit + math.log10(2) + 1e-9
    assert secrets.guess_cost("xk3pq9" * 3) == pytest.approx(unit + math.log10(3))


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_personal(text):
    found = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), i, m.end()))
    return ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_personal(spark):
    rng = random.Random(5)
    parts = ["a", "B", "1", "94", "0", ".", "@", "-", " ", "+", "(", ")", "_", "%", "é", "\x01", "\x03", "\n", "4111 1111 1111 1111", "x@a.b_c@d.e", "1.2.3.4", "999.1.1.1", "+1 (649) 555-6111", "😀", "255"]
    made = [None, "", "1" * 30_000, "a@b.c" * 50, "1.2.3.4.5.6.7.8", "a" * 100_000] + ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(made + list(texts(spark).values()))), "doc_id long, text string")
    every = dict(docs.collect())
    for r in personal.personal_report(docs).collect():
        wanted = base_personal(every[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest(), every[r.doc_id]
        assert set(filter(None, wanted.split(","))) <= set(r.spans.split(","))


def test_personal_plan_is_native(spark):
    docs = spark.read.parquet(DOCUMENTS)
    plan = personal.candidates(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_cards_side_by_side(spark):
    """Two cards in one run of digits fail the base check; the wider pattern proposes each of them."""
    card, wrong = "4111111111111111", "4111111111111112"
    made = [f"number {card} here" for _ in range(200)] + [f"number {wrong} here" for _ in range(200)] + [f"{card} {wrong}"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    found = {r.doc_id: r for r in personal.personal_report(docs).collect()}
    assert found[400].n_card == 0 and found[400].spans == "card:0:16"
    assert all(found[i].spans == "" for i in range(200, 400))


def added_personal(text):
    """Spans that a plain reading adds, for texts without base spans beside them."""
    found = []
    for m in re.finditer(r"[\w.%+-]+ ?[\[(](?:at|AT|@)[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(](?:dot|DOT|\.)[\])] ?)[A-Za-z0-9-]+)+", text, re.A):
        found.append(("email", m.start(), m.end()))
    for m in re.finditer(r"(?<![\w:.])[0-9A-Fa-f:]{6,}(?![\w:.])", text):
        try:
            # times and names of code look like short ones
            if ipaddress.ip_address(m[0]).version == 6 and re.search("[0-9A-Fa-f]{3}", m[0]) and re.search("[0-9]", m[0]):
                found.append(("ip", m.start(), m.end()))
        except ValueError:
            pass
    for m in re.finditer(r"(?<![0-9./-])\d{4}[./_]\d{4}[./_]\d{4}[./_]\d{2,7}(?![0-9./-])", text):
        if luhn(re.sub(r"\D", "", m[0])):
            found.append(("card", m.start(), m.end()))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: x[1]))


def test_added_personal_data(spark):
    """Wide spans are added where they pass the base checks, and only there, in small tables and large ones."""
    rng = random.Random(31)
    card = lambda good: next(c for c in ("".join(rng.choices("0123456789", k=16)) for _ in range(10_000)) if luhn(c) == good)
    dotted = lambda c, mark: mark.join(c[i : i + 4] for i in range(0, 16, 4))
    made = []
    for i in range(120):
        word = "".join(rng.choices("abcdefgh", k=6))
        made += [
            f"write to {word} [at] mail.example.org now", f"mail {word}(at)example [dot] com", "host 2001:db8::%x is up" % rng.randrange(1, 65536),
            "addr fe80:0:0:0:%x:1:2:3" % rng.randrange(1, 65536), f"card {dotted(card(True), '.')} paid", f"number {dotted(card(False), '.')} here",
            f"std::{word} at 12::30 and a::b", f"{word} at noon", f"card {card(True)}", f"ref {card(False)}", "ip 10.0.0.%d" % rng.randrange(400),
        ]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in personal.find_personal_data(docs).collect()}
    for i, text in enumerate(made):
        wanted = ",".join(filter(None, [added_personal(text)]))
        assert found[i].spans == ",".join(filter(None, [found[i].base, wanted])), text
    assert sum(r.n_added for r in found.values()) == 5 * 120
    few = spark.createDataFrame(list(enumerate(made[:11])), "doc_id long, text string")
    assert sum(r.n_added for r in personal.find_personal_data(few).collect()) <= 5


# --- SentencePiece


def test_same_ids_as_the_library(spark):
    rng = random.Random(3)
    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL_PATH)
    fst = sentencepiece.compiled(sentencepiece.read_model())
    letters = [*"abcdefgh  \n.,-=_/*0123ABCéè▁日", "the", "ing", "tion", "   "]
    made = ["", " ", "  ", "a", "  Hello  wörld ☃ 日本語 \n\tx ", " " * 500, "<0x0A></s><s>", "a" * 60, "0" * 300, "the" * 200, "😀🙂👍🏽", "=" * 40]
    made += ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500)]
    for text in made + list(texts(spark).values()):
        ids = np.frombuffer(fst.encode(text), np.int32).tolist()
        assert ids == model.encode(text), text
        assert fst.decode(ids) == model.decode(ids) == text.replace("▁", " ")


def test_unigram_path_is_the_lightest():
    pieces = {"a": -1.0, "b": -2.5, "ab": -3.0, "ba": -1.5, "aba": -4.4}
    model = sentencepiece.Model(["<unk>", *pieces], [0.0, *pieces.values()], [2] + [1] * len(pieces), sentencepiece.UNIGRAM, False, False)
    fst = sentencepiece.Transducer(model)
    for n in range(1, 7):
        for text in map("".join, itertools.product("ab", repeat=n)):
            def cuts(s):
                return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in pieces for rest in cuts(s[k:])]

            best = max(sum(pieces[p] for p in c) for c in cuts(text))
            assert math.isclose(sum(pieces[model.pieces[i]] for i in fst.chunk_ids(text)), best)


def test_encode_then_decode(spark):
    docs = spark.read.parquet(DOCUMENTS)
    rows = sentencepiece.decode(sentencepiece.encode(docs, ["doc_id"])).select("doc_id", "text", "decoded").collect()
    assert len(rows) == docs.count() and all(r.text == r.decoded for r in rows)
    assert all(r.exact for r in sentencepiece.round_trip(docs).collect())


# --- language


def test_model_is_a_distribution():
    found = language.grams(["a bad cab", "abc abd", None, ""])
    assert found.counts.tolist() == [9, 7, 0, 0]
    keys, n = np.unique(found.keys, return_counts=True)
    model = language.KneserNey(keys, n)
    symbols = np.arange(language.SYMBOLS, dtype=np.uint64)
    for context in (int(keys[0]) >> 16, int(keys[-1]) >> 16, 0x006300640078, 0):
        assert math.isclose(np.exp2(model.log2(np.uint64(context << 16) | symbols)).sum(), 1, rel_tol=1e-9)


def kneser_ney(sequences):
    """Interpolated Kneser-Ney over tuples of symbols, by its definition."""
    tables = {language.ORDER: Counter(sequences)}
    for order in range(language.ORDER - 1, 0, -1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])
    discount = {}
    for order, counts in tables.items():
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount[order] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)

    def chance(gram):
        order = len(gram)
        if not order:
            return 1 / language.SYMBOLS
        follow = {g: c for g, c in tables[order].items() if g[:-1] == gram[:-1]}
        lower = chance(gram[1:])
        if not follow:
            return lower
        total, d = sum(follow.values()), discount[order]
        return max(tables[order][gram] - d, 0) / total + d * len(follow) / total * lower

    return chance


def test_models_are_kneser_ney_by_definition():
    texts_ = ["the cat sat on the mat, the end", "a dog ran by the cat and sat", "éa ça ira", "x", ""]
    found = language.grams(texts_)
    model = language.KneserNey(*np.unique(found.keys, return_counts=True))
    tuples = [tuple(int(k) >> 16 * i & 0xFFFF for i in range(language.ORDER - 1, -1, -1)) for k in found.keys]
    chance = kneser_ney(tuples)
    rng = random.Random(4)
    symbols = sorted({x for t in tuples for x in t}) + [60_000]
    asked = tuples + [t[:-1] + (rng.choice(symbols),) for t in tuples] + [tuple(rng.choices(symbols, k=language.ORDER)) for _ in range(200)]
    keys = np.array([sum(x << 16 * i for i, x in enumerate(reversed(t))) for t in asked], np.uint64)
    assert np.allclose(np.exp2(model.log2(keys)), [chance(t) for t in asked], rtol=1e-9)
    other = ["the dog sat", "ça va", "zebra 12 quiz"]
    own = language.grams(other)
    bits = language.cross_entropy(own, [model])[:, 0]
    for first, n, got in zip(own.first, own.counts, bits):
        each = [tuple(int(k) >> 16 * i & 0xFFFF for i in range(language.ORDER - 1, -1, -1)) for k in own.keys[first : first + n]]
        assert got == pytest.approx(-sum(math.log2(chance(t)) for t in each) / n, rel=1e-9)


def test_score_does_not_depend_on_neighbours():
    found = language.grams(["the cat sat", "der hund lief"])
    keys, n = np.unique(found.keys, return_counts=True)
    models = [language.KneserNey(keys, n)]
    both = language.cross_entropy(language.grams(["a cat", "ein hund!", ""]), models)
    alone = [language.cross_entropy(language.grams([t]), models)[0] for t in ("a cat", "ein hund!", "")]
    assert np.allclose(both, alone)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in language.language_report(docs).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert np.mean([r.accepted for r in held]) > 0.98


def test_unlearned_language_is_rejected(spark):
    """Held-out texts of a language that nobody labelled go, clean ones of the others stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) >= 256")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    model = language.learn(docs.where("lang <> 'de'"))
    held = docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1")
    found = [(truth[r.doc_id], r.accepted) for r in language.identify(held, model, ["doc_id"]).collect()]
    share = {l: np.mean([a for t, a in found if t == l]) for l in set(truth.values()) if l}
    assert share.pop("de") < 0.1 and min(share.values()) > 0.95, share


# --- quality


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    counts, first = np.array([3, 1, 4]), np.array([0, 3, 4])
    emit, change = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs = quality.forward_backward(emit, change, first, counts)
    all_good, all_pairs = np.zeros(8), np.zeros((2, 2))
    for f, n in zip(first, counts):
        total, own, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(emit[f + i] * y[i] for i in range(n)) + sum(change[y[i - 1], y[i]] for i in range(1, n)))
            total, own = total + w, own + w * np.array(y)
            for i in range(1, n):
                both[y[i - 1], y[i]] += w
        all_good[f : f + n] = own / total
        all_pairs += both / total
    assert np.allclose(good, all_good) and np.allclose(pairs, all_pairs)


def test_line_features():
    found = quality.line_features(pa.array(["ab cd\n\nAA AA AA.\nAA AA AA.", None, "", "x|y!\n"]))
    assert found.counts.tolist() == [4, 1, 1, 2] and found.weight.tolist() == [5, 1, 9, 9, 1, 1, 4, 1]
    own = found.features[:, : quality.N_OWN]
    assert own[2, 10] == 0.5 and own[3, 14] == 1 and own[2, 14] == 0  # repeats, equal to the line before
    assert np.allclose(found.features[1, quality.N_OWN : 2 * quality.N_OWN], own[0])


def test_quality_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = quality.quality_report(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


# --- language model


def test_gradients():
    rng = np.random.default_rng(1)
    net = lm.new_network(np.sort(rng.integers(1, 50, 40))[::-1].astype(float), 5, 6)
    net = lm.Network(*[(w + rng.normal(size=w.shape) * 0.1).astype(np.float64) for w in net[:6]], *net[6:])
    inputs, targets, state = rng.integers(0, 40, (4, 3)), rng.integers(0, 40, (4, 3)), rng.normal(size=(3, 5))
    inputs[2, 1] = 7
    grads, _, _ = lm._gradients(net, inputs, targets, state, 7)
    for w, g in zip(net[:6], grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        held, values = w[at], []
        for move in (1e-5, -1e-5):
            w[at] = held + move
            values.append(lm._gradients(net, inputs, targets, state, 7)[2])
        w[at] = held
        assert math.isclose((values[0] - values[1]) / 2e-5, g[at], rel_tol=1e-4)


def test_chances_add_up_and_state_is_carried():
    rng = np.random.default_rng(2)
    net = lm.new_network(np.sort(rng.integers(1, 50, 40))[::-1].astype(float), 5, 6)
    net.to_class[:] = rng.normal(size=net.to_class.shape)
    chances = [math.exp(lm.log_chance(net, np.ones((1, 5), np.float32), np.array([j]))[0]) for j in range(40)]
    assert math.isclose(sum(chances), 1, rel_tol=1e-5)
    each = [rng.integers(0, 40, n) for n in (1, 5, 3 * lm.SCORE_WINDOW + 1, lm.SCORE_WINDOW, *rng.integers(1, 60, 40))]
    counts = np.array([len(x) for x in each])
    together = lm.text_scores(net, np.concatenate(each), np.cumsum(counts) - counts, counts, 7)
    for x, score in zip(each, together):
        state, total = np.zeros((1, 5), np.float32), 0.0
        for before, symbol in zip([7, *x], x):
            state = lm.step(net, net.inputs[:, [before]], state)[0]
            total += lm.log_chance(net, state, np.array([symbol]))[0]
        assert math.isclose(score, total, rel_tol=1e-4)


@pytest.mark.parametrize("most", [lm.HEAD_WORDS, 50])
def test_base_scores(spark, monkeypatch, most):
    """Whether counts are held by the tasks or joined makes no difference."""
    monkeypatch.setattr(lm, "head", lambda counts, head=lm.head: head(counts, most))
    docs = spark.read.parquet(DOCUMENTS)
    each = {i: (t or "").encode().lower().split() + [None] for i, t in texts(spark).items()}
    seen = Counter(w for i, words in each.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in words)
    total, distinct = sum(seen.values()), len(seen)
    found = lm.score_texts(docs, 60_000).collect()
    for r in found:
        words = each[r.doc_id]
        assert (r.n_tokens, r.train_tokens) == (len(words), total)
        assert r.n_known == sum(w in seen for w in words)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words), rel_tol=1e-9)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_network_learns_from_all_texts(spark, monkeypatch):
    """Every training token reaches the network beyond its sample, and helps on held-out texts."""
    docs = spark.read.parquet(DOCUMENTS)
    training = docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 1").select("doc_id", "text")
    met, whole = [], lm.train_on_all
    monkeypatch.setattr(lm, "train_on_all", lambda *a: (met.append(whole(*a)), met[-1])[1])
    found = [r for r in lm.score_texts(docs, 20_000).collect() if r.held_out]
    assert met[0][1] == sum(len((r.text or "").encode().lower().split()) + 1 for r in training.collect()) == found[0].train_tokens
    monkeypatch.setattr(lm, "train_on_all", lambda rows, net, end, total: (net, 0))
    sampled = [r for r in lm.score_texts(docs, 20_000).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.score for r in sampled)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEARNER_TOKENS", 4000)  # several learners a round
    monkeypatch.setattr(lm, "TOKENS_PER_WEIGHT", 0)
    docs = spark.read.parquet(DOCUMENTS)
    one, seven = (
        {r.doc_id: r for r in lm.score_texts(docs.repartition(n), 20_000).collect()} for n in (1, 7)
    )
    for i, r in one.items():
        assert r.score == pytest.approx(seven[i].score, abs=2e-3)
        assert r.base_score == pytest.approx(seven[i].base_score, rel=1e-12)


def test_learners_follow_from_the_tokens_alone():
    net = lm.new_network(np.arange(100, 0, -1).astype(float), 5, 6)
    assert lm.learners(net, 1000) == 1
    assert lm.learners(net, 40 * lm.ROUNDS * lm.LEARNER_TOKENS) == 40
    large = net._replace(to_symbol=np.zeros((lm.LEARNER_TOKENS, 2), np.float32))
    assert lm.learners(large, 40 * lm.ROUNDS * lm.LEARNER_TOKENS) == 10


def test_whole_scores_by_definition(spark, monkeypatch):
    """The network's weights are taken as learned; everything else is worked out token by token from the texts."""
    made, whole = [], lm.train_on_all
    monkeypatch.setattr(lm, "train_on_all", lambda *a: (made.append(whole(*a)[0]), (made[-1], 0))[1])
    monkeypatch.setattr(lm, "VOCABULARY", 12)
    monkeypatch.setattr(lm, "head", lambda counts, head=lm.head: made.append(head(counts)) or made[-1])
    each = {i: t or "" for i, t in sorted(texts(spark).items()) if len(t or "") < 1500}
    docs = spark.createDataFrame(list(each.items()), "doc_id long, text string")
    found = {r.doc_id: r.score for r in lm.score_texts(docs, 5_000).collect()}
    counts, net = made
    words = {i: t.encode().lower().split() + [None] for i, t in each.items()}
    seen = Counter(w for i, own in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in own)
    keys = {}  # the key of each word, which says nothing but its ending
    for i, own in words.items():
        keys.update(zip(own, lm.tokens(pa.array([each[i]])).keys.tolist()))
    many = sum(n >= math.sqrt(sum(seen.values())) for n in seen.values())
    named = sorted(seen, key=lambda w: (-seen[w], keys[w]))[: max(11, many)]
    named = [*named, None] if None not in named else named
    rare = {w: n for w, n in seen.items() if w not in named}
    for i in list(each)[:25]:
        state, before, score = np.zeros((1, lm.HIDDEN), np.float32), keys[None], 0.0
        for w in words[i]:
            symbols = lm.look_up(np.array([before, keys[w]]), counts)[2]
            state = lm.step(net, net.inputs[:, symbols[:1]], state)[0]
            score += lm.log_chance(net, state, symbols[1:])[0] / math.log(10)
            if w not in named:
                kin = [n for v, n in rare.items() if keys[v] & 63 == keys[w] & 63]
                score += math.log10((seen[w] + 0.5) / (sum(kin) + 0.5 * (len(kin) + 1)))
            before = keys[w]
        assert found[i] == pytest.approx(score, abs=2e-3)


def test_outputs_grow_with_the_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 10)
    for most, outputs in ((1000, 12), (100_000, 130)):
        counts = spark.createDataFrame([(i * lm.ENDINGS, most // (i + 1)) for i in range(200)], "key long, c long")
        found = lm.head(counts)
        assert len(found.sizes) - lm.ENDINGS == outputs
        assert (np.diff(found.sizes) <= 0).all()  # the symbols of a class lie side by side
