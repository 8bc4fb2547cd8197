"""Personal data in texts, by patterns and boosted trees, in SQL expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from winnow.sources.scratch import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# Fixed values of the contract: patterns of the base spans. Runs are taken whole (possessive) and only
# begun at their start, which gives the same leftmost matches in time linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: High-recall generators: spans that look like a kind but miss its base pattern.
_AT = r"\x20?[\[(](?:at|AT|@)[\])]\x20?"
_DOT = r"\x20?[\[(](?:dot|DOT|\.)[\])]\x20?"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Fa-f:.])(?:{_GROUPS}{{7}}|(?:{_GROUPS}{{0,5}})?::(?:{_GROUPS}{{0,5}})?)(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9./-])(?:[0-9]{14,19}|[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{2,7}|[0-9]{4}(?:\x20[0-9]{4}){3})(?![0-9./-])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)\x20?|00[0-9]{1,3}[\x20-]|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,6}(?![0-9A-Za-z-]|[./][0-9])",
}
WIDE_GATES = {"email": r"[\[(](?:at|AT|@)[\])]", "ip": r"::|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{14}|[0-9][./_\x20][0-9]{4}[./_\x20]", "phone": r"[0-9]{3,4}[\x20.-][0-9]{3}"}

#: Characters of context on either side of a candidate.
CONTEXT = 32
CUES = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|addr|login",
    "card": "card|visa|master|credit|pay|account",
    "phone": "phone|tel|call|mobile|cell|fax|contact",
}

ROUNDS = 24
RATE = 0.5
MIN_LEAF = 5
#: A threshold must hold this precision on the part of the labelled candidates that is not learned from, together with so many
#: more that are right as often as the trees say.
PRECISION = 0.95
PRIOR = 4
_MARK = "\x01"


def _spans(text: str, pattern: str, gate: str) -> Column:
    """``start, stop, value`` of each match. Matches are put between marks, and lengths of the parts added up."""
    marked = F.regexp_replace(F.col(text), pattern, f"{_MARK}$0{_MARK}")
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(False).alias("inside"),
        F.expr("cast(array() AS array<struct<start:int,stop:int,value:string>>)").alias("found"),
    )

    def step(state: Column, part: Column) -> Column:
        stop = state["at"] + F.length(part)
        own = F.array(F.struct(state["at"].alias("start"), stop.alias("stop"), part.alias("value")))
        return F.struct(
            stop.alias("at"),
            (~state["inside"]).alias("inside"),
            F.when(state["inside"], F.concat(state["found"], own)).otherwise(state["found"]).alias("found"),
        )

    spans = F.aggregate(F.split(marked, _MARK), start, step, lambda state: state["found"])
    return F.when(F.col(text).rlike(gate), spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    digits = F.split(F.reverse(_digits(value)), "")

    def add(state: Column, digit: Column) -> Column:
        d = digit.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        total = state["total"] + F.when(state["even"], twice).otherwise(d)
        return F.struct(total.alias("total"), (~state["even"]).alias("even"))

    return F.aggregate(
        F.filter(digits, lambda d: d != ""),
        F.struct(F.lit(0).alias("total"), F.lit(False).alias("even")),
        add,
        lambda state: state["total"] % 10 == 0,
    )


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _verdict(kind: str, value: Column) -> Column:
    """Whether a wide span is what it looks like: written as the base pattern wants it, it passes the base check."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(value, _AT, "@"), _DOT, ".")
        return plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$")
    if kind == "ip":
        groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
        whole = F.when(F.contains(value, F.lit("::")), groups.between(2, 7)).otherwise(groups == 8)
        return whole & value.rlike("[0-9]") & value.rlike("[0-9A-Fa-f]{3}")
    if kind == "phone":
        return F.length(F.regexp_replace(_digits(value), "^00", "")).between(10, 15)
    return _valid(kind, value)


def _features(text: str, kind: str, span: Column, wide: bool) -> list[Column]:
    """Small whole numbers on the format of a span and on what stands beside it."""
    value = span["value"]
    digits = F.length(_digits(value))
    before = F.substring(F.col(text), F.greatest(F.lit(1), span["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), span["start"]))
    after = F.substring(F.col(text), span["stop"] + 1, F.lit(1))
    return [
        F.lit(KINDS.index(kind)).alias("kind"),
        F.when(digits < 7, 0).when(digits < 10, 1).when(digits < 14, 2).when(digits < 17, 3).when(digits < 20, 4).otherwise(5).alias("digits"),
        F.least(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), F.lit(5)).cast("int").alias("marks"),
        F.when(value.rlike("[A-Za-z]"), 1).otherwise(0).alias("letters"),
        F.when(value.rlike(r"[0-9]{7}"), 1).otherwise(0).alias("long_run"),
        F.when(F.lower(before).rlike(CUES[kind]), 1).otherwise(0).alias("cue"),
        F.when(before.rlike(r"[A-Za-z0-9.,:/_-]$"), 1).otherwise(0).alias("glued_before"),
        F.when(after.rlike(r"[A-Za-z0-9/_-]"), 1).otherwise(0).alias("glued_after"),
        F.when(_luhn(value) if kind == "card" else F.lit(False), 1).otherwise(0).alias("check"),
        F.lit(int(wide)).alias("wide"),
    ]


FEATURES = ("kind", "digits", "marks", "letters", "long_run", "cue", "glued_before", "glued_after", "check", "wide")


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``: overlapping candidate spans of each text, with features and what the rules say of them."""
    text = "__text"
    # The mark is replaced by another control character, which no pattern matches either.
    rows = docs.select(F.col("doc_id").cast("long"), F.translate(F.coalesce("text", F.lit("")), _MARK, "\x03").alias(text))
    rows = rows.select("*", *[_spans(text, BASE[k], GATES[k]).alias(f"base_{k}") for k in KINDS])
    rows = rows.select("*", *[_spans(text, WIDE[k], WIDE_GATES[k]).alias(f"wide_{k}") for k in KINDS])

    def described(kind: str, base: bool) -> Column:
        def one(span: Column) -> Column:
            good = _valid(kind, span["value"]) if base else _verdict(kind, span["value"])
            place = [span["start"].alias("start"), span["stop"].alias("stop"), F.lit(base).alias("base"), good.alias("good")]
            return F.struct(*place, *_features(text, kind, span, not base))

        return F.transform(F.coalesce(f"{'base' if base else 'wide'}_{kind}", F.expr("cast(array() AS array<struct<start:int,stop:int,value:string>>)")), one)

    found = F.concat(*[described(k, base) for base in (True, False) for k in KINDS])
    return rows.select("doc_id", found.alias("found"))


def _grow(cells: list[tuple[tuple[int, ...], float, float]]) -> list:
    """Boosted trees of depth two on weighted cells (features, positives, negatives), by Newton steps on the logistic loss."""
    score = [0.0] * len(cells)
    trees = []
    tests = [(f, v) for f in range(len(FEATURES)) for v in sorted({c[0][f] for c in cells})[1:]]

    def leaf(members: list[int]) -> float:
        g = sum(gradient[i] for i in members)
        h = sum(hessian[i] for i in members)
        return round(RATE * g / (h + 1.0) * 4096) / 4096  # sums of such numbers are exact in any order

    def best(members: list[int]) -> tuple[int, int] | None:
        most, chosen = 1e-6, None
        g, h = sum(gradient[i] for i in members), sum(hessian[i] for i in members)
        for f, v in tests:
            high = [i for i in members if cells[i][0][f] >= v]
            n = sum(cells[i][1] + cells[i][2] for i in high)
            rest = sum(cells[i][1] + cells[i][2] for i in members) - n
            if n < MIN_LEAF or rest < MIN_LEAF:
                continue
            gh, hh = sum(gradient[i] for i in high), sum(hessian[i] for i in high)
            gain = gh * gh / (hh + 1) + (g - gh) ** 2 / (h - hh + 1) - g * g / (h + 1)
            if gain > most:
                most, chosen = gain, (f, v)
        return chosen

    def split(members: list[int], depth: int):
        test = best(members) if depth else None
        if test is None:
            value = leaf(members)
            for i in members:
                score[i] += value
            return value
        f, v = test
        low = [i for i in members if cells[i][0][f] < v]
        high = [i for i in members if cells[i][0][f] >= v]
        return (f, v, split(low, depth - 1), split(high, depth - 1))

    for _ in range(ROUNDS):
        chance = [1 / (1 + math.exp(-s)) for s in score]
        gradient = [c[1] - (c[1] + c[2]) * p for c, p in zip(cells, chance)]
        hessian = [(c[1] + c[2]) * p * (1 - p) for c, p in zip(cells, chance)]
        trees.append(split(list(range(len(cells))), 2))
    return trees


def _value(tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        f, v, low, high = tree
        tree = high if features[f] >= v else low
    return tree


def _expression(tree, span: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, v, low, high = tree
    return F.when(span[FEATURES[f]] >= v, _expression(high, span)).otherwise(_expression(low, span))


def fit(found: DataFrame) -> tuple[list, list[float]]:
    """Trees, and for each kind the score from which a candidate is redacted.

    The labels are what the rules say: of base candidates their check (a check digit, parts of 255 at most, the number of
    digits), of wide ones the same of the span as the base pattern would have it. Trees see format and context. All
    candidates count, summed to one row per combination of features; features are few small
    numbers, so there are at most a few thousand combinations, whatever the size of the table. Where few are held out for a
    kind, what the trees say of them counts beside; so a threshold moves with the evidence, and no kind is left out.
    """
    labelled = found.select("doc_id", F.explode("found").alias("c"))
    held = F.pmod(F.xxhash64("doc_id", "c.start"), F.lit(4)) == 0
    cells = (
        labelled.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES], held.alias("held"))
        .agg(F.count_if("c.good").alias("good"), F.count_if(~F.col("c.good")).alias("bad"))
        .collect()
    )
    rows = sorted((tuple(r[f] for f in FEATURES), float(r["good"]), float(r["bad"]), bool(r["held"])) for r in cells)
    trees = _grow([r[:3] for r in rows if not r[3]])
    thresholds = []
    for kind in range(len(KINDS)):
        of_kind = sorted(((sum(_value(t, r[0]) for t in trees), r[1], r[2], r[3]) for r in rows if r[0][0] == kind), reverse=True)
        limit, good, bad = None, 0.0, 0.0
        for i, (score, g, b, held_out) in enumerate(of_kind):
            if held_out:
                good, bad = good + g, bad + b
            last = i + 1 == len(of_kind) or of_kind[i + 1][0] != score
            chance = 1 / (1 + math.exp(-score))
            if last and good + PRIOR * chance >= PRECISION * (good + bad + PRIOR):
                limit = score
        thresholds.append(_ABOVE if limit is None else limit)
    return trees, thresholds


#: A score that no candidate has.
_ABOVE = 1e6


def _number(kind: int) -> Column:
    return F.size(F.filter("base_spans", lambda span: span["kind"] == kind)).cast("long")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added`` of every document.

    ``base`` and ``spans`` are ``kind:start:end`` by start, then kind, joined by commas, in code points and
    end exclusive. Base spans match a fixed pattern, leftmost and non-overlapping per kind, and pass its
    check. Wider patterns propose more spans, which may overlap: mail addresses with words for their signs, IPv6 addresses,
    cards and phones with other separators. A span is added if it passes the check of its kind once it is written as the
    base pattern has it, boosted trees on format and context give it the score calibrated for its kind, it overlaps no
    base span, and it is the longest of the added spans it overlaps (the first among equals).

    Null texts count as empty. A document without doc_id has a row like any other. Texts are searched whole, however long they
    are. Repeated rows each get a row; without any candidate nothing is added; an
    empty table gives an empty result; other columns are ignored.
    """
    found = cut_lineage(candidates(docs), "candidates")
    trees, thresholds = fit(found)

    def overlaps(a: Column, b: Column) -> Column:
        return (a["start"] < b["stop"]) & (b["start"] < a["stop"])

    def passes(span: Column) -> Column:
        score = F.lit(0.0)
        for tree in trees:
            score = score + _expression(tree, span)
        limit = F.element_at(F.array(*[F.lit(t) for t in thresholds]), span["kind"] + 1)
        return ~span["base"] & span["good"] & (score >= limit)

    def stands(span: Column) -> Column:
        """No base span and no better added span overlaps this one."""

        def better(other: Column) -> Column:
            size, own = other["stop"] - other["start"], span["stop"] - span["start"]
            first = F.struct(other["start"], other["kind"]) < F.struct(span["start"], span["kind"])
            return overlaps(span, other) & ((size > own) | ((size == own) & first))

        return ~F.exists("base_spans", lambda b: overlaps(span, b)) & ~F.exists("proposed", better)

    rows = found.select("doc_id", "found", F.filter("found", lambda s: s["base"] & s["good"]).alias("base_spans"))
    rows = rows.withColumn("proposed", F.filter("found", passes))
    rows = rows.select("doc_id", "base_spans", F.filter("proposed", stands).alias("added"))

    def joined(spans: Column) -> Column:
        order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(
            F.transform(F.array_sort(order), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
        )

    return rows.select(
        "doc_id",
        *[_number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        joined(F.col("base_spans")).alias("base"),
        joined(F.concat("base_spans", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def personal_report(docs: DataFrame) -> DataFrame:
    """The findings with ``base_sha256``, the digest of the base spans."""
    found = find_personal_data(docs)
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_added"
    )
