"""Line-level scans over a corpus of files.

Everything here is narrow: no shuffle, no join, no Python. Rules are compiled
into one projection per line instead of a join of rules and lines, and cheap
literal tests run before any regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.paths import language_of
from winnow.functions.text import (
    any_of,
    holds_any,
    is_comment_line,
    js_space,
    match_position,
    rule_pattern,
)
from winnow.operators.rules import (
    DIAGNOSTIC_ACTIONS,
    FUNCTION_NEEDS,
    FUNCTION_PATTERNS,
    LINE_ACTIONS,
    SCAN_RULES,
    DiagnosticAction,
    LineAction,
    ScanRule,
)


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("language", language_of(path))


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line with its 0-based index; the content column is dropped."""
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.posexplode(F.split(content, "\n")).alias("line_no", "line"))


def drop_comment_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.filter(~is_comment_line(line))


def _finding(rule: ScanRule, line: Column, low: Column) -> Column:
    pattern = rule_pattern(rule.pattern)
    hit = holds_any(line, rule.needs)
    if rule.hints != rule.needs:
        hit = hit & holds_any(low if rule.ignores_case else line, rule.hints)
    hit = hit & F.rlike(line, F.lit(pattern))
    if rule.exclude:
        hit = hit & ~F.rlike(line, F.lit(rule_pattern(rule.exclude)))
    start = match_position(line, pattern)
    text = F.regexp_substr(line, F.lit(pattern))
    return F.when(
        hit,
        F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            start.alias("column"),
            (start + F.length(text)).alias("end_column"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.category).alias("category"),
            F.lit(rule.message).alias("message"),
            F.left(text, F.lit(80)).alias("pattern"),
        ),
    )


def security_scan(
    files: DataFrame, rules: list[ScanRule] = SCAN_RULES, content: str = "content"
) -> DataFrame:
    """Findings of every rule on every line that is not a comment line.

    Every rule needs one of a dozen literals. A text without any of them is
    dropped before it is split, and so is each line, so plain prose costs one
    pass of literal searches.
    """
    needs = sorted({n for r in rules for n in r.needs})
    lines = explode_lines(files.filter(holds_any(content, needs)), content)
    lines = drop_comment_lines(lines.filter(holds_any("line", needs)))
    keep = [c for c in lines.columns if c != "line"]
    low = lines.withColumn("_low", F.lower("line"))
    found = F.array_compact(F.array(*[_finding(r, F.col("line"), F.col("_low")) for r in rules]))
    return low.select(*keep, F.explode(found).alias("f")).select(*keep, "f.*")


def index_functions(
    files: DataFrame, patterns: dict[str, str] = FUNCTION_PATTERNS, content: str = "content"
) -> DataFrame:
    """Lines that open a function, by the language of the file."""
    known = files.filter(F.col("language").isin(*patterns))
    lines = explode_lines(known, content)
    by_pattern: dict[str, list[str]] = {}
    for language, pattern in patterns.items():
        by_pattern.setdefault(pattern, []).append(language)
    hit = F.lit(False)
    for pattern, languages in by_pattern.items():
        test = F.col("language").isin(*languages)
        needs = FUNCTION_NEEDS.get(languages[0]) if patterns is FUNCTION_PATTERNS else None
        if needs:
            test = test & holds_any("line", needs)
        hit = hit | (test & F.rlike("line", F.lit(js_space(pattern))))
    return lines.filter(hit)


def _applies(languages: tuple[str, ...]) -> Column:
    return F.col("language").isin(*languages) if languages else F.lit(True)


def _may_hold(actions: list[LineAction]) -> Column:
    """True where a line holds what one of the actions needs, whatever its language."""
    if not actions:
        return F.lit(False)
    if not all(a.needs for a in actions):
        return F.lit(True)
    plain = [n for a in actions for n in a.needs if not (a.hint or a.ignores_case)]
    any_case = [n for a in actions for n in a.needs if not a.hint and a.ignores_case]
    patterns = [a.hint for a in actions if a.hint]
    if plain or any_case:
        patterns.append(any_of(plain, any_case))
    return F.rlike("line", F.lit("|".join(patterns)))


def tag_lines(
    files: DataFrame, actions: list[LineAction] = LINE_ACTIONS, content: str = "content"
) -> DataFrame:
    """Every (line, action) whose language fits and whose pattern matches the line; a null language fits actions of every language."""
    # actions that share a pattern and languages are tested once
    groups: dict[LineAction, list[str]] = {}
    for a in actions:
        groups.setdefault(a._replace(action=""), []).append(a.action)
    # one search per line, for all that the actions of its language need
    everywhere = [a for a in groups if not a.languages]
    named = sorted({x for a in groups for x in a.languages})
    other = F.col("language").isNull() | ~F.col("language").isin(*named)
    gate = other & _may_hold(everywhere)
    for language in named:
        own = [a for a in groups if language in a.languages]
        gate = gate | ((F.col("language") == language) & _may_hold([*own, *everywhere]))
    lines = explode_lines(files, content).filter(gate)

    def test(a: LineAction) -> Column:
        hit = _applies(a.languages)
        if a.hint:
            hit = hit & F.rlike("line", F.lit(a.hint))
        elif a.needs:
            hit = hit & holds_any("_low" if a.ignores_case else "line", a.needs)
        return hit & F.rlike("line", F.lit(rule_pattern(a.pattern)))

    tests = [F.when(test(a), F.array(*[F.lit(n) for n in names])) for a, names in groups.items()]
    found = F.flatten(F.array_compact(F.array(*tests)))
    return lines.withColumn("_low", F.lower("line")).withColumn("action", F.explode(found)).drop("_low")


def match_actions(
    diagnostics: DataFrame, actions: list[DiagnosticAction] = DIAGNOSTIC_ACTIONS
) -> DataFrame:
    """Per file, the actions whose pattern matches any of its diagnostics.

    ``diagnostics`` has path, language and message. One boolean per action is
    aggregated map-side, so a file with very many diagnostics stays cheap.
    """
    flags = [
        F.bool_or(
            _applies(a.languages)
            & (F.rlike("message", F.lit(js_space(a.pattern))) if a.pattern else F.lit(True))
        ).alias(a.action)
        for a in actions
    ]
    seen = diagnostics.groupBy("path").agg(*flags)
    names = F.array_compact(F.array(*[F.when(F.col(a.action), F.lit(a.action)) for a in actions]))
    return seen.select("path", F.explode(names).alias("action"))


def filter_diagnostics(diagnostics: DataFrame, root: str) -> DataFrame:
    """Errors and warnings under ``root`` with 1-based positions and a default source."""
    return diagnostics.filter(
        F.col("severity").isin("error", "warning") & F.startswith("path", F.lit(root))
    ).select(
        "path",
        (F.col("line") + 1).alias("line"),
        (F.col("col") + 1).alias("col"),
        "message",
        "severity",
        F.coalesce("source", F.lit("unknown")).alias("source"),
    )
