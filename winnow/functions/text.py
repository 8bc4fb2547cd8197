"""Text column expressions.

Lengths and positions are counted in code points, which is what Spark's
``length`` and ``substring`` do.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space and line ends a JavaScript ``trim`` removes.
JS_SPACE = (
    "\t\n\u000b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Markers of cut texts, fence lines and comment lines.
FILE_MARKER = "\n... (truncated to fit context budget)"
DIFF_MARKER = "\n... (diff truncated)"
FENCE_PATTERN = r"(?m)^```\w*\n?|```\s*$"
COMMENT_PATTERN = r"^\s*(#|//|\*|/\*)"

# The same white space inside a character class of a pattern.
JS_SPACE_CLASS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_WORD = "[A-Za-z0-9_]"
# before a word character, a class of them or a group of words; elsewhere after one
_WORD_START = re.compile(r"\\b(?=[A-Za-z0-9_]|\\w|\\d|\(\?:)")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_space(pattern: str, space: str = JS_SPACE_CLASS) -> str:
    """Spell out ``\\s`` and ``\\S``: JavaScript counts Unicode spaces and the byte order mark, Java does not.

    ``\\S`` may not stand inside a class.
    """
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            if two == r"\S" and inside:
                raise ValueError(f"class holds \\S: {pattern}")
            out.append({r"\s": space if inside else f"[{space}]", r"\S": f"[^{space}]"}.get(two, two))
            i += 2
            continue
        inside = two[0] == "[" or (inside and two[0] != "]")
        out.append(two[0])
        i += 1
    return "".join(out)


def rule_pattern(pattern: str) -> str:
    """A rule's pattern as Java reads it: JavaScript white space and word boundaries."""
    return js_space(ascii_boundary(pattern))


def ascii_boundary(pattern: str) -> str:
    """Replace ``\\b`` so that only ASCII letters, digits and ``_`` are word characters.

    Java counts accented letters as word characters; the rules do not. What
    stands next to ``\\b`` in a pattern must be word characters, as in all rules;
    one look to the other side is then enough.
    """
    return _WORD_START.sub(f"(?<!{_WORD})", pattern).replace(r"\b", f"(?!{_WORD})")


def trim_space(c: Column | str) -> Column:
    """Trim all white space (Spark's ``trim`` drops only blanks)."""
    return F.btrim(as_col(c), F.lit(JS_SPACE))


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def first_group(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a capture group, null when the pattern does not match."""
    return empty_to_null(F.regexp_extract(as_col(c), pattern, group))


def all_groups(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(pattern), F.lit(group))


def truncate_text(c: Column | str, n: Column | int, marker: str = FILE_MARKER) -> Column:
    """Keep at most ``n`` characters; a marker shows that text was cut."""
    c, n = as_col(c), F.lit(n)
    return F.when(F.length(c) > n, F.concat(F.left(c, n), F.lit(marker))).otherwise(c)


def truncate_at_newline(c: Column | str, n: Column | int, marker: str = DIFF_MARKER) -> Column:
    """Cut at the last newline at or before position ``n``; with none, cut at ``n``."""
    c, n = as_col(c), F.lit(n)
    head = F.left(c, n + 1)
    # text after the last newline of ``head``; the whole head when there is none
    tail = F.substring_index(head, "\n", -1)
    kept = F.when(F.contains(head, F.lit("\n")), F.left(head, n - F.length(tail))).otherwise(
        F.left(c, n)
    )
    return F.when(F.length(c) > n, F.concat(kept, F.lit(marker))).otherwise(c)


def strip_fences(c: Column | str) -> Column:
    """Remove Markdown fence lines and trim."""
    return trim_space(F.regexp_replace(as_col(c), FENCE_PATTERN, ""))


def is_comment_line(c: Column | str) -> Column:
    return F.rlike(as_col(c), F.lit(js_space(COMMENT_PATTERN)))


# Fixed values: (pattern, replacement) pairs that mask secret settings.
REDACTIONS = [
    (r"(?m)SECRET_KEY\s*=.*$", "SECRET_KEY = <redacted>"),
    (r":[^:@]+@", ":***@"),
]


def redact(c: Column | str, rules: list[tuple[str, str]] = REDACTIONS) -> Column:
    out = as_col(c)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def sections_text(*sections: Column | str) -> Column:
    """Join the non-empty sections, in the given order, with blank lines."""
    parts = [empty_to_null(s) for s in sections]
    return F.array_join(F.array(*parts), "\n\n")


def match_position(c: Column | str, pattern: str) -> Column:
    """0-based code-point position of the first match (defined only where it matches)."""
    return F.length(F.split(as_col(c), pattern, 2)[0])


def holds_any(c: Column | str, literals: Iterable[str]) -> Column:
    """True where the text holds any of the literals."""
    c, test = as_col(c), F.lit(False)
    for word in literals:
        test = test | F.contains(c, F.lit(word))
    return test


def _prefix_tree(words: set[tuple[str, ...]]) -> str:
    if () in words:  # a word that is the start of others stands for them
        return ""
    rests: dict[str, set[tuple[str, ...]]] = {}
    for first, *rest in words:
        rests.setdefault(first, set()).add(tuple(rest))
    parts = [first + _prefix_tree(rest) for first, rest in sorted(rests.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def any_of(literals: Iterable[str], any_case: Iterable[str] = ()) -> str:
    """A pattern that finds any of the literals in one pass; letters of ``any_case``, given in lower case, stand in either case.

    The literals form a prefix tree, and a look at the next character passes over most positions.
    """
    words = {tuple(re.escape(c) for c in w) for w in literals}
    words |= {tuple(f"[{c}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in w) for w in any_case}
    if () in words:
        return ""
    firsts = "".join(sorted({w[0][1:-1] if w[0].startswith("[") else w[0] for w in words}))
    return f"(?=[{firsts}]){_prefix_tree(words)}"
