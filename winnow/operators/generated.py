"""Files inside generated text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.paths import resolve
from winnow.functions.text import all_groups, strip_fences, trim_space


class Style(NamedTuple):
    """How a file is marked: its header line, the body after it, and what ends the body."""

    head: str
    body: str
    closing: str
    # literal that every text with this style holds
    mark: str


# Header styles, tried in order, and the name of a headless file.
STYLES = [
    Style(r"#{1,3}\s+([\w./\-]+\.\w+)\s*\n+```[\w]*\n", r"(?s:.*?)```", "```", "```"),
    Style(
        r"(?:\/\/|#)\s+([\w./\-]+\.\w+)\s*\n",
        r"(?s:.*?)(?=^(?:\/\/|#)\s+[\w./\-]+\.\w+|\z)",
        "",
        ".",
    ),
    Style(r"={3}\s+([\w./\-]+\.\w+)\s*={3}\s*\n", r"(?s:.*?)(?=^={3}|\z)", "", "==="),
]
FALLBACK_NAME = "generated.txt"


def is_safe(resolved: Column, base: str) -> Column:
    """Is a resolved path the base folder or something below it?"""
    return (resolved == base) | F.startswith(resolved, F.lit(base + "/"))


def safe_paths(df: DataFrame, base: str, path: str = "path") -> DataFrame:
    """Rows whose path, resolved below ``base``, stays inside it; the path is resolved."""
    base = base.strip("/")
    inside = df.withColumn(path, resolve(F.concat(F.lit(base + "/"), F.col(path))))
    return inside.filter(is_safe(F.col(path), base))


def generated_files(
    df: DataFrame, base: str, keep: list[str], text: str = "text"
) -> DataFrame:
    """Files (path, content) held by a text.

    The first header style that yields a safe file wins: ``## name`` with a
    fence, ``// name`` or ``# name``, ``=== name ===``. Text without any header
    becomes one file; empty text gives none. A body runs to the next header.
    """
    base = base.strip("/")

    def safe_files(style: Style) -> Column:
        def one(m: Column) -> Column:
            name = F.regexp_extract(m, rf"\A{style.head}", 1)
            body = F.regexp_replace(m, rf"\A{style.head}", "")
            kept = F.left(body, F.length(body) - len(style.closing))
            return F.struct(
                resolve(F.concat(F.lit(base + "/"), name)).alias("path"),
                trim_space(kept).alias("content"),
            )

        # the long text is searched once; name and body are cut from each match
        found = F.transform(all_groups(text, f"(?m)^{style.head}{style.body}", 0), one)
        safe = F.filter(found, lambda f: is_safe(f["path"], base))
        return F.when(F.contains(text, F.lit(style.mark)), safe).otherwise(F.array())

    whole = F.array(
        F.struct(F.lit(f"{base}/{FALLBACK_NAME}").alias("path"), strip_fences(text).alias("content"))
    )
    # each style is only tried on texts where the styles before it found nothing
    found = df.withColumn("_files", safe_files(STYLES[0]))

    def unless_found(later: Column) -> Column:
        return F.when(F.size("_files") > 0, F.col("_files")).otherwise(later)

    for style in STYLES[1:]:
        found = found.withColumn("_files", unless_found(safe_files(style)))
    # exploding an expression, not a column, keeps Spark from filtering on a second copy of it
    rows = found.select(*keep, F.explode(unless_found(F.when(trim_space(text) != "", whole))).alias("f"))
    return rows.select(*keep, "f.path", "f.content")
