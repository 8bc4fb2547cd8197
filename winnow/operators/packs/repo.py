"""Version-control text that is already in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import trim_space

# Fixed values.
HASH_LENGTH = 40
UNKNOWN = "unknown"


def git_status_counts(lines: DataFrame, keys: list[str] | None = None, line: str = "line") -> DataFrame:
    """Untracked, staged and modified counts of porcelain status lines.

    One line counts as both staged and modified when both of its marks are set.
    """
    x, y = F.substring(line, 1, 1), F.substring(line, 2, 1)
    valid = F.length(line) >= 2
    untracked = (x == "?") & (y == "?")
    marked = lambda c: ~c.isin(" ", "?")
    return lines.filter(valid).groupBy(*(keys or [])).agg(
        F.count_if(untracked).alias("n_untracked"),
        F.count_if(~untracked & marked(x)).alias("n_staged"),
        F.count_if(~untracked & marked(y)).alias("n_modified"),
    )


def blame_fields(blames: DataFrame, text: str = "content") -> DataFrame:
    """Commit hash, author and summary of porcelain blame texts."""

    def line_value(key: str):
        found = F.regexp_extract(text, rf"(?m)^{key} (.*)$", 1)
        return F.when(F.rlike(text, F.lit(rf"(?m)^{key} ")), trim_space(found)).otherwise(UNKNOWN)

    keep = [c for c in blames.columns if c != text]
    return blames.select(
        *keep,
        F.left(text, F.lit(HASH_LENGTH)).alias("commit"),
        line_value("author").alias("author"),
        line_value("summary").alias("summary"),
    )


def recent_commits(log: DataFrame, n: int = 5, line: str = "line", order: str = "pos") -> DataFrame:
    """The first ``n`` log rows, blank ones dropped afterwards."""
    return log.orderBy(order).limit(n).filter(trim_space(line) != "")
