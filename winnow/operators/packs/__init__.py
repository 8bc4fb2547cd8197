"""Extraction packs: facts from configuration, notebook and source files.

Every pack takes ``files`` (path, content; some also ws) and returns facts as
rows. A pack filters by path first, by a cheap literal next, and only then runs
patterns, always on whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import all_groups


def matching(files: DataFrame, path_pattern: str, holds: str | None = None) -> DataFrame:
    """Files whose path matches and, if given, whose content holds a literal."""
    kept = files.filter(F.rlike("path", F.lit(path_pattern)))
    return kept.filter(F.contains("content", F.lit(holds))) if holds else kept


def extract(
    files: DataFrame, pattern: str, fields: dict[str, int], keep: tuple[str, ...] = ("path",)
) -> DataFrame:
    """One row per match with its 0-based position and the named groups (empty when absent).

    The long text is searched once for whole matches; the groups are then read
    from the short matches.
    """
    hits = files.select(*keep, F.posexplode(all_groups("content", pattern, 0)).alias("pos", "_m"))
    groups = [F.regexp_extract("_m", pattern, g).alias(n) for n, g in fields.items()]
    return hits.select(*keep, "pos", *groups)


def or_default(c: Column | str, default: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def first_existing(files: DataFrame, names: list[str], keys: tuple[str, ...] = ("ws",)) -> DataFrame:
    """Per workspace, the one file whose relative path comes first in ``names``."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path")).cast("int")
    found = files.select(*keys, "path", "content", order.alias("_order")).filter(F.col("path").isin(*names))
    # only ranks are aggregated; contents are never gathered
    best = found.groupBy(*keys).agg(F.min("_order").alias("_order"))
    return found.join(best, [*keys, "_order"], "left_semi").select(*keys, "path", "content")


def distinct_in_order(c: Column) -> Column:
    """Distinct items of an array in first-seen order (``array_distinct`` keeps it)."""
    return F.array_distinct(c)
