"""Load patterns: append, upsert, partition overwrite, history, keys, changelog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: stands for null inside a surrogate key.
NULL_KEY = "_dbt_utils_surrogate_key_null_"

# Commit type to changelog section.
CHANGELOG_SECTIONS = {"feat": "Features", "fix": "Bug Fixes", "chore": "Chores"}
COMMIT_PATTERN = r"^(\w+)(\(([^)]*)\))?(!)?:"


# Fixed value: earlier than any time a table holds; stands in for an empty target.
BEFORE_ALL = "-9999-01-01 00:00:00"


def new_rows(target: DataFrame, source: DataFrame, ts: str) -> DataFrame:
    """Source rows newer than the newest target row (all rows when the target is empty).

    The newest time is a scalar subquery compared alone, so it reaches the
    source scan as a pushed filter. Rows without a time are not new.
    """
    nothing = F.lit(BEFORE_ALL).cast(target.schema[ts].dataType)
    return source.filter(F.col(ts) > target.agg(F.coalesce(F.max(ts), nothing)).scalar())


def incremental_append(target: DataFrame, source: DataFrame, ts: str) -> DataFrame:
    return target.unionByName(new_rows(target, source, ts))


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows updated or extended by the source rows; a key twice in the source is an error."""
    twice = source.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("_n"))
    stop = F.raise_error(F.lit("merge: several source rows have the same key")).cast("boolean")
    # the check is a scalar subquery, so it runs whatever is filtered later
    unique = twice.select(F.when(F.col("_n") > 1, stop).otherwise(F.lit(True))).scalar()
    source = source.filter(unique)
    untouched = target.join(source.select(*keys), keys, "left_anti")
    return untouched.unionByName(source)


def insert_overwrite(target: DataFrame, source: DataFrame, partition: str) -> DataFrame:
    """Target with every partition that occurs in the source replaced by it."""
    replaced = source.select(F.col(partition).alias("_replaced")).distinct()
    same = F.col(partition).eqNullSafe(F.col("_replaced"))  # null is a partition too
    return target.join(replaced, same, "left_anti").unionByName(source)


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Write only the partitions present in ``df``; others at ``path`` stay.

    Rows are gathered by partition first, so that a partition is not scattered
    over one small file per task; adaptive execution splits the large ones.
    """
    (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def _differs(old: str, new: str, updated_at: str, check_columns: list[str] | None) -> Column:
    """Whether the newer of two rows of a key is a change."""
    if not check_columns:
        return F.coalesce(F.col(f"{new}.{updated_at}") > F.col(f"{old}.{updated_at}"), F.lit(False))
    test = F.lit(False)
    for c in check_columns:
        test = test | ~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    return test


def changed_open_rows(
    history: DataFrame, current: DataFrame, key: str, updated_at: str, check_columns: list[str] | None, *keep: str
) -> DataFrame:
    """``key``, the ``keep`` columns and ``changed`` of every open row of a key that the snapshot holds."""
    old = history.filter(F.col("valid_to").isNull()).alias("o")
    both = old.join(current.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    return both.select(f"o.{key}", *[f"o.{c}" for c in keep], _differs("o", "n", updated_at, check_columns).alias("changed"))


def scd2_snapshot(
    history: DataFrame,
    current: DataFrame,
    key: str,
    updated_at: str,
    check_columns: list[str] | None = None,
) -> DataFrame:
    """Type-2 history after one more snapshot.

    ``history`` has the columns of ``current`` plus valid_from and valid_to.
    Timestamp strategy: a newer ``updated_at`` is a change; check strategy: any
    difference in ``check_columns``. A changed key closes its open row and
    opens a new one; a new key opens a row; a vanished key stays open.
    """
    columns = current.columns
    closed = history.filter(F.col("valid_to").isNotNull())
    old = history.filter(F.col("valid_to").isNull()).withColumn("_there", F.lit(True)).alias("o")
    new = current.withColumn("_there", F.lit(True)).alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    # a null key matches nothing but is a row all the same
    in_old, in_new = F.col("o._there").isNotNull(), F.col("n._there").isNotNull()
    changed = in_old & in_new & _differs("o", "n", updated_at, check_columns)

    def side(prefix: str, valid_from: Column, valid_to: Column) -> Column:
        return F.struct(
            *[F.col(f"{prefix}.{c}").alias(c) for c in columns],
            valid_from.alias("valid_from"),
            valid_to.alias("valid_to"),
        )

    start = F.col(f"n.{updated_at}")
    never = F.lit(None).cast(history.schema["valid_to"].dataType)
    kept = F.when(
        in_old, side("o", F.col("o.valid_from"), F.when(changed, start).otherwise(never))
    )
    opened = F.when(~in_old | changed, side("n", start, never))
    rows = both.select(F.explode(F.array_compact(F.array(kept, opened))).alias("r")).select("r.*")
    return closed.unionByName(rows)


def surrogate_key(*columns: Column | str) -> Column:
    """Hash of the columns as text, with a marker in place of nulls."""
    texts = [
        F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_KEY))
        for c in columns
    ]
    return F.md5(F.concat_ws("-", *texts))


def commit_fields(subject: Column | str) -> dict[str, Column]:
    """Type, scope and breaking mark of a conventional commit subject."""
    s = F.col(subject) if isinstance(subject, str) else subject
    return {
        "type": F.nullif(F.regexp_extract(s, COMMIT_PATTERN, 1), F.lit("")),
        "scope": F.nullif(F.regexp_extract(s, COMMIT_PATTERN, 3), F.lit("")),
        "breaking": F.regexp_extract(s, COMMIT_PATTERN, 4) == "!",
    }


def changelog(commits: DataFrame, subject: str = "subject") -> DataFrame:
    """Commits with their changelog section; merge commits are left out."""
    section = F.lit("Other")
    for kind, title in CHANGELOG_SECTIONS.items():
        section = F.when(F.col("type") == kind, title).otherwise(section)
    return (
        commits.filter(~F.startswith(subject, F.lit("Merge ")))
        .withColumns(commit_fields(subject))
        .withColumn("section", section)
    )


def changelog_groups(commits: DataFrame, subject: str = "subject") -> DataFrame:
    """Commits and breaking changes per changelog section and scope."""
    return changelog(commits, subject).groupBy("section", "scope").agg(
        F.count("*").alias("n_commits"), F.count_if("breaking").alias("n_breaking")
    )
