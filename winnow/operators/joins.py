"""Joins and set operations between files, jobs, runs, rules and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.paths import base_name, dir_name, resolve, short_name, stem
from winnow.functions.text import all_groups, holds_any
from winnow.operators.skew import numbered, top_per_key

# Import statement pattern and the suffixes tried in order.
IMPORT_PATTERN = r"""(?:import|require|from)\s+['"]([^'"]+)['"]"""
IMPORT_SUFFIXES = ["", ".ts", ".js", "/index.ts", "/index.js"]


#: Length of the pieces by which names are looked up; a shorter base name is a piece itself.
GRAM = 3


def _grams(text: str, sizes: Column) -> Column:
    """The distinct pieces of a text of some lengths, each with its length bounded by ``GRAM``."""

    def pieces(k: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(F.col(text), i, k))

    fitting = F.filter(sizes, lambda k: (k > 0) & (k <= F.length(text)))
    return F.array_distinct(F.flatten(F.transform(fitting, pieces)))


def sibling_candidates(names: DataFrame, base: DataFrame) -> DataFrame:
    """``dir, part, name, sibling``: the names of a directory that hold the rarest piece of a base name of it.

    ``names``: dir, name, sibling. ``base``: dir, part. A name offers its pieces of ``GRAM`` characters (and single ones or
    pairs where some base name is that short), so as many rows as it has characters. Every base name looks up one piece, that which the
    fewest names of its directory hold; all names that contain the base name are among them.
    """
    size = F.least(F.length("part"), F.lit(GRAM))
    # at most GRAM different lengths
    sizes = base.agg(F.collect_set(size).alias("sizes")).scalar()
    offered = names.withColumn("sizes", sizes).select(
        "dir", "name", "sibling", F.explode(_grams("name", F.col("sizes"))).alias("gram")
    )
    held = offered.groupBy("dir", "gram").agg(F.count("*").alias("n"))
    asked = base.distinct().select("dir", "part", F.explode(_grams("part", F.array(size))).alias("gram"))
    rarest = (
        asked.join(held, ["dir", "gram"])
        .groupBy("dir", "part")
        .agg(F.min(F.struct("n", "gram")).alias("r"))
        .select("dir", "part", F.col("r.gram").alias("gram"))
    )
    return rarest.join(offered, ["dir", "gram"]).drop("gram")


def siblings(files: DataFrame, limit: int = 5, path: str = "path") -> DataFrame:
    """Other files of the same directory whose name contains the base name.

    No pair of files is ever compared but those that share a rare piece of their names, and only ``limit + 1`` names
    are kept per (directory, base name).
    """
    names = files.select(
        F.col(path).alias("sibling"), dir_name(path).alias("dir"), base_name(path).alias("name")
    )
    base = files.select(F.col(path).alias("path"), dir_name(path).alias("dir"), stem(path).alias("part"))
    base = base.where("part <> ''")
    found = sibling_candidates(names, base.select("dir", "part")).where(F.contains("name", "part"))
    # one more than the limit: the file itself is dropped after the lookup
    offered = top_per_key(found, ["dir", "part"], [F.col("name"), F.col("sibling")], limit + 1).drop("rank")
    others = base.join(offered, ["dir", "part"]).filter(F.col("path") != F.col("sibling"))
    return top_per_key(others, ["path"], [F.col("name"), F.col("sibling")], limit).select("path", "sibling", "rank")


def import_targets(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files reached by relative imports; the first suffix that exists wins, no duplicates."""
    calls = (
        files.filter(holds_any(content, ["import", "require", "from"]))
        .select(
            F.col(path).alias("path"),
            F.posexplode(all_groups(content, IMPORT_PATTERN)).alias("pos", "spec"),
        )
        .filter(F.startswith("spec", F.lit(".")))
    )
    # the folder part is resolved once per import; a suffix only matters to resolving
    # when the import ends in a slash or in dots
    joined = F.concat(dir_name("path"), F.lit("/"), "spec")
    bare = F.rlike("spec", F.lit(r"(?:^|/)\.{0,2}$"))
    based = calls.withColumns({"joined": joined, "base": F.when(~bare, resolve(joined))})
    suffixes = F.array(*[F.lit(s) for s in IMPORT_SUFFIXES])
    tried = based.select("*", F.posexplode(suffixes).alias("suffix_no", "suffix")).select(
        "path",
        "pos",
        "suffix_no",
        F.coalesce(
            F.concat("base", "suffix"), F.when(bare, resolve(F.concat("joined", "suffix")))
        ).alias("target"),
    )
    known = files.select(resolve(path).alias("target"))
    hits = tried.join(known, "target", "left_semi")
    first = hits.groupBy("path", "pos").agg(F.min_by("target", "suffix_no").alias("target"))
    return first.groupBy("path", "target").agg(F.min("pos").alias("pos"))


def related_files(files: DataFrame, limit: int = 5) -> DataFrame:
    """Siblings first, then import targets for the free places, without repeats."""
    near = siblings(files, limit).select(
        "path", F.col("sibling").alias("related"), F.lit(0).alias("source"), F.col("rank").alias("pos")
    )
    linked = import_targets(files).select(
        "path", F.col("target").alias("related"), F.lit(1).alias("source"), "pos"
    )
    first = near.unionByName(linked).groupBy("path", "related").agg(
        F.min(F.struct("source", "pos")).alias("o")
    )
    ranked = top_per_key(
        first, ["path"], [F.col("o.source"), F.col("o.pos"), F.col("related")], limit
    )
    return ranked.select("path", "related", "rank")


def errors_with_config(errors: DataFrame, functions: DataFrame) -> DataFrame:
    """Error groups (``name``) with the config of their function, null when it is gone.

    Of functions that share a short name the first by resource counts.
    """
    named = functions.select(short_name("resource").alias("name"), "resource", "config")
    named = first_wins(named, "name", [F.col("resource")]).drop("resource")
    return errors.join(named, "name", "left")


def runs_with_job(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs with job name and task list; a missing job gives ``Job <id>`` and no tasks."""
    lines = F.transform(
        "tasks",
        lambda t: F.concat(
            F.lit("  - "),
            t["task_key"],
            F.coalesce(F.concat(F.lit(": "), t["description"]), F.lit("")),
        ),
    )
    listed = jobs.select("job_id", "job_name", F.array_join(lines, "\n").alias("task_text"))
    return runs.join(listed, "job_id", "left").withColumns(
        {
            "job_name": F.coalesce("job_name", F.concat(F.lit("Job "), F.col("job_id").cast("string"))),
            "task_text": F.coalesce("task_text", F.lit("  (no task details)")),
        }
    )


def key_types(keys: DataFrame, attributes: DataFrame) -> DataFrame:
    """Each key column with its attribute type, ``?`` when the attribute is not declared."""
    return keys.join(attributes, ["table_name", "attribute"], "left").withColumn(
        "attribute_type", F.coalesce("attribute_type", F.lit("?"))
    )


def drop_disabled(df: DataFrame, disabled: DataFrame, key: str = "id") -> DataFrame:
    return df.join(disabled.select(key), key, "left_anti")


def activation_diff(detected: DataFrame, active: DataFrame, key: str = "id") -> DataFrame:
    """``activated`` where detected only, ``deactivated`` where active only."""
    d = detected.select(key).distinct().withColumn("_d", F.lit(True))
    a = active.select(key).distinct().withColumn("_a", F.lit(True))
    change = F.when(F.col("_a").isNull(), "activated").when(F.col("_d").isNull(), "deactivated")
    return d.join(a, key, "full_outer").select(key, change.alias("change")).filter(
        F.col("change").isNotNull()
    )


def first_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per key in an explicit order; later duplicates are skipped."""
    return top_per_key(df, [key], order, 1).drop("rank")


def union_changes(staged: DataFrame, working: DataFrame, order: str, limit: int = 10) -> DataFrame:
    """Staged rows, then working rows, tagged; the first ``limit``."""
    both = staged.withColumn("stage", F.lit("staged")).unionByName(
        working.withColumn("stage", F.lit("unstaged"))
    )
    return both.orderBy("stage", order).limit(limit)


def distinct_ordered(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with the order key of their first sighting."""
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(value, *[F.col(f"first.{c}").alias(c) for c in order])


def exclude_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.filter(~F.col(column).isin(*values)).select(column).distinct()


def union_problems(
    functions: DataFrame, logs: DataFrame, first_functions: int | None = None, newest_logs: int = 3
) -> DataFrame:
    """Inactive ones among the (first) functions, then the newest error log rows.

    ``functions``: resource, state, updated. ``logs``: log_id, ts, name, message. All inactive functions are numbered
    in ranges of their order, a first few in one task.
    """
    if first_functions is not None:
        functions = functions.orderBy("resource").limit(first_functions)
    inactive = functions.filter(F.col("state") != "ACTIVE")
    if first_functions is None:
        placed = numbered(inactive, ["resource"], "pos")
    else:
        placed = inactive.withColumn("pos", F.row_number().over(_single("resource")))
    idle = placed.select(
        F.lit(0).alias("source"),
        F.col("pos").cast("int").alias("pos"),
        short_name("resource").alias("name"),
        F.concat(F.lit("Function state: "), "state").alias("error"),
        F.col("updated").alias("at"),
    )
    newest = logs.orderBy(F.desc("ts"), F.desc("log_id")).limit(newest_logs)
    errors = newest.select(
        F.lit(1).alias("source"),
        F.row_number().over(_single(F.desc("ts"), F.desc("log_id"))).alias("pos"),
        F.coalesce("name", F.lit("unknown")).alias("name"),
        F.col("message").alias("error"),
        F.col("ts").alias("at"),
    )
    return idle.unionByName(errors)


def _single(*order):
    """Window over a short branch: rows that are already limited."""
    return W.partitionBy(F.lit(0)).orderBy(*order)


def orphans(topics: DataFrame, subscriptions: DataFrame, key: str = "topic") -> DataFrame:
    """Topics without subscribers and subscriptions without a topic."""
    lonely = topics.join(subscriptions.select(key), key, "left_anti").select(
        F.lit("topic").alias("kind"), F.col("topic_name").alias("name")
    )
    dangling = subscriptions.join(topics.select(key), key, "left_anti").select(
        F.lit("subscription").alias("kind"), F.col("subscription_name").alias("name")
    )
    return lonely.unionByName(dangling)
