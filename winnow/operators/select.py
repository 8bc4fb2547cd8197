"""Budgets, newest-first selection, top-k reports and state per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.labels import is_failed, severity_rank
from winnow.functions.text import truncate_at_newline, truncate_text
from winnow.operators.skew import broadcast_rows, newest_rows, running_sums, top_per_key

# Budgets, shares and caps.
MESSAGE_BUDGET = 48_000
CONTEXT_BUDGET = 24_000
ACTIVE_SHARE = 0.50
RELATED_SHARE = 0.25
DIFF_SHARE = 0.10
ERROR_SHARE = 0.05
CHARS_PER_ERROR = 80
MIN_ERRORS = 3
HISTORY_KEPT = 40
HISTORY_SHOWN = 20

TURNS_PER_BLOCK = 16_384


def window_messages(conversations: DataFrame, budget: int = MESSAGE_BUDGET) -> DataFrame:
    """Newest messages of each conversation whose running length stays within the budget.

    The newest message always stays. Lengths are never negative, so the first
    message over the budget ends the selection for all older ones. Whole blocks
    of turns behind the budget are dropped before any row is sorted.
    """
    used = running_sums(
        conversations,
        ["conv_id"],
        ["turn"],
        {"running": F.length("text").cast("bigint"), "newer": F.lit(1)},
        F.floor(F.col("turn") / TURNS_PER_BLOCK),
        descending=True,
        only_blocks=F.col("before_running") <= budget,
    )
    return used.filter((F.col("running") <= budget) | (F.col("newer") == 1)).drop("newer")


def last_n(conversations: DataFrame, n: int = HISTORY_KEPT) -> DataFrame:
    """The last ``n`` messages of each conversation."""
    return top_per_key(conversations, ["conv_id"], [F.desc("turn")], n).drop("rank")


def error_cap(total: int = CONTEXT_BUDGET) -> int:
    return max(MIN_ERRORS, int(total * ERROR_SHARE / CHARS_PER_ERROR))


def cap_errors(errors: DataFrame, order: list[Column], total: int = CONTEXT_BUDGET) -> DataFrame:
    """The first errors that fit the error share of the budget."""
    return errors.orderBy(*order).limit(error_cap(total))


def allocate_budget(parts: DataFrame, total: int = CONTEXT_BUDGET) -> DataFrame:
    """Cut every section of a context to its share of the budget.

    ``parts``: ctx, kind (active, related, diff or other), path, content. Half
    goes to the active file, a quarter is split evenly over related files, a
    tenth goes to the diff, which is cut at a line end. Markers come on top.
    """
    related = (
        parts.filter(F.col("kind") == "related").groupBy("ctx").agg(F.count("*").alias("_n"))
    )
    shares = parts.join(related, "ctx", "left")
    active = F.lit(int(total * ACTIVE_SHARE))
    each = F.floor(F.lit(total * RELATED_SHARE) / F.col("_n")).cast("int")
    diff = F.lit(int(total * DIFF_SHARE))
    cut = (
        F.when(F.col("kind") == "active", truncate_text("content", active))
        .when(F.col("kind") == "related", truncate_text("content", each))
        .when(F.col("kind") == "diff", truncate_at_newline("content", diff))
        .otherwise(F.col("content"))
    )
    return shares.withColumn("content", cut).drop("_n")


def latest_run_per_job(
    jobs: DataFrame, runs: DataFrame, first_jobs: int | None = None, none_label: str = "NO_RUNS"
) -> DataFrame:
    """State of the newest run of each job, ``NO_RUNS`` where there is none.

    ``jobs``: job_id. ``runs``: job_id, run_id, started, state. With
    ``first_jobs`` only that many jobs by id are reported, and their short list
    filters the runs before they are aggregated.
    """
    if first_jobs is not None:
        jobs = jobs.orderBy("job_id").limit(first_jobs)
        runs = runs.join(broadcast_rows(jobs.select("job_id"), first_jobs), "job_id", "left_semi")
    latest = newest_rows(runs, "job_id", "started", "run_id", "state").drop("n")
    return jobs.join(latest, "job_id", "left").withColumn(
        "state", F.coalesce("state", F.lit(none_label))
    )


def recent_errors(
    functions: DataFrame,
    logs: DataFrame,
    first_functions: int | None = None,
    per_function: int = 2,
    limit: int | None = None,
) -> DataFrame:
    """For the (first) functions: their newest messages, cut only if ``limit`` is given.

    ``functions``: name. ``logs``: log_id, ts, name, message.
    """
    few = functions.select("name")
    if first_functions is not None:
        few = broadcast_rows(few.orderBy("name").limit(first_functions), first_functions)
    wanted = logs.join(few, "name", "left_semi")
    newest = top_per_key(wanted, ["name"], [F.desc("ts"), F.desc("log_id")], per_function)
    return newest if limit is None else newest.withColumn("message", F.left("message", F.lit(limit)))


def recent_failures(runs: DataFrame, fetch: int = 20, keep: int = 3) -> DataFrame:
    """Of the newest ``fetch`` runs the failed ones, at most ``keep``. Limit, filter, limit."""
    newest = [F.desc("started"), F.desc("run_id")]
    fetched = runs.orderBy(*newest).limit(fetch)
    return fetched.filter(is_failed("state")).orderBy(*newest).limit(keep)


def failed_runs(runs: DataFrame, state: str = "state", error: str | None = None) -> DataFrame:
    return runs.filter(is_failed(state, error))


def problem_or_all(df: DataFrame, problem: Column) -> DataFrame:
    """Rows with the problem, or all rows when none has it.

    The test is one aggregate read back as a scalar, not a global window.
    """
    found = df.agg(F.coalesce(F.bool_or(problem), F.lit(False)).alias("any"))
    return df.filter(problem | ~found.scalar())


def topk_with_overflow(df: DataFrame, label: Column, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` labels and one ``... and N more`` line when there are more."""
    shown = df.orderBy(*order).limit(k).select(F.lit(0).alias("part"), label.alias("label"))
    rest = (
        df.agg((F.count("*") - k).alias("more"))
        .filter(F.col("more") > 0)
        .select(
            F.lit(1).alias("part"),
            F.concat(F.lit("... and "), F.col("more").cast("string"), F.lit(" more")).alias("label"),
        )
    )
    return shown.unionByName(rest)


def sort_objects(objects: DataFrame, is_dir: Column, name: str) -> DataFrame:
    """Directories first, then by name in byte order."""
    return objects.orderBy(is_dir.desc(), name)


def filter_logs(logs: DataFrame, pattern: str, start: Column | None = None, limit: int | None = None) -> DataFrame:
    """Log rows that contain a text, from a start time, oldest first.

    ``logs``: log_id, ts, message.
    """
    kept = logs.filter(F.contains("message", F.lit(pattern)))
    if start is not None:
        kept = kept.filter(F.col("ts") >= start)
    if limit is None:
        return kept
    return kept.orderBy("ts", "log_id").limit(limit)


def filter_logs_by_severity(logs: DataFrame, minimum: str, resource: str, n: int | None = 50) -> DataFrame:
    """Newest ``n`` (or all) rows of a resource type at or above a severity."""
    kept = logs.filter(
        (F.col("resource") == resource) & (severity_rank("severity") >= severity_rank(F.lit(minimum)))
    )
    return kept if n is None else kept.orderBy(F.desc("ts"), F.desc("log_id")).limit(n)


def lookahead_match(
    files: DataFrame, pattern: str, ahead: str, n: int, group: int = 1, content: str = "content"
) -> DataFrame:
    """For each line that matches, the first match of ``ahead`` in the next ``n`` lines.

    Lines are looked up by their number inside the row that holds the file, and only those that match leave it,
    so no window and no shuffle is needed and no line is copied, however long a file is.
    """
    keep = [c for c in files.columns if c != content]

    def found(i: Column) -> Column:
        after = (F.coalesce(F.get("_lines", i + k), F.lit("")) for k in range(1, n + 1))
        return F.coalesce(*[F.nullif(F.regexp_extract(line, ahead, group), F.lit("")) for line in after])

    def hit(line: Column, i: Column) -> Column:
        own = F.struct(i.alias("line_no"), line.alias("line"), found(i).alias("found"))
        return F.when(F.rlike(line, F.lit(pattern)), own)

    lines = files.select(*keep, F.split(content, "\n").alias("_lines"))
    return lines.select(*keep, F.inline(F.array_compact(F.transform("_lines", hit))))
