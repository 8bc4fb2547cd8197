"""Summaries of findings, errors, fleets and corpora. All aggregates combine map-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.skew import newest_rows, top_per_key


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts per category and, under category null, over all findings."""
    counts = [
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
    ]
    per_category = findings.groupBy("category").agg(*counts)
    # on its own, so that there is a total of zero without any finding
    total = findings.agg(*counts).select(F.lit(None).cast("string").alias("category"), "*")
    return per_category.unionByName(total)


def findings_rollup(findings: DataFrame, path: str = "path") -> DataFrame:
    """Counts per file and severity, per file, and over all; ``level`` tells which: 0, 1 or 3.

    One aggregate over grouping sets, combined map-side; subtotals have null in the columns they sum over, and their level
    tells them from findings without a path or severity.
    """
    return findings.rollup(path, "severity").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("n_findings"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1L, rule_id)"))).alias("n_rules"),
    )


def findings_by_file(findings: DataFrame, path: str = "path") -> DataFrame:
    """Per file with findings: their count and distinct categories."""
    return findings.groupBy(path).agg(
        F.count("*").alias("n_findings"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )


def findings_totals(by_file: DataFrame) -> DataFrame:
    """Grand totals over the per-file rows."""
    return by_file.agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("n_findings")
    )


def errors_by_function(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Per function: error count and its newest message, cut only if ``limit`` is given.

    ``logs``: log_id, ts, name, message. Times are aggregated first, messages are looked up afterwards.
    """
    named = logs.withColumn("name", F.coalesce("name", F.lit("unknown")))
    newest = newest_rows(named, "name", "ts", "log_id", "message")
    message = F.col("message") if limit is None else F.left("message", F.lit(limit))
    return newest.select("name", F.col("n").alias("n_errors"), message.alias("first_message"))


def fleet_status(fleet: DataFrame, state: str = "state", running: str = "RUNNING") -> DataFrame:
    return fleet.agg(
        F.count_if(F.col(state) == running).alias("n_running"), F.count("*").alias("n_total")
    )


def context_used(parts: DataFrame, text: str = "content", kind: str = "kind") -> DataFrame:
    """Characters used over all sections; contributed data is not counted."""
    counted = F.when(F.col(kind) != "plugin", F.length(text)).otherwise(F.lit(0))
    return parts.agg(F.coalesce(F.sum(counted), F.lit(0)).alias("used"))


def group_names(df: DataFrame, group: str, name: str, limit: int = 8) -> DataFrame:
    """The first ``limit`` names of each group, in name order, as one text."""
    few = top_per_key(df.select(group, name).distinct(), [group], [F.col(name)], limit)
    return few.groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names")
    )


def feature_flags(
    files: DataFrame, rules: dict[str, str], keys: list[str] | None = None, content: str = "content"
) -> DataFrame:
    """One boolean per feature: does its pattern occur anywhere in the corpus (or key)?"""
    flags = [
        F.coalesce(F.bool_or(F.rlike(content, F.lit(p))), F.lit(False)).alias(n)
        for n, p in rules.items()
    ]
    return files.groupBy(*(keys or [])).agg(*flags)


def items_total(df: DataFrame, items: str) -> DataFrame:
    """Sum of array sizes."""
    return df.agg(F.coalesce(F.sum(F.size(items)), F.lit(0)).alias("n_items"))


def inventory_counts(spark: SparkSession, kinds: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Row count per kind of resource; a kind that cannot be opened counts 0."""
    out = None
    for kind, load in kinds.items():
        try:
            counted = load().agg(F.count("*").alias("n"))
        except AnalysisException:
            counted = spark.range(0).agg(F.count("*").alias("n"))
        row = counted.select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out
