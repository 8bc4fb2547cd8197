"""Column tests, expectations, freshness and profiling."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.operators.skew import running_sums
from winnow.sources.generations import delete_path, move_path


def null_failures(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def duplicate_failures(df: DataFrame, columns: list[str]) -> DataFrame:
    """Duplicated keys with their counts; null keys are not duplicates."""
    present = df.na.drop(subset=columns)
    return present.groupBy(*columns).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def value_failures(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is outside the list; nulls pass."""
    return df.filter(~F.col(column).isin(*values))


def orphan_failures(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; null keys pass."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


class ColumnTest(NamedTuple):
    """One test of a suite: a name and the condition a failing row meets."""

    name: str
    fails: Column


def run_tests(
    row_tests: list[tuple[DataFrame, list[ColumnTest]]], set_tests: dict[str, DataFrame]
) -> DataFrame:
    """One row per test: name, failures and pass or fail.

    All row-level tests of one table share a single scan. ``set_tests`` maps a
    name to a query that returns failing rows (duplicates, orphans, singular).
    """
    parts = []
    for df, tests in row_tests:
        counted = df.agg(*[F.count_if(t.fails).alias(t.name) for t in tests])
        pairs = F.array(
            *[F.struct(F.lit(t.name).alias("test"), F.col(t.name).alias("failures")) for t in tests]
        )
        parts.append(counted.select(F.inline(pairs)))
    for name, failing in set_tests.items():
        parts.append(failing.agg(F.count("*").alias("failures")).select(F.lit(name).alias("test"), "failures"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("failures") == 0, "pass").otherwise("fail"))


def source_freshness(df: DataFrame, ts: str, now: Column, warn: str, error: str) -> DataFrame:
    """Age of the newest row against two intervals at a given time."""
    newest = df.agg(F.max(ts).alias("newest"))
    status = (
        F.when(F.col("newest").isNull(), "error")
        .when(F.col("newest") < now - F.expr(f"INTERVAL {error}"), "error")
        .when(F.col("newest") < now - F.expr(f"INTERVAL {warn}"), "warn")
        .otherwise("pass")
    )
    return newest.withColumn("status", status)


def expectations(df: DataFrame, rules: dict[str, Column], mode: str = "keep") -> DataFrame:
    """Apply named row expectations.

    ``keep`` adds one flag per rule, ``drop`` removes violating rows, ``fail``
    stops the job if any row of the input violates a rule, whatever is selected later.
    """
    checks = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    if mode == "keep":
        return df.withColumns({f"ok_{n}": c for n, c in checks.items()})
    if mode == "drop":
        for c in checks.values():
            df = df.filter(c)
        return df
    if mode == "fail":
        # a scalar subquery over the whole input, which no later filter can prune
        bad = df.agg(*[F.count_if(~c).alias(n) for n, c in checks.items()])
        verdict = F.lit(True)
        for name in checks:
            stop = F.raise_error(F.lit(f"expectation failed: {name}")).cast("boolean")
            verdict = F.when(F.col(f"`{name}`") > 0, stop).otherwise(verdict)
        return df.filter(bad.select(verdict).scalar())
    raise ValueError(f"unknown mode {mode!r}")


class ExpectationError(ValueError):
    """Rows that violate an expectation, by its name."""

    def __init__(self, failed: dict[str, int]):
        super().__init__(", ".join(f"expectation failed: {n} ({k} rows)" for n, k in failed.items()))
        self.failed = failed


def write_expected(df: DataFrame, path: str, rules: dict[str, Column]) -> dict[str, int]:
    """Write rows as Parquet to a new ``path`` if every one meets every rule; the number of rows and of failures.

    Rows are counted while they are written, to a folder beside ``path``, so the input is read once; the folder then becomes
    ``path`` or, after a violation, goes, and ``ExpectationError`` tells the counts. A null is a violation.
    """
    spark = df.sparkSession
    seen = Observation(f"expectations-{uuid.uuid4().hex}")
    failures = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"failed_{i}") for i, rule in enumerate(rules.values())]
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.observe(seen, F.count("*").alias("n_rows"), *failures).write.parquet(staged)
    counts = {name: seen.get[f"failed_{i}"] for i, name in enumerate(rules)}
    failed = {n: k for n, k in counts.items() if k}
    if failed:
        delete_path(spark, staged)
        raise ExpectationError(failed)
    move_path(spark, staged, path)
    return {"n_rows": seen.get["n_rows"], **counts}


def expectation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that pass and fail each rule, from one scan."""
    tests = [ColumnTest(n, ~F.coalesce(c, F.lit(False))) for n, c in rules.items()]
    counted = df.agg(F.count("*").alias("_all"), *[F.count_if(t.fails).alias(t.name) for t in tests])
    rows = F.array(
        *[
            F.struct(
                F.lit(t.name).alias("expectation"),
                (F.col("_all") - F.col(t.name)).alias("passed"),
                F.col(t.name).alias("failed"),
            )
            for t in tests
        ]
    )
    return counted.select(F.inline(rows))


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``column`` values per ``row``; listing the values avoids an extra job."""
    counted = df.groupBy(row).pivot(column, values).count()
    return counted.na.fill(0)


def date_spine(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Row count for every day from ``start`` to ``end``, zero where there is none."""
    spark = df.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    counted = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return days.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def profile_columns(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """One row per column: rows, nulls, null share, and range, mean and deviation for numbers."""
    aggs = [F.count("*").alias("_rows")]
    for c in numeric + text:
        aggs.append(F.count(c).alias(f"{c}__n"))
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__sd"),
        ]
    one = df.agg(*aggs)

    def row(c: str) -> Column:
        stats = (
            [F.col(f"{c}__{s}") for s in ("min", "max", "mean", "sd")]
            if c in numeric
            else [F.lit(None).cast("double")] * 4
        )
        nulls = F.col("_rows") - F.col(f"{c}__n")
        return F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("n_rows"),
            nulls.alias("n_null"),
            F.round(100.0 * nulls / F.nullif(F.col("_rows"), F.lit(0)), 4).alias("null_pct"),
            *[s.alias(n) for s, n in zip(stats, ("min", "max", "mean", "stddev"))],
        )

    return one.select(F.inline(F.array(*[row(c) for c in numeric + text])))


def category_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values with their counts."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(k)


def correlations(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of every pair of columns, from one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = [
        F.struct(
            F.lit(a).alias("left_column"),
            F.lit(b).alias("right_column"),
            F.round(F.col(f"{a}__{b}"), digits).alias("corr"),
        )
        for a, b in pairs
    ]
    return one.select(F.inline(F.array(*rows)))


SKETCH_ACCURACY = 100_000
BRACKET_BLOCKS = 256


def exact_quantiles(
    df: DataFrame, column: str, fractions: list[float], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Exact discrete quantiles without sorting the table.

    A sketch whose rank error is at most 1 in ``accuracy`` brackets each
    quantile between two values. Rows below a bracket are only counted; the few
    rows inside it are grouped by value and ranked exactly.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    margin = 2.0 / accuracy
    low = [max(f - margin, 0.0) for f in fractions]
    high = [min(f + margin, 1.0) for f in fractions]
    bracket = values.agg(
        F.struct(
            F.percentile_approx("v", low, accuracy).alias("low"),
            F.percentile_approx("v", high, accuracy).alias("high"),
        )
    ).scalar()
    placed = values.withColumn("b", bracket)
    n = range(len(fractions))
    counted = placed.agg(
        F.struct(
            F.count("*").alias("total"),
            F.array(*[F.count_if(F.col("v") < F.col("b.low")[i]) for i in n]).alias("below"),
        )
    ).scalar()

    def inside(i: int) -> Column:
        return F.col("v").between(F.col("b.low")[i], F.col("b.high")[i])

    any_inside = F.lit(False)
    for i in n:
        any_inside = any_inside | inside(i)
    tagged = F.array(*[F.when(inside(i), F.lit(i)) for i in n])
    grouped = (
        placed.filter(any_inside)
        .select("v", F.explode(tagged).alias("i"))
        .filter(F.col("i").isNotNull())
        .groupBy("i", "v")
        .agg(F.count("*").alias("n"))
        .withColumn("c", counted)
    )
    q = F.array(*[F.lit(float(f)) for f in fractions])[F.col("i")]
    rank = F.greatest(F.ceil(q * F.col("c.total")), F.lit(1))
    # ranked in blocks of the bracket, so that no task holds all of its values
    at = F.unix_date if isinstance(values.schema["v"].dataType, T.DateType) else lambda c: c.cast("double")
    grouped = grouped.withColumn("b", bracket)
    low_end, high_end = at(F.col("b.low")[F.col("i")]), at(F.col("b.high")[F.col("i")])
    part = F.floor((at(F.col("v")) - low_end) / F.nullif(high_end - low_end, F.lit(0)) * BRACKET_BLOCKS)
    summed = running_sums(grouped, ["i"], ["v"], {"upto": F.col("n")}, F.coalesce(part, F.lit(0)))
    reached = summed.withColumn("reached", F.col("c.below")[F.col("i")] + F.col("upto"))
    return reached.filter(
        (F.col("reached") >= rank) & (F.col("reached") - F.col("n") < rank)
    ).select(q.alias("q"), F.col("v").alias("value"))
