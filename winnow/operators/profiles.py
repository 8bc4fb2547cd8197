"""Column profiles that are kept per part of a table and merged: a new day costs that day only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch, as a power of two: its standard error is about 1.04 / sqrt(2 ** 12), 1.6 %.
DISTINCT_BITS = 12
#: Size of a quantile sketch: ranks are within about 0.7 % in 99 of 100 cases.
QUANTILE_K = 400


def part_profiles(df: DataFrame, part: Column, numeric: list[str], text: list[str]) -> DataFrame:
    """``part, column, n_rows, n_null, min, max, sum, distinct_sketch, quantile_sketch`` of each part and column, from one scan.

    Numbers have all of these; of texts only rows, nulls and the distinct sketch are kept. Both sketches are of bounded size whatever
    the part holds, and combine map-side. Null is no distinct value; NaN counts as a value above all others.
    """
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(numeric + text):
        value = F.col(f"`{c}`")
        aggs += [F.count(value).alias(f"n{i}"), F.hll_sketch_agg(value.cast("string"), F.lit(DISTINCT_BITS)).alias(f"d{i}")]
        if c in numeric:
            x = value.cast("double")
            aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.sum(x).alias(f"s{i}")]
            aggs.append(F.kll_sketch_agg_double(x, F.lit(QUANTILE_K)).alias(f"q{i}"))
    grouped = df.groupBy(part.alias("part")).agg(*aggs)

    def row(i: int, c: str) -> Column:
        number = c in numeric
        none = F.lit(None)
        return F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("n_rows"),
            (F.col("_rows") - F.col(f"n{i}")).alias("n_null"),
            *[(F.col(f"{k}{i}") if number else none.cast("double")).alias(n) for k, n in (("lo", "min"), ("hi", "max"), ("s", "sum"))],
            F.col(f"d{i}").alias("distinct_sketch"),
            (F.col(f"q{i}") if number else none.cast("binary")).alias("quantile_sketch"),
        )

    return grouped.select("part", F.inline(F.array(*[row(i, c) for i, c in enumerate(numeric + text)])))


def merge_profiles(parts: DataFrame, fractions: list[float] | None = None) -> DataFrame:
    """``column, n_rows, n_null, min, max, mean, n_distinct, quantiles, quantile_sketch`` over some stored parts.

    Rows, nulls, least and greatest value are exact, ``n_distinct`` and ``quantiles`` (at ``fractions``, quartiles by
    default) within the errors of their sketches. Only the stored rows are read.
    """
    fractions = fractions or [0.25, 0.5, 0.75]
    merged = parts.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_null")],
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("sum").alias("_sum"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )
    values = F.col("n_rows") - F.col("n_null")
    some = F.col("quantile_sketch").isNotNull() & (values > 0) & F.col("min").isNotNull()
    quantiles = F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.array(*[F.lit(float(f)) for f in fractions])))
    return merged.select(
        "column",
        "n_rows",
        "n_null",
        "min",
        "max",
        (F.col("_sum") / F.nullif(values, F.lit(0))).alias("mean"),
        "n_distinct",
        quantiles.alias("quantiles"),
        F.when(some, F.col("quantile_sketch")).alias("quantile_sketch"),
    )


def histogram(profile: DataFrame, edges: list[float]) -> DataFrame:
    """``column, low, high, share`` of the values between neighbouring ``edges`` (high included), from merged sketches."""
    ranks = F.kll_sketch_get_rank_double("quantile_sketch", F.array(*[F.lit(float(e)) for e in edges]))
    bins = F.array(
        *[
            F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), (F.col("_r")[i + 1] - F.col("_r")[i]).alias("share"))
            for i, (a, b) in enumerate(zip(edges, edges[1:]))
        ]
    )
    known = profile.where(F.col("quantile_sketch").isNotNull()).withColumn("_r", ranks)
    return known.select("column", F.inline(bins))
