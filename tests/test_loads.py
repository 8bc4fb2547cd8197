"""Loads that rewrite few files, observed writes, and profiles that merge."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from winnow.operators import load, profiles, quality, versioned
from winnow.sources import generations
from winnow.sources.scratch import scratch_dir

ROWS = "k long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, made, schema, purpose, by="k"):
    root = scratch_dir(spark, purpose)
    versioned.create_table(spark.createDataFrame(made, schema).repartitionByRange(10, by), root)
    return root


def test_a_merge_rewrites_only_files_with_a_key(spark):
    made = [(i, "old") for i in range(1000)] + [(None, "none")]
    root = table(spark, made, ROWS, "merge")
    before = generations.current_generation(spark, root)
    source = spark.createDataFrame([(5, "new"), (7, "new"), (950, "new"), (2000, "new"), (None, "new")], ROWS)
    done = versioned.merge_into(spark, root, source, ["k"])
    assert len(before.files) == 10 and len(done.rewritten) == 2 and len(done.kept) == 8
    assert set(done.kept) == set(before.files) & set(done.generation.files)  # not even read whole
    got = versioned.read_table(spark, root, ROWS)
    wanted = load.merge_upsert(spark.createDataFrame(made, ROWS), source, ["k"])
    assert rows(got) == rows(wanted)
    again = versioned.merge_into(spark, root, source.where("k = 2000"), ["k"])
    assert len(again.rewritten) == 1 and rows(versioned.read_table(spark, root, ROWS)) == rows(wanted)
    only_new = versioned.merge_into(spark, root, spark.createDataFrame([(3000, "x")], ROWS), ["k"])
    assert only_new.rewritten == []


def test_merge_into_nothing_and_a_merge_that_fails(spark):
    root = scratch_dir(spark, "merge-empty")
    source = spark.createDataFrame([(1, "a"), (2, "b")], ROWS)
    versioned.merge_into(spark, root, source, ["k"])
    assert rows(versioned.read_table(spark, root, ROWS)) == rows(source)
    before = generations.current_generation(spark, root)
    with pytest.raises(Exception, match="several source rows"):
        versioned.merge_into(spark, root, spark.createDataFrame([(1, "c"), (1, "d")], ROWS), ["k"])
    assert generations.current_generation(spark, root) == before and rows(versioned.read_table(spark, root, ROWS)) == rows(source)


HISTORY = "k long, v string, at long, valid_from long, valid_to long"


@pytest.mark.parametrize("check", [None, ["v"]])
def test_a_snapshot_rewrites_only_files_with_a_change(spark, check):
    made = [(i, "a", 1, 1, None) for i in range(500)] + [(i, "z", 0, 0, 1) for i in range(0, 500, 3)] + [(None, "n", 1, 1, None)]
    root = table(spark, made, HISTORY, "history")
    current = [(i, "a", 1) for i in range(20, 500)] + [(3, "b", 9), (4, "b", 9), (600, "c", 9), (None, "n", 9)]
    current = spark.createDataFrame(current, "k long, v string, at long")
    done = versioned.snapshot_into(spark, root, current, HISTORY, "k", "at", check)
    assert len(done.rewritten) == 1 and len(done.kept) == 9
    wanted = load.scd2_snapshot(spark.createDataFrame(made, HISTORY), current, "k", "at", check)
    assert rows(versioned.read_table(spark, root, HISTORY)) == rows(wanted)


def test_first_snapshot(spark):
    root = scratch_dir(spark, "history-empty")
    current = spark.createDataFrame([(1, "a", 5)], "k long, v string, at long")
    schema = spark.createDataFrame([], HISTORY).schema
    versioned.snapshot_into(spark, root, current, schema, "k", "at")
    assert rows(versioned.read_table(spark, root, schema)) == [(1, "a", 5, 5, None)]


def test_a_violation_leaves_no_output(spark):
    path = scratch_dir(spark, "expected")
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (None, "d")], ROWS).repartition(3)
    rules = {"key": F.col("k").isNotNull(), "text": F.length("v") == 1, "any": F.lit(True)}
    with pytest.raises(quality.ExpectationError) as e:
        quality.write_expected(df, path, rules)
    assert e.value.failed == {"key": 1, "text": 1}
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
    assert generations.folders(spark, path.rsplit("/", 1)[0]) == [
        f for f in generations.folders(spark, path.rsplit("/", 1)[0]) if not f.startswith(path.rsplit("/", 1)[1])
    ]
    good = df.where("k IS NOT NULL AND v IS NOT NULL")
    assert quality.write_expected(good, path, rules) == {"n_rows": 2, "key": 0, "text": 0, "any": 0}
    assert rows(spark.read.parquet(path)) == rows(good)


def test_an_observed_write_reads_its_input_once(spark):
    folder = scratch_dir(spark, "observed")
    spark.range(100).withColumn("v", F.lit("x")).write.parquet(f"{folder}/in")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(f"{folder}/in").mapInArrow(counted, "id long, v string")
    quality.write_expected(df, f"{folder}/out", {"id": F.col("id") >= 0})
    assert seen.value == 100
    assert quality.write_expected(df.where("id < 0"), f"{folder}/none", {"id": F.col("id") >= 0}) == {"n_rows": 0, "id": 0}


def test_profiles_merge(spark):
    rng = random.Random(6)
    made = [(f"d{i % 7}", rng.gauss(100, 30), rng.randrange(4000), rng.choice([None, "a", "b", str(rng.randrange(900))])) for i in range(20_000)]
    made += [("d7", None, None, None)]
    df = spark.createDataFrame(made, "day string, x double, n long, t string").repartition(4)
    parts = profiles.part_profiles(df, F.col("day"), ["x", "n"], ["t"])
    assert parts.count() == 8 * 3
    stored = scratch_dir(spark, "profiles")
    for day in ("d0", "d7", None):  # a day at a time, then the rest
        some = parts.where(F.col("part") == day) if day else parts.where("part NOT IN ('d0', 'd7')")
        some.write.mode("append").parquet(stored)
    found = {r.column: r for r in profiles.merge_profiles(spark.read.parquet(stored), [0.01, 0.5, 0.9]).collect()}
    for i, c in ((1, "x"), (2, "n")):
        values = sorted(r[i] for r in made if r[i] is not None)
        r = found[c]
        assert (r.n_rows, r.n_null, r.min, r.max) == (len(made), 1, values[0], values[-1])
        assert r.mean == pytest.approx(sum(values) / len(values))
        assert r.n_distinct == pytest.approx(len(set(values)), rel=0.05)
        for q, v in zip([0.01, 0.5, 0.9], r.quantiles):
            assert abs(sum(x <= v for x in values) / len(values) - q) < 0.015
    texts = [r[3] for r in made if r[3] is not None]
    assert (found["t"].n_rows, found["t"].n_null, found["t"].quantiles) == (len(made), len(made) - len(texts), None)
    assert found["t"].n_distinct == pytest.approx(len(set(texts)), rel=0.05)


def test_histogram(spark):
    df = spark.range(10_000).select(F.col("id").alias("x"), F.lit("all").alias("p"), F.lit(None).cast("double").alias("none"))
    merged = profiles.merge_profiles(profiles.part_profiles(df, F.col("p"), ["x", "none"], []))
    got = {(r.column, r.low): r.share for r in profiles.histogram(merged, [-1, 2500, 5000, 9999]).collect()}
    assert {k: round(v, 2) for k, v in got.items()} == {("x", -1.0): 0.25, ("x", 2500.0): 0.25, ("x", 5000.0): 0.5}
    empty = profiles.merge_profiles(profiles.part_profiles(df.where("false"), F.col("p"), ["x"], []))
    assert empty.count() == 0
