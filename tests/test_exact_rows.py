"""Rows are neither lost nor multiplied: nulls, repeats, empty inputs, deep folders, tables of several files."""

import pytest
from pyspark.sql import functions as F

from winnow.functions.text import js_space
from winnow.operators import aggregate, context, hooks, joins, load, quality, scan
from winnow.operators.packs.default_hooks import DEFAULT_HOOKS
from winnow.operators.skew import top_per_key
from winnow.plans.registry import load_all
from winnow.sources import files
from winnow.streaming import events as ev

TABLES = "/root/testdata/sf0.001"


def test_js_space_is_spelled_out():
    assert js_space(r"a\s+[\s\w]\S\\s") == "a[" + js_space(r"[\s]")[1:-1] + "]+[" + js_space(r"[\s]")[1:-1] + r"\w][^" + js_space(r"[\s]")[1:-1] + r"]\\s"
    with pytest.raises(ValueError):
        js_space(r"[\S]")


def test_unicode_space_in_rules(spark):
    text = "﻿# password = \"hidden\"\npassword = \"secret1\"\n　// pwd = 'x123'\n\u0085# pwd = 'next'"
    df = spark.createDataFrame([("a.py", text)], "path string, content string")
    # U+0085 is no white space in JavaScript, so its line is no comment
    assert [(r.line_no, r.rule_id) for r in scan.security_scan(df).collect()] == [(1, 1), (3, 1)]


def test_one_config_per_error(spark):
    errors = spark.createDataFrame([("f", 1), ("g", 2)], "name string, n int")
    functions = spark.createDataFrame([("p/b/f", "late"), ("p/a/f", "first")], "resource string, config string")
    assert sorted(map(tuple, joins.errors_with_config(errors, functions).collect())) == [("f", 1, "first"), ("g", 2, None)]


def test_history_keeps_null_keys(spark):
    history = spark.createDataFrame(
        [(None, 1, 1, None), (5, 1, 1, None)], "k int, u int, valid_from int, valid_to int"
    )
    current = spark.createDataFrame([(5, 2), (None, 3)], "k int, u int")
    got = sorted(map(tuple, load.scd2_snapshot(history, current, "k", "u").collect()), key=str)
    assert got == sorted([(None, 1, 1, None), (None, 3, 3, None), (5, 1, 1, 2), (5, 2, 2, None)], key=str)


def test_merge_refuses_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="same key"):
        load.merge_upsert(target, spark.createDataFrame([(1, "b"), (1, "c")], target.schema), ["k"]).filter("k = 7").collect()
    assert load.merge_upsert(target, target.limit(0), ["k"]).count() == 1


def test_fail_expectation_cannot_be_filtered_away(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    with pytest.raises(Exception, match="expectation failed: low"):
        quality.expectations(df, {"low": F.col("a") < 2}, "fail").filter("a = 1").collect()
    assert quality.expectations(df, {"low": F.col("a") < 3}, "fail").count() == 2


def test_total_row_without_findings(spark):
    empty = spark.createDataFrame([], "category string, severity string")
    assert list(map(tuple, aggregate.findings_summary(empty).collect())) == [(None, 0, 0, 0, 0)]


def test_one_file_per_path(spark, tmp_path):
    rows = [("a", "1", 1), ("a", "0", 2), ("b", "x", 1), ("b", "x", 1)]
    files.write_files(spark.createDataFrame(rows, "path string, content string, version int"), str(tmp_path / "s"), order="version")
    assert sorted(map(tuple, files.read_files(spark, str(tmp_path / "s")).collect())) == [("a", "0"), ("b", "x")]


def test_deep_files_are_found(spark, tmp_path):
    deep = tmp_path / "/".join("abcdefgh").removeprefix("/")
    deep.mkdir(parents=True)
    (deep / "x.py").write_text("1")
    found = files.scan_files(spark, str(tmp_path), [".py"])
    assert [r.path for r in found.collect()] == ["a/b/c/d/e/f/g/h/x.py"]
    assert files.scan_files(spark, str(tmp_path), [".py"], max_depth=3).count() == 0


def test_all_contributed_texts_stay(spark):
    parts = spark.createDataFrame(
        [(1, "plugin", f"p{i}", f"text{i}") for i in range(9)] + [(1, "related", f"r{i}", "r") for i in range(9)],
        "ctx int, kind string, path string, content string",
    )
    errors = spark.createDataFrame([], "ctx int, path string, line int, col int, severity string, message string")
    instructions = spark.createDataFrame([(1, "go")], "ctx int, instruction string")
    text = context.request_texts(context.context_sections(parts, errors, instructions)).first().request
    assert [f"text{i}" in text for i in range(9)] == [True] * 9 and text.count("## Related") == 5


def test_last_line_of_a_stream(spark, tmp_path):
    chunks = [("r", 0, "a\nb", False), ("r", 1, "c\nlast", True), ("s", 0, "open", False)]
    spark.createDataFrame(chunks, "request string, seq int, data string, ends boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("request string, seq int, data string, ends boolean").parquet(f"{tmp_path}/in")
    with ev.rocksdb_state(spark):
        found = ev.sink_table(ev.assemble_stream(stream, F.col("ends")), "lines").collect()
    assert sorted((r.request, r.line_no, r.line) for r in found) == [("r", 0, "a"), ("r", 1, "bc"), ("r", 2, "last")]


@pytest.mark.parametrize("n", [3, 40])
def test_streams_over_several_files(spark, tmp_path, n):
    """The same rows in one file and in several give the same results."""
    queries = load_all()
    spark.read.parquet(f"{TABLES}/events.parquet").repartition(n).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("tailed_logs", "hourly_outcomes", "throttled_stream", "activation_change_stream", "routed_events"):
        one, many = (sorted(map(str, queries[name].build(spark, f).collect())) for f in (TABLES, str(tmp_path)))
        assert one and one == many, name


def test_hooks_that_fail_while_they_run_are_skipped(spark):
    df = spark.createDataFrame([(1, "git-status.txt", "?? a\n M b\nA  c"), (1, "git-log.txt", "abc one\n\ndef two")], "ws int, path string, content string")
    broken = hooks.Hook("broken", lambda f: f.select(F.raise_error(F.lit("boom")).cast("string").alias("x")), lambda: F.col("x"))
    chosen = [h for h in DEFAULT_HOOKS if h.key in ("git.status", "git.recentCommits", "security.findings")]
    got = sorted(map(tuple, hooks.stored_hook_lines(df, [broken, *chosen]).collect()))
    assert got == [
        ("git.recentCommits", "- abc one"), ("git.recentCommits", "- def two"),
        ("git.status", "- modified: 1, staged: 1, untracked: 1"), ("security.findings", "- all: 0"),
    ]


def test_every_default_hook_runs(spark):
    df = spark.createDataFrame([(1, "manage.py", "x = 1")], "ws int, path string, content string")
    assert set(map(tuple, hooks.hook_lines(df, DEFAULT_HOOKS).collect())) >= {("security.findings", "- all: 0")}


def test_many_rows_per_key(spark):
    df = spark.range(9000, numPartitions=5).select(F.when(F.col("id") % 3 > 0, 0).otherwise(1).alias("k"), F.col("id").alias("v"))
    got = {}
    for r in top_per_key(df, ["k"], [F.desc("v")], 2500).collect():
        got.setdefault(r.k, []).append((r["rank"], r.v))
    for k, want in ((0, [v for v in range(9000) if v % 3]), (1, list(range(0, 9000, 3)))):
        assert sorted(got[k]) == list(enumerate(sorted(want, reverse=True)[:2500], start=1))
