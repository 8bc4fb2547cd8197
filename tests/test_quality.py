import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winnow.operators import hooks, load, quality
from winnow.operators.quality import ColumnTest


def test_failures(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "c"), (3, None)], "k int, v string")
    assert quality.null_failures(df, "k").count() == 2
    assert [tuple(r) for r in quality.duplicate_failures(df, ["k"]).collect()] == [(1, 2)]
    assert {r.v for r in quality.value_failures(df, "v", ["a", "b"]).collect()} == {"c"}
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r.k for r in quality.orphan_failures(df, parent, "k", "id").collect()] == [3]


def test_run_tests(spark):
    df = spark.range(10)
    got = {tuple(r) for r in quality.run_tests(
        [(df, [ColumnTest("small", F.col("id") > 7), ColumnTest("null", F.col("id").isNull())])],
        {"unique": quality.duplicate_failures(df, ["id"])},
    ).collect()}
    assert got == {("small", 2, "fail"), ("null", 0, "pass"), ("unique", 0, "pass")}


def test_expectations(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    rules = {"low": F.col("x") < 3}
    assert [r.ok_low for r in quality.expectations(df, rules).collect()] == [True, False, False]
    assert quality.expectations(df, rules, "drop").count() == 1
    with pytest.raises(Exception, match="expectation failed: low"):
        quality.expectations(df, rules, "fail").count()
    assert tuple(quality.expectation_counts(df, rules).first()) == ("low", 1, 2)
    with pytest.raises(ValueError):
        quality.expectations(df, rules, "warn")


@pytest.mark.parametrize("draw", [
    lambda r: r.randrange(50),
    lambda r: int(r.paretovariate(0.3)),
    lambda r: 7 if r.random() < 0.4 else r.randrange(10**9),
])
def test_exact_quantiles(spark, draw):
    rng = random.Random(11)
    values = [draw(rng) for _ in range(4001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double" if isinstance(values[0], float) else "x long")
    fractions = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r.q: r.value for r in quality.exact_quantiles(df, "x", fractions, accuracy=100).collect()}
    ordered = sorted(values)
    import math

    assert got == {f: ordered[max(math.ceil(f * len(ordered)), 1) - 1] for f in fractions}


def test_profile_and_categories(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b"), (3, None)], "x int, s string")
    got = {r.column: r for r in quality.profile_columns(df, ["x"], ["s"]).collect()}
    assert (got["x"].n_null, got["x"].null_pct, got["x"].mean) == (1, 25.0, 2.0) and got["s"].min is None
    assert [tuple(r) for r in quality.category_counts(df, "s", 1).collect()] == [("a", 2)]
    assert quality.profile_columns(df.limit(0), ["x"], []).first().null_pct is None


def test_freshness(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    for day, status in (("2024-01-09", "pass"), ("2024-01-07", "warn"), ("2024-01-01", "error")):
        df = spark.sql(f"SELECT timestamp'{day}' AS ts")
        assert quality.source_freshness(df, "ts", now, "2 DAYS", "5 DAYS").first().status == status
    assert quality.source_freshness(df.limit(0), "ts", now, "2 DAYS", "5 DAYS").first().status == "error"


def test_append_into_an_empty_target(spark):
    source = spark.sql("SELECT id, timestamp_seconds(id) AS ts FROM range(5)")
    assert load.incremental_append(source.limit(0), source, "ts").count() == 5
    assert load.incremental_append(source.filter("id < 3"), source, "ts").count() == 5


def test_append_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.sql("SELECT id, timestamp_seconds(id) AS ts FROM range(50)").write.parquet(path)
    df = spark.read.parquet(path)
    fresh = load.new_rows(df.filter("id < 40"), df, "ts")
    assert fresh.count() == 10
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters: [isnotnull(ts" in plan and "subquery" in plan


def test_upsert_and_overwrite(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {tuple(r) for r in load.merge_upsert(t, s, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    t = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "k int, p string")
    s = spark.createDataFrame([(9, "x"), (8, None)], "k int, p string")
    overwritten = load.insert_overwrite(t, s, "p")
    assert {tuple(r) for r in overwritten.select("k", "p").collect()} == {(3, "y"), (9, "x"), (8, None)}
    assert "NestedLoop" not in overwritten._jdf.queryExecution().executedPlan().toString()


def test_scd2(spark):
    history = spark.createDataFrame(
        [(1, "a", 1, 1, 5), (1, "b", 5, 5, None), (2, "x", 1, 1, None), (3, "same", 2, 2, None)],
        "k int, v string, at int, valid_from int, valid_to int",
    )
    current = spark.createDataFrame([(1, "c", 9), (3, "same", 2), (4, "new", 7)], "k int, v string, at int")
    got = {tuple(r) for r in load.scd2_snapshot(history, current, "k", "at").collect()}
    assert got == {
        (1, "a", 1, 1, 5), (1, "b", 5, 5, 9), (1, "c", 9, 9, None), (2, "x", 1, 1, None), (3, "same", 2, 2, None), (4, "new", 7, 7, None),
    }
    again = load.scd2_snapshot(load.scd2_snapshot(history, current, "k", "at"), current, "k", "at")
    assert {tuple(r) for r in again.collect()} == got


def test_surrogate_key_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "b")], "x string, y string")
    keys = [r[0] for r in df.select(load.surrogate_key("x", "y")).collect()]
    assert len(set(keys)) == 3


def test_changelog(spark):
    subjects = ["feat(auth): x", "fix!: y", "chore(a b)!: z", "Merge branch q", "docs: d", "no type", "feat: w"]
    df = spark.createDataFrame([(s,) for s in subjects], "subject string")
    got = {(r.section, r.scope): (r.n_commits, r.n_breaking) for r in load.changelog_groups(df).collect()}
    assert got == {
        ("Features", "auth"): (1, 0), ("Bug Fixes", None): (1, 1), ("Chores", "a b"): (1, 1), ("Other", None): (2, 0), ("Features", None): (1, 0),
    }


def test_date_spine_and_pivot(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 10:00:00' AS ts, 1 AS k, 'a' AS c")
    assert [r.n for r in quality.date_spine(df, "ts", "2024-01-01", "2024-01-03").orderBy("day").collect()] == [0, 1, 0]
    assert tuple(quality.pivot_counts(df, "k", "c", ["a", "b"]).first()) == (1, 1, 0)


def test_apply_transform(spark):
    files = spark.createDataFrame([("a.py", "x"), ("b.py", "boom"), ("c.py", "same"), ("d.js", "x"), ("e.py", "empty")], "path string, content string")

    def fn(content, path, language):
        if content == "boom":
            raise RuntimeError
        return {"x": f"{language}:{path}", "empty": ""}.get(content, content)

    got = {r.path: (r.content, r.status) for r in hooks.apply_transform(files, fn, [".py"]).collect()}
    assert got == {"a.py": ("python:a.py", "changed"), "b.py": ("boom", "failed"), "c.py": ("same", "unchanged"), "e.py": ("empty", "unchanged")}


def test_user_code_gets_parts_of_bounded_size(monkeypatch):
    monkeypatch.setattr(hooks, "PART_BYTES", 10)
    rows = ["abc", None, "", "défghij", "x" * 30, "k", "l" * 9, "m"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.string())], ["n", "content"])
    parts = list(hooks._parts(batch, "content"))
    assert [v for p in parts for v in p.column("content").to_pylist()] == rows
    assert [p.num_rows for p in parts] == [3, 1, 1, 2, 1]
    assert list(hooks._parts(batch.slice(0, 0), "content")) == []


def test_hooks(spark):
    df = spark.createDataFrame([("a", "x")], "path string, content string")
    first = hooks.register_hook("h.test", lambda f: f, lambda: F.col("path"))
    assert hooks.register_hook("h.test", lambda f: f.limit(0), lambda: F.lit("z")) is first
    bad = hooks.Hook("bad", lambda f: f.select("missing"), lambda: F.lit(""))
    assert [tuple(r) for r in hooks.hook_lines(df, [first, bad]).collect()] == [("h.test", "a")]
    with pytest.raises(ValueError):
        hooks.hook_lines(df, [bad])


def test_chain_runs_in_order(spark):
    steps = [lambda d: d.withColumn("id", F.col("id") + 1), lambda d: d.withColumn("id", F.col("id") * 10)]
    assert [r.id for r in hooks.chain(spark.range(2), steps).collect()] == [10, 20]


def test_default_hooks_all_plan(spark):
    from winnow.operators.packs.default_hooks import DEFAULT_HOOKS, register_default_hooks

    files = spark.createDataFrame(
        [("w", "dags/a.py", "schedule='@daily'"), ("w", "t/conftest.py", "@pytest.fixture\ndef f():\n")], "ws string, path string, content string"
    )
    assert len({h.key for h in DEFAULT_HOOKS}) == len(DEFAULT_HOOKS)
    for hook in DEFAULT_HOOKS:  # none is skipped
        hooks.hook_lines(files, [hook]).schema
    got = {(r.key, r.line) for r in hooks.hook_lines(files, DEFAULT_HOOKS).collect()}
    assert ("airflow.dags", "- dags/a.py — dag_id: a [schedule: @daily]") in got
    assert ("pytest.fixtures", "function scope: f") in got
    register_default_hooks()
    assert ("workspace.stacks", "- w: airflow") in {(r.key, r.line) for r in hooks.hook_lines(files).collect()}
