import posixpath
import random

from pyspark.sql import functions as F

from winnow.operators import joins
from winnow.operators.skew import newest_rows, numbered


def brute_siblings(paths, limit):
    out = set()
    for p in paths:
        base, _ = posixpath.splitext(posixpath.basename(p))
        near = sorted(
            (posixpath.basename(q), q)
            for q in paths
            if q != p and posixpath.dirname(q) == posixpath.dirname(p) and base in posixpath.basename(q)
        )
        out |= {(p, q, i + 1) for i, (_, q) in enumerate(near[:limit])}
    return out


def test_siblings_against_brute_force(spark):
    paths = [f"d{i % 3}/{i}.py" for i in range(150)] + ["d0/a.ts", "d0/a.test.ts", "d0/ab.ts", "d0/b.ts", "top.py", "stop.py", "top"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {tuple(r) for r in joins.siblings(files).collect()}
    assert got == brute_siblings(paths, 5)


def test_siblings_of_one_hot_name_stay_few(spark):
    """Every name holds the base name of one file; no more than limit + 1 offers survive per piece."""
    paths = ["d/a.py"] + [f"d/a{i}.py" for i in range(3000)]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = joins.siblings(files)
    assert found.filter("path = 'd/a.py'").count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_import_targets(spark):
    files = spark.createDataFrame(
        [
            ("src/a.ts", "import x from './b'\nimport y from '../lib/c'\nimport z from './b.ts'\nconst r = require \"./d\"\nimport q from 'react'"),
            ("src/b.ts", ""), ("src/b.js", ""), ("lib/c/index.js", ""), ("lib/c/index.ts", ""),
            ("src/d.js", "from '../../out'"), ("e.ts", None),
        ],
        "path string, content string",
    )
    got = sorted((r.path, r.target, r.pos) for r in joins.import_targets(files).collect())
    assert got == [("src/a.ts", "lib/c/index.ts", 1), ("src/a.ts", "src/b.ts", 0), ("src/a.ts", "src/d.js", 3)]


def test_related_files_fills_free_places(spark):
    files = spark.createDataFrame(
        [("s/a.ts", "import m from './a.test'\nimport m from '../z/m'")] + [(f"s/a{i}.ts", "") for i in range(3)]
        + [("s/a.test.ts", ""), ("z/m.js", "")],
        "path string, content string",
    )
    got = [(r.related, r.rank) for r in joins.related_files(files).filter("path = 's/a.ts'").orderBy("rank").collect()]
    assert got == [("s/a.test.ts", 1), ("s/a0.ts", 2), ("s/a1.ts", 3), ("s/a2.ts", 4), ("z/m.js", 5)]


def test_runs_with_job(spark):
    runs = spark.createDataFrame([(1, 7), (2, 8)], "run_id long, job_id long")
    jobs = spark.createDataFrame(
        [(7, "seven", [("a", None), ("b", "text")])],
        "job_id long, job_name string, tasks array<struct<task_key string, description string>>",
    )
    got = {r.run_id: (r.job_name, r.task_text) for r in joins.runs_with_job(runs, jobs).collect()}
    assert got == {1: ("seven", "  - a\n  - b: text"), 2: ("Job 8", "  (no task details)")}


def test_activation_diff_and_first_wins(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {tuple(r) for r in joins.activation_diff(ids("a", "b"), ids("b", "c")).collect()}
    assert got == {("a", "activated"), ("c", "deactivated")}
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "id string, pos int, v string")
    assert {(r.id, r.v) for r in joins.first_wins(df, "id", [F.col("pos")]).collect()} == {("a", "y"), ("b", "z")}


def test_set_operations(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("default", 0)], "v string, pos int")
    assert {tuple(r) for r in joins.distinct_ordered(df, "v", ["pos"]).collect()} == {("b", 1), ("a", 2), ("default", 0)}
    assert {r.v for r in joins.exclude_values(df, "v", ["default"]).collect()} == {"a", "b"}
    top = spark.createDataFrame([(1, "t1"), (2, "t2")], "topic int, topic_name string")
    sub = spark.createDataFrame([(2, "s2"), (3, "s3")], "topic int, subscription_name string")
    assert {tuple(r) for r in joins.orphans(top, sub).collect()} == {("topic", "t1"), ("subscription", "s3")}


def test_union_changes_keeps_staged_first(spark):
    staged = spark.range(4, 10).withColumnRenamed("id", "n")
    working = spark.range(0, 20).withColumnRenamed("id", "n")
    got = [(r.stage, r.n) for r in joins.union_changes(staged, working, "n", 8).collect()]
    assert got == [("staged", n) for n in range(4, 10)] + [("unstaged", 0), ("unstaged", 1)]


def test_union_problems(spark):
    functions = spark.createDataFrame(
        [(f"p/f{i}", "ACTIVE" if i % 2 else "FAILED", None) for i in range(8)], "resource string, state string, updated timestamp"
    )
    logs = spark.sql("SELECT id AS log_id, timestamp_seconds(id) AS ts, cast(null AS string) AS name, concat('m', id) AS message FROM range(9)")
    got = [(r.source, r.pos, r.name, r.error) for r in joins.union_problems(functions, logs, 5).orderBy("source", "pos").collect()]
    assert got == [
        (0, 1, "f0", "Function state: FAILED"), (0, 2, "f2", "Function state: FAILED"), (0, 3, "f4", "Function state: FAILED"),
        (1, 1, "unknown", "m8"), (1, 2, "unknown", "m7"), (1, 3, "unknown", "m6"),
    ]


def test_siblings_by_rare_pieces(spark):
    """Short names, repeated pieces, names that hold each other, and offered rows that grow with the length of a name alone."""
    rng = random.Random(12)
    names = ["a.py", "ab.py", "abc.py", "xabcx.py", "aaaa.py", "aaaaaaaa.py", ".env", "b", "é.py", "éé.py", "😀a.py", "x" * 300 + ".py"]
    names += ["".join(rng.choices("abx_", k=rng.randrange(1, 12))) + rng.choice([".py", ".ts", ""]) for _ in range(120)]
    paths = sorted({f"{d}/{n}" for n in names for d in ("p", "q") if rng.random() < 0.8} | {"top.py", "stop.py"})
    files = spark.createDataFrame([(p, "") for p in paths], "path string, content string")
    assert {tuple(r) for r in joins.siblings(files, 5).collect()} == brute_siblings(paths, 5)
    named = files.select(F.col("path").alias("sibling"), joins.dir_name("path").alias("dir"), joins.base_name("path").alias("name"))
    grams = named.select(F.size(joins._grams("name", F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("n"), F.length("name").alias("c"))
    assert grams.where("n > 3 * c").count() == 0


def test_numbered(spark):
    rng = random.Random(3)
    made = [(rng.randrange(50), i) for i in range(2000)] + [(None, 5000)]
    df = spark.createDataFrame(made, "a long, b long").repartition(5)
    got = [tuple(r) for r in numbered(df, ["a", "b"], "pos", descending=("a",)).orderBy("pos").collect()]
    wanted = sorted(made, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == [(a, b, i) for i, (a, b) in enumerate(wanted, 1)]
    assert numbered(df.where("false"), ["a", "b"], "pos").count() == 0


def test_newest_rows(spark):
    rng = random.Random(9)
    times = ["1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "2024-03-10 02:30:00.5", "2024-11-03 01:30:00.25", "9999-12-31 23:59:59.999999"]
    made = [(rng.choice(["x", "y", None]), rng.choice([*times, None]), i * rng.choice([1, -1]), f"v{i}") for i in range(300)]
    made += [("z", None, 1, "only"), ("w", times[0], -(2**63), "low"), ("w", times[0], 2**63 - 1, "high")]
    key = lambda r: (r[1] is not None, r[1] or "", r[2])
    wanted = {}
    for r in made:
        best, n = wanted.get(r[0], (r, 0))
        wanted[r[0]] = (max(best, r, key=key), n + 1)
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(made, "k string, at string, i long, v string").withColumn("at", F.col("at").cast(kind))
        found = newest_rows(df, "k", "at", "i", "v")
        got = {r.k: (r.v, r.n) for r in found.collect()}
        for k, (best, n) in wanted.items():
            assert got[k][1] == n
            if best[1] is not None:
                assert got[k][0] == best[3]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "max(_place" in plan.replace("partial_max(_place", "max(_place")
