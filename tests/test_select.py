import random

import pytest
from pyspark.sql import functions as F

from winnow.operators import aggregate, select
from winnow.operators.skew import previous_value, running_sums


def loop_window(lengths, budget):
    """Newest message backwards, stop at the first that does not fit."""
    total, kept = 0, []
    for turn in range(len(lengths) - 1, -1, -1):
        if total + lengths[turn] > budget and kept:
            break
        kept.append(turn)
        total += lengths[turn]
    return set(kept)


def conversations(spark, cases):
    rows = [(c, t, "x" * n) for c, lengths in enumerate(cases) for t, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "conv_id long, turn long, text string")


def test_window_messages_edges(spark):
    cases = [
        [5, 5, 100],  # newest alone is over the budget
        [4, 3, 3],  # exact fit
        [5, 3, 3],  # one character over
        [1, 9, 1],  # a message that does not fit hides the older one that would
        [0, 0, 0],
        [20, 0],  # an empty newest message does not make the next one newest
        [3],
    ]
    got = {}
    for r in select.window_messages(conversations(spark, cases), 10).collect():
        got.setdefault(r.conv_id, set()).add(r.turn)
    assert [got.get(i, set()) for i in range(len(cases))] == [loop_window(c, 10) for c in cases]


def test_window_messages_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(select, "TURNS_PER_BLOCK", 4)
    rng = random.Random(3)
    cases = [[rng.choice([0, 1, 2, 7, 30]) for _ in range(rng.randrange(1, 60))] for _ in range(60)]
    got = {}
    for r in select.window_messages(conversations(spark, cases), 25).collect():
        got.setdefault(r.conv_id, set()).add(r.turn)
    assert [got[i] for i in range(len(cases))] == [loop_window(c, 25) for c in cases]


def test_block_helpers_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, *range(1, 10)])) for i in range(500)]
    rows = [(k, o, 1) if k not in seen and not seen.add(k) else (k, o, v) for seen in [set()] for k, o, v in rows]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    block = F.floor(F.col("o") / 16)
    got = running_sums(df, ["k"], ["o"], {"s": F.col("v")}, block)
    got = previous_value(got, ["k"], ["o"], "v", block, "p")
    plain = df.selectExpr(
        "*", "sum(v) over (partition by k order by o) s", "lag(v) over (partition by k order by o) p"
    )
    assert sorted(map(str, got.select("k", "o", "v", "s", "p").collect())) == sorted(map(str, plain.collect()))


def test_null_keys_and_texts_are_kept(spark):
    rows = [(None, 0, "abc"), (None, 1, None), (1, 0, None), (1, 1, None), (2, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn) for r in select.window_messages(df, 10).collect()}
    assert got == {(None, 0), (None, 1), (1, 0), (1, 1), (2, None)}


def test_last_n(spark):
    df = conversations(spark, [[1] * 50, [1] * 3])
    counts = {r.conv_id: r["count"] for r in select.last_n(df, 40).groupBy("conv_id").count().collect()}
    assert counts == {0: 40, 1: 3}


def test_allocate_budget(spark):
    parts = spark.createDataFrame(
        [
            (1, "active", "a", "x" * 60), (1, "related", "b", "y" * 60), (1, "related", "c", "z" * 5),
            (1, "diff", "d", "l1\nl2\nl3l3l3l3l3"), (1, "plugin", "e", "p" * 99),
            (2, "active", "f", "s"),  # no related files
        ],
        "ctx int, kind string, path string, content string",
    )
    got = {r.path: r.content for r in select.allocate_budget(parts, 100).collect()}
    assert got["a"] == "x" * 50 + "\n... (truncated to fit context budget)"
    assert got["b"] == "y" * 12 + "\n... (truncated to fit context budget)"
    assert got["c"] == "z" * 5 and got["d"] == "l1\nl2\n... (diff truncated)"
    assert got["e"] == "p" * 99 and got["f"] == "s"
    assert aggregate.context_used(parts).first().used == 60 + 60 + 5 + 16 + 1


@pytest.mark.parametrize("total, cap", [(24_000, 15), (1000, 3), (48_000, 30)])
def test_error_cap(total, cap):
    assert select.error_cap(total) == cap


def test_recent_failures_limits_before_it_filters(spark):
    runs = spark.sql(
        "SELECT id AS run_id, timestamp_seconds(id) AS started, if(id in (1, 17, 25), 'failed', 'SUCCESS') AS state FROM range(30)"
    )
    assert [r.run_id for r in select.recent_failures(runs, fetch=20, keep=3).collect()] == [25, 17]
    assert [r.run_id for r in select.recent_failures(runs, fetch=30, keep=2).collect()] == [25, 17]


def test_latest_run(spark):
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id long")
    runs = spark.sql("SELECT * FROM VALUES (1, 1, timestamp'2024-01-01', 'A'), (1, 2, timestamp'2024-01-02', 'B'), (3, 3, timestamp'2024-01-01', 'C') AS t(job_id, run_id, started, state)")
    runs = runs.withColumn("job_id", F.col("job_id").cast("long"))
    assert {r.job_id: r.state for r in select.latest_run_per_job(jobs, runs, 2).collect()} == {1: "B", 2: "NO_RUNS"}
    assert {r.job_id: r.state for r in select.latest_run_per_job(jobs, runs, None).collect()} == {1: "B", 2: "NO_RUNS", 3: "C"}


def test_problem_or_all(spark):
    df = spark.createDataFrame([("up",), ("down",), (None,)], "s string")
    assert [r.s for r in select.problem_or_all(df, F.col("s") == "down").collect()] == ["down"]
    assert select.problem_or_all(df, F.col("s") == "gone").count() == 3
    assert select.problem_or_all(df.limit(0), F.col("s") == "gone").count() == 0


def test_topk_with_overflow(spark):
    df = spark.range(25)
    got = [r.label for r in select.topk_with_overflow(df, F.col("id").cast("string"), [F.col("id")], 20).collect()]
    assert sorted(got[:-1], key=int) == [str(i) for i in range(20)] and got[-1] == "... and 5 more"
    assert select.topk_with_overflow(df, F.col("id").cast("string"), [F.col("id")], 25).count() == 25


def test_lookahead_stops_at_the_end_of_the_file(spark):
    files = spark.createDataFrame([("a", "@x\n\ndef f("), ("b", "@x\n1\n2\ndef late("), ("c", "@x")], "path string, content string")
    got = {r.path: r.found for r in select.lookahead_match(files, "@x", r"def (\w+)\(", 2).collect()}
    assert got == {"a": "f", "b": None, "c": None}


def test_inventory_counts_zero_for_what_cannot_be_read(spark, tmp_path):
    kinds = {"some": lambda: spark.range(3), "none": lambda: spark.read.parquet(str(tmp_path / "absent"))}
    assert {tuple(r) for r in aggregate.inventory_counts(spark, kinds).collect()} == {("some", 3), ("none", 0)}


def test_group_names(spark):
    df = spark.createDataFrame([("g", f"n{i:02d}") for i in range(12)] + [("h", "x"), ("h", "x")], "g string, n string")
    got = {r.g: r.names for r in aggregate.group_names(df, "g", "n").collect()}
    assert got == {"g": ", ".join(f"n{i:02d}" for i in range(8)), "h": "x"}
