import pytest
from pyspark.sql import functions as F

from winnow.functions import labels, paths, text
from winnow.operators.generated import generated_files, safe_paths


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn("c").alias("r")).first().r


@pytest.mark.parametrize(
    "value, n, expected",
    [
        ("abc", 3, "abc"),
        ("abcd", 3, "abc|"),
        ("a😀b😀", 3, "a😀b|"),
        ("", 0, ""),
        (None, 3, None),
    ],
)
def test_truncate(spark, value, n, expected):
    assert one(spark, value, lambda c: text.truncate_text(c, n, "|")) == expected


@pytest.mark.parametrize(
    "value, n, expected",
    [
        ("ab\ncd\nef", 5, "ab\ncd|"),  # the newline itself may sit at position n
        ("ab\ncd\nef", 4, "ab|"),
        ("abcdef", 3, "abc|"),  # no newline: cut at n
        ("\nabcdef", 3, "|"),
        ("ab\ncd", 5, "ab\ncd"),
        (None, 5, None),
    ],
)
def test_truncate_at_newline(spark, value, n, expected):
    assert one(spark, value, lambda c: text.truncate_at_newline(c, n, "|")) == expected


def test_trim_removes_every_kind_of_space(spark):
    assert one(spark, "\t\n  x y﻿\r\n", text.trim_space) == "x y"


def test_strip_fences(spark):
    assert one(spark, "```python\nx = 1\n```\n", text.strip_fences) == "x = 1"


def test_redact(spark):
    raw = "SECRET_KEY = 'abc'\nU = 'db://u:pw@h/x'"
    assert one(spark, raw, text.redact) == "SECRET_KEY = <redacted>\nU = 'db://u:***@h/x'"


def test_sections(spark):
    df = spark.createDataFrame([("a", "", None, "d")], "a string, b string, c string, d string")
    assert df.select(text.sections_text("a", "b", "c", "d")).first()[0] == "a\n\nd"


@pytest.mark.parametrize(
    "path, expected",
    [
        ("a/./b//c", "a/b/c"),
        ("a/../b", "b"),
        ("../b", None),
        ("a/../../b", None),
        ("a/..", ""),
    ],
)
def test_resolve(spark, path, expected):
    assert one(spark, path, paths.resolve) == expected


def test_path_parts(spark):
    df = spark.createDataFrame([("x/y.test.ts",), (".env",), ("Makefile",)], "p string")
    got = df.select(paths.extension("p"), paths.stem("p"), paths.dir_name("p"), paths.language_of("p")).collect()
    assert [tuple(r) for r in got] == [
        (".ts", "y.test", "x", "typescript"), ("", ".env", "", "text"), ("", "Makefile", "", "text"),
    ]


def split(spark, value):
    df = spark.createDataFrame([(1, value)], "id int, text string")
    return [(r.path, r.content) for r in generated_files(df, "/base", ["id"]).collect()]


def test_generated_files(spark):
    fenced = "## src/hello.py\n```python\nprint(1)\n```\n\n### b/c.ts\n\n```\nx\n```\n"
    assert split(spark, fenced) == [("base/src/hello.py", "print(1)"), ("base/b/c.ts", "x")]
    assert split(spark, "// a.js\nlet x = 1\nlet y\n// b.js\nlet z\n") == [
        ("base/a.js", "let x = 1\nlet y"), ("base/b.js", "let z"),
    ]
    assert split(spark, "=== a.txt ===\none\ntwo\n=== b.txt ===\nthree") == [
        ("base/a.txt", "one\ntwo"), ("base/b.txt", "three"),
    ]
    assert split(spark, "no header here") == [("base/generated.txt", "no header here")]
    assert split(spark, "  \n") == [] and split(spark, None) == []
    assert split(spark, "## ../../etc/passwd.txt\n```\nx\n```")[0][0] == "base/generated.txt"


def test_safe_paths(spark):
    df = spark.createDataFrame([("a/../b",), ("../../etc/passwd",), ("../basement",), ("x",)], "path string")
    assert sorted(r.path for r in safe_paths(df, "/base").collect()) == ["base/b", "base/x"]


def test_labels(spark):
    assert one(spark, "What is a test?", labels.classify_task) == "explain code"
    assert one(spark, "Refactor, then FIX", labels.classify_task) == "fix errors"
    assert one(spark, "hello", labels.classify_task) == "assist with this request"
    df = spark.createDataFrame([(404, "model x"), (404, "gone"), (503, None), (418, "t")], "c int, m string")
    got = [r[0] for r in df.select(labels.classify_error("c", "m")).collect()]
    assert got == ["model-missing", "not-found", "server", "other"]
    ready = spark.sql("SELECT array(named_struct('type','Ready','state','CONDITION_SUCCEEDED')) a, "
                      "array(named_struct('type','Other','state','x')) b, "
                      "cast(null as array<struct<type string, state string>>) c")
    got = ready.select(*[labels.ready_status(c) for c in "abc"]).first()
    assert tuple(got) == ("Ready", "Unknown", "Unknown")
    assert one(spark, None, labels.map_text, "map<string,string>") == "(none)"
    assert one(spark, {"b": "2", "a": "1"}, labels.map_text, "map<string,string>") == "  a=1\n  b=2"


def test_times(spark):
    df = spark.createDataFrame([(1704067200123, "1704067200123", "2024-01-01T00:00:00Z", "junk")], "a long, b string, c string, d string")
    got = df.select(
        labels.from_epoch_millis("a"), labels.from_epoch_millis("b"), labels.from_iso("c"), labels.from_iso("d"),
        labels.from_epoch_millis("d"),
    ).first()
    assert got[0] == got[1] and got[0].microsecond == 123000 and got[2].year == 2024 and got[3] is None and got[4] is None


def test_schema_and_job_lines(spark):
    df = spark.createDataFrame([("id", "int", True, "key"), ("x", "string", False, None)], "n string, t string, r boolean, c string")
    got = [r[0] for r in df.select(labels.schema_text("n", "t", F.col("r"), "c")).collect()]
    assert got == ["  - `id` int NOT NULL — key", "  - `x` string"]
    jobs = spark.createDataFrame([(["a", "b"], "0 1", "UTC"), (None, None, None)], "t array<string>, c string, z string")
    got = [r[0] for r in jobs.select(labels.job_label("t", "c", "z")).collect()]
    assert got == ["Tasks=[a, b] | Schedule: 0 1 (UTC)", "Tasks=[none] | No schedule"]


def test_severity_and_failed(spark):
    df = spark.createDataFrame([("error", None), ("INFO", None), ("odd", "x"), (None, "x")], "s string, e string")
    ranks = [r[0] for r in df.select(labels.severity_rank("s")).collect()]
    assert ranks[0] > ranks[1] > ranks[2] == 1
    states = spark.createDataFrame([("FAILED", None), ("failed", None), ("ok", "boom"), (None, None)], "s string, e string")
    assert [r[0] for r in states.select(labels.is_failed("s", "e")).collect()] == [True, True, True, False]
