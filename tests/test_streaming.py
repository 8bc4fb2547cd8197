import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow.sources.scratch import scratch_dir
from winnow.streaming import events as ev


def loop_throttle(times, width):
    out, free = [], None
    for t in sorted(times):
        if free is None or t >= free:
            out.append(t)
            free = t + width
    return out


def opened(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.k, []).append(r.opened)
    return {k: sorted(v) for k, v in got.items()}


def test_throttle_edges(spark):
    cases = {
        "two apart": [0, 2_000_000],  # exactly at the firing: opens the next timer
        "just inside": [0, 1_999_999],
        "not tumbling": [1_500_000, 2_500_000, 3_600_000],
        "one": [7],
        "same time": [5, 5, 5],
        "negative": [-3_000_000, -1, 0],
    }
    df = spark.createDataFrame([(k, t) for k, ts in cases.items() for t in ts], "k string, t long")
    got = opened(ev.throttle(df, ["k"], "t"))
    assert got == {k: loop_throttle(ts, 2_000_000) for k, ts in cases.items()}
    busy = opened(ev.throttle(df, ["k"], "t", busy=0))
    assert busy == got
    odd = spark.createDataFrame([(None, 0), (None, 1), ("a", None), (None, 3_000_000)], "k string, t long")
    assert opened(ev.throttle(odd, ["k"], "t")) == {None: [0, 3_000_000]}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.lists(st.integers(0, 3000), min_size=1, max_size=120), min_size=1, max_size=8),
    st.integers(1, 2000),
    st.integers(0, 60),
)
def test_throttle_equals_a_loop(spark, cases, period, busy):
    df = spark.createDataFrame([(k, t) for k, ts in enumerate(cases) for t in ts], "k long, t long")
    got = opened(ev.throttle(df, ["k"], "t", width=5, period=period, busy=busy))
    assert got == {k: loop_throttle(ts, 5) for k, ts in enumerate(cases)}


def arrivals(spark, batches, schema, purpose):
    """A folder with one file per batch, in arrival order, and a stream that reads one file per batch."""
    folder = scratch_dir(spark, purpose)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")
    )


def test_throttle_stream_keeps_its_timer_between_batches(spark):
    batches = [[("a", 0), ("b", 10)], [("a", 4), ("a", 5), ("b", 14)], [("a", 9), ("a", 10), ("b", 100)]]
    stream = arrivals(spark, batches, "k string, t long", "throttle-test")
    with ev.rocksdb_state(spark):
        got = opened(ev.sink_table(ev.throttle_stream(stream, "k", "t", 5), "throttle-out"))
    every = {}
    for b in batches:
        for k, t in b:
            every.setdefault(k, []).append(t)
    assert got == {k: loop_throttle(ts, 5) for k, ts in every.items()}


def test_throttle_stream_forgets_quiet_keys(spark):
    day = 86_400_000_000  # the first watermark is the epoch, and rows at it are late
    seconds = [
        [("a", 0), ("b", 1)], [("a", 1.5), ("a", 2)], [("c", 3600)], [("c", 3601), ("a", 3602)], [("b", 3603), ("b", 3604.5)],
    ]
    batches = [[(k, day + int(t * 1_000_000)) for k, t in b] for b in seconds]
    stream = arrivals(spark, batches, "k string, t long", "throttle-expiry").withColumn("ts", F.timestamp_micros("t"))
    with ev.rocksdb_state(spark):
        out = ev.throttle_stream(stream, "k", "t", event_time="ts", delay="1 second")
        got = opened(ev.sink_table(out, "throttle-expiry-out"))
    every = {}
    for k, t in (r for b in batches for r in b):
        every.setdefault(k, []).append(t)
    assert got == {k: loop_throttle(ts, 2_000_000) for k, ts in every.items()}


def test_activation_stream_equals_batch(spark):
    batches = [[("a", 1, True), ("b", 2, False)], [("a", 3, True), ("b", 4, True)], [("a", 5, False), ("b", 6, True), ("a", 7, True)]]
    schema = "id string, pos long, on boolean"
    stream = arrivals(spark, batches, schema, "activation-test")
    with ev.rocksdb_state(spark):
        streamed = ev.sink_table(ev.activation_stream(stream, "id", "on", ["pos"]), "activation-out")
    batch = ev.activation_changes(
        spark.createDataFrame([r for b in batches for r in b], schema), "id", "on", ["pos"], F.floor(F.col("pos") / 2)
    )
    as_set = lambda df: {tuple(r) for r in df.select("id", "pos", "change").collect()}
    assert as_set(streamed) == as_set(batch) == {
        ("a", 1, "activated"), ("b", 4, "activated"), ("a", 5, "deactivated"), ("a", 7, "activated"),
    }


LINES = [
    json.dumps({"message": {"content": "Hé"}}), "", 'data: {"delta": {"text": "llo "}}', "data: [DONE]", "data: {broken",
    "   ", 'data:{"choices": [{"delta": {"content": "wörld"}}]}', json.dumps({"message": {}}), json.dumps({"message": {"content": "!"}}),
]


def chunked(text, size):
    return [text[i : i + size] for i in range(0, len(text), size)]


def test_lines_split_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(ev, "CHUNKS_PER_BLOCK", 3)
    text = "\n".join(LINES)
    for size in (1, 7, 1000):
        rows = [("r", i, c) for i, c in enumerate(chunked(text, size))] + [("s", 0, "\n\n"), ("t", 0, LINES[0])]
        df = spark.createDataFrame(rows, "request string, seq int, data string")
        got = {r.request: r.text for r in ev.assemble_text(df).collect()}
        assert got == {"r": "Héllo wörld!", "t": "Hé"}
        lines = [r.line for r in ev.assemble_lines(df).filter("request = 'r'").orderBy("line_no").collect()]
        assert lines == [x for x in LINES if x.strip()]


def test_line_stream_carries_the_tail(spark):
    text = "\n".join(LINES) + "\n"
    batches = [[("r", i, c)] for i, c in enumerate(chunked(text, 41))]
    stream = arrivals(spark, batches, "request string, seq int, data string", "lines-test")
    with ev.rocksdb_state(spark):
        got = ev.sink_table(ev.assemble_stream(stream), "lines-out").orderBy("line_no").collect()
    assert [r.line for r in got] == [x for x in LINES if x.strip()]
    assert [r.line_no for r in got] == [i for i, x in enumerate(LINES) if x.strip()]


def test_routing_types_every_event(spark):
    rows = [
        ("provider.changed", '{"provider": "p", "model": "m"}'), ("files.created", '{"filePaths": ["a", "b"]}'),
        ("ui.status.update", "{}"), ("file.edited", '{"filePath": "f", "linesChanged": 3}'), ("file.edited", "broken"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, event_type string, props string")
    typed = lambda t: [tuple(r) for r in ev.typed_events(df, t, ev.EVENT_SCHEMAS[t]).collect()]
    assert typed("provider.changed") == [(0, "p", "m")]
    assert typed("files.created") == [(1, ["a", "b"])]
    assert typed("ui.status.update") == [(2,)]
    assert typed("file.edited") == [(3, "f", 3), (4, None, None)]
    assert len(ev.EVENT_SCHEMAS) == 12


def test_a_retried_batch_replaces_its_own_output(spark):
    folder = scratch_dir(spark, "retry")
    write = ev.write_batch(folder)
    write(spark.range(5), 0)
    write(spark.range(3), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(folder).count() == 5


def test_outcome_counts_over_batches(spark):
    batches = [
        [("start", "2024-01-01 00:05:00"), ("done", "2024-01-01 00:06:00")],
        [("start", "2024-01-01 00:59:00"), ("other", "2024-01-01 01:00:00")],
        [("error", "2024-01-01 01:10:00")],
    ]
    rows = [[(e, t) for e, t in b] for b in batches]
    stream = arrivals(spark, rows, "event_type string, at string", "outcome-test").withColumn("ts", F.col("at").cast("timestamp"))
    counted = ev.outcome_counts(stream, {"start": "started", "done": "done", "error": "failed"})
    latest = ev.latest_counts(ev.sink_table(counted, "outcome-out", mode="update"))
    got = {(r.hour.hour, r.outcome): r.n for r in latest.collect()}
    assert got == {(0, "started"): 2, (0, "done"): 1, (1, "failed"): 1}


def test_a_rescan_replaces_the_findings_of_a_document(spark):
    batches = [
        [("a", "x = eval(y)", 1), ("b", "x = eval(y)", 1), ("a", "pwd = 'abcd'", 2)],
        [("b", "fine", 3)],
    ]
    stream = arrivals(spark, batches, "path string, content string, saved long", "rescan-test")
    folder = scratch_dir(spark, "rescan-out")
    ev.incremental_scan(stream, folder, f"{folder}/checkpoint", order="saved")
    assert [(r.path, r.rule_id) for r in ev.current_findings(spark, folder).collect()] == [("a", 1)]
