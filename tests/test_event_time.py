"""Streams over files in any order, their state, and the compacted store of findings."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from winnow.sources import generations
from winnow.sources.scratch import scratch_dir
from winnow.streaming import events as ev

from .test_streaming import LINES, chunked

DAY = 86_400


def ordered_files(spark, batches, schema, purpose):
    """A stream that reads one file for each batch, in the order of the batches."""
    folder = scratch_dir(spark, purpose)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(spark, stream, purpose):
    """The rows of a stream, and the rows left in each of its states."""
    folder = scratch_dir(spark, purpose)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/table/batch_id=-1")
    ev.run_to_end(stream, ev.write_batch(f"{folder}/table"), f"{folder}/checkpoint")

    def state(name):
        return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint").count()

    return spark.read.schema(stream.schema).parquet(f"{folder}/table/*").collect(), state


# ── chunks


def test_chunks_in_any_order(spark):
    text, rng = "\n".join(LINES) * 3 + "\nlast without newline", random.Random(5)
    rows = []
    for request, size in (("r", 7), ("s", 23), ("t", 5000)):
        cuts = chunked(text, size)
        rows += [(request, i, c, i == len(cuts) - 1) for i, c in enumerate(cuts)]
    rows += rng.sample([r for r in rows if not r[3]], 10)  # some come twice
    rng.shuffle(rows)
    # what comes again after its request has ended would begin it anew, so the ends come last
    batches = [[r for r in rows[i::5] if not r[3]] for i in range(5)] + [[r for r in rows if r[3]]]
    stream = ordered_files(spark, batches, "request string, seq int, data string, ends boolean", "any-order")
    with ev.rocksdb_state(spark):
        found, state = run(spark, ev.assemble_stream(stream, F.col("ends")), "any-order-out")
    wanted = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
    for request in "rst":
        assert sorted((r.line_no, r.line) for r in found if r.request == request) == wanted
    assert state("carry") == state("waiting") == 0


def test_an_end_that_arrives_first_waits(spark):
    batches = [[("r", 2, "c", True)], [("r", 0, "a\n", False)], [("r", 1, "b\n", False)]]
    stream = ordered_files(spark, batches, "request string, seq int, data string, ends boolean", "end-first")
    with ev.rocksdb_state(spark):
        found, state = run(spark, ev.assemble_stream(stream, F.col("ends")), "end-first-out")
    assert sorted((r.line_no, r.line) for r in found) == [(0, "a"), (1, "b"), (2, "c")]
    assert state("carry") == state("waiting") == 0


def test_a_silent_request_ends(spark):
    """Chunk 1 of ``r`` is lost: what waits behind it follows once the request has been silent, and its state goes."""
    at = lambda s: s + DAY  # noqa: E731  # the first watermark is the epoch, and rows at it are late
    batches = [
        [("r", 0, "a\nb", at(0)), ("r", 2, "c\nd", at(1)), ("live", 0, "x", at(1))],
        [("live", 1, "y\n", at(1200))],
        [("live", 2, "z", at(2500)), (None, None, None, at(2500))],
        [(None, None, None, at(9000))],
    ]
    stream = ordered_files(spark, batches, "request string, seq int, data string, at long", "silence")
    stream = stream.withColumn("at", F.timestamp_seconds("at"))
    with ev.rocksdb_state(spark):
        lines = ev.assemble_stream(stream, event_time="at", delay="10 seconds", silence="30 minutes")
        found, state = run(spark, lines, "silence-out")
    got = {}
    for r in found:
        got.setdefault(r.request, []).append((r.line_no, r.line))
    assert {k: sorted(v) for k, v in got.items()} == {"r": [(0, "a"), (1, "bc"), (2, "d")], "live": [(0, "xy"), (1, "z")]}
    assert state("carry") == state("waiting") == 0


# ── state changes


def test_late_events_are_taken_in_order(spark):
    rng = random.Random(8)
    events = [(k, DAY + t, i, rng.random() < 0.5) for i, (k, t) in enumerate((k, rng.randrange(5000)) for k in "abcd" for _ in range(40))]
    events += [("e", DAY + 5, 1000, True), ("e", DAY + 6, 1001, False), ("f", DAY + 7, 1002, True)]
    late = sorted(events, key=lambda e: e[1] + rng.randrange(900))
    batches = [late[i : i + 25] for i in range(0, len(late), 25)] + [[(None, DAY + 10**6, None, None)]]
    schema = "id string, at long, pos long, on boolean"
    stream = ordered_files(spark, batches, schema, "late").withColumn("ts", F.timestamp_seconds("at"))
    with ev.rocksdb_state(spark):
        changes = ev.activation_stream(stream, "id", "on", ["at", "pos"], event_time="ts", delay="20 minutes")
        found, state = run(spark, changes, "late-out")
    batch = ev.activation_changes(spark.createDataFrame(events, schema), "id", "on", ["at", "pos"], F.floor(F.col("at") / 100))
    assert sorted(map(tuple, found)) == sorted((r.id, r.at, r.pos, r.change) for r in batch.collect())
    active = {}
    for k, _, _, on in sorted(events, key=lambda e: (e[1], e[2])):
        active[k] = on
    assert state("rows") == 0 and state("last") == sum(active.values())


def test_quiet_active_keys_are_forgotten(spark):
    batches = [[("a", DAY, True)], [(None, DAY + 8000, None)], [("a", DAY + 9000, True)], [(None, DAY + 40_000, None)]]
    stream = ordered_files(spark, batches, "id string, at long, on boolean", "forget").withColumn("ts", F.timestamp_seconds("at"))
    with ev.rocksdb_state(spark):
        changes = ev.activation_stream(stream, "id", "on", ["at"], event_time="ts", delay="1 minute", forget="1 hour")
        found, state = run(spark, changes, "forget-out")
    assert sorted(r.at for r in found) == [DAY, DAY + 9000]  # forgotten in between, so active anew
    assert state("last") == state("rows") == state("timer") == 0


def test_a_batch_stores_what_it_changed(spark):
    """State goes to changelogs over a number of partitions that the cores give; the session's settings come back."""
    names = [ev.STATE_STORE, ev.CHANGELOG, ev.PARTITIONS]
    spark.conf.set(ev.PARTITIONS, "2000")
    try:
        before = [spark.conf.get(n, None) for n in names]
        batches = [[("a", DAY, True)], [("a", DAY + 8000, False)], [(None, DAY + 40_000, None)]]
        stream = ordered_files(spark, batches, "id string, at long, on boolean", "changelog").withColumn("ts", F.timestamp_seconds("at"))
        with ev.rocksdb_state(spark):
            n = int(spark.conf.get(ev.PARTITIONS))
            changes = ev.activation_stream(stream, "id", "on", ["at"], event_time="ts", delay="1 minute")
            folder = scratch_dir(spark, "changelog-out")
            ev.run_to_end(changes, ev.write_batch(f"{folder}/table"), f"{folder}/checkpoint")
        assert [spark.conf.get(n, None) for n in names] == before
    finally:
        spark.conf.set(ev.PARTITIONS, "8")
    assert n == max(2 * spark.sparkContext.defaultParallelism, 32)
    parts = [p for p in Path(f"{folder}/checkpoint/state/0").iterdir() if p.name.isdigit()]
    assert len(parts) == n and all(any(p.rglob("*.changelog")) for p in parts)
    assert sorted(r.at for r in spark.read.parquet(f"{folder}/table/*").collect()) == [DAY, DAY + 8000]
    with ev.rocksdb_state(spark):  # never more than the session asks for
        assert spark.conf.get(ev.PARTITIONS) == "8"


# ── findings


def scans(spark, store, batches):
    arriving = f"{store}/arriving"
    schema = "path string, content string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arriving)
        stream = ev.incremental_files(spark, arriving, spark.createDataFrame([], schema).schema)
        ev.incremental_scan(stream, f"{store}/s", f"{store}/checkpoint")
        yield f"{store}/s"


def found(spark, store):
    return sorted((r.path, r.rule_id) for r in ev.current_findings(spark, store).collect())


BAD, WORSE = "x = eval(y)", "h = hashlib.md5(x)\nx = eval(y)"
RESCANS = [[("a", BAD), ("b", BAD), ("c", "fine")], [("a", "fine")], [("c", BAD), ("d", WORSE)], [("b", WORSE)]]


def test_compaction_keeps_one_scan_of_each_document(spark):
    plain = [found(spark, s) for s in scans(spark, scratch_dir(spark, "plain"), RESCANS)]
    got = []
    for store in scans(spark, scratch_dir(spark, "compact"), RESCANS):
        before = found(spark, store)
        ev.compact_findings(spark, store)
        assert found(spark, store) == before
        ev.drop_superseded(spark, store)
        got.append(found(spark, store))
        assert generations.folders(spark, f"{store}/findings") == generations.folders(spark, f"{store}/scanned") == []
        assert len(generations.folders(spark, f"{store}/data")) == len(generations.folders(spark, f"{store}/manifest")) == 1
        files = ev.current_findings(spark, store).inputFiles()
        assert files and all("/data/" in f for f in files)  # one generation is read, no batch
    assert got == plain
    assert ev.compact_findings(spark, store) == generations.current_generation(spark, store)  # nothing new


def test_a_compaction_that_is_cut_off_changes_nothing(spark, monkeypatch):
    *_, store = scans(spark, scratch_dir(spark, "cut-off"), RESCANS[:2])
    ev.compact_findings(spark, store)
    before, state = found(spark, store), generations.current_generation(spark, store)
    *_, store = scans(spark, store.removesuffix("/s"), RESCANS[2:3])
    after = found(spark, store)
    assert after != before

    def cut(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ev, "publish", cut)
        with pytest.raises(KeyboardInterrupt):
            ev.compact_findings(spark, store)
    assert generations.current_generation(spark, store) == state and found(spark, store) == after
    ev.drop_superseded(spark, store)  # removes the files of the compaction that was cut off, and no batch that still counts
    assert found(spark, store) == after
    ev.compact_findings(spark, store)
    ev.drop_superseded(spark, store)
    assert found(spark, store) == after
