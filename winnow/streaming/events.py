"""Typed event streams: routing, throttling, state changes, chunk assembly, rescans."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from winnow.operators.joins import first_wins
from winnow.operators.scan import security_scan
from winnow.operators.skew import BLOCK, previous_value, running_sums
from winnow.sources.generations import (
    Generation, current_generation, delete_path, drop_unlisted, folders, publish, write_files,
)
from winnow.sources.scratch import scratch_dir
from winnow.streaming.chains import chain_openings

# The typed payload of each event.
EVENT_SCHEMAS = {
    "provider.changed": "provider string, model string",
    "plugin.activated": "pluginId string, displayName string",
    "plugin.deactivated": "pluginId string",
    "ai.request.start": "instruction string, mode string",
    "ai.request.done": "instruction string, tokensUsed bigint",
    "ai.request.error": "instruction string, error string",
    "file.edited": "filePath string, linesChanged bigint",
    "files.created": "filePaths array<string>",
    "editor.fileChanged": "filePath string, language string",
    "context.refreshed": "activePlugins array<string>",
    "ui.notify": "message string, level string",
    "ui.status.update": "",
}
THROTTLE_MICROS = 2_000_000
BLOCKS_PER_WINDOW = 64
PERIOD_MICROS = 24 * 3600 * 1_000_000
BUSY_EVENTS = 1_000_000
BLOCK_EVENTS = 1_000_000
NEVER = np.iinfo(np.int64).min
#: Event time as a number; stateful processors rename columns that begin with an underscore.
MICROS = "event_micros"


# ── running a stream to its end ──────────────────────────────────────────────


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of one parquet table of a folder, a single file or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern with one match: a plain path must be a folder
    return reader.parquet(f"{folder}/{name}.parque[t]")


def run_to_end(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Process what is available now, batch by batch, and stop."""
    query = (
        stream.writeStream.foreachBatch(each_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer whose retry replaces its own earlier attempt."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def sink_table(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table on shared storage and read the table back."""
    spark = stream.sparkSession
    folder = scratch_dir(spark, purpose)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    # an empty first part, so that a stream without any batch still has a table
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/table/batch_id=-1")
    run_to_end(stream, write_batch(f"{folder}/table"), f"{folder}/checkpoint", mode)
    return spark.read.schema(schema).option("basePath", f"{folder}/table").parquet(f"{folder}/table/*")


# ── routing ──────────────────────────────────────────────────────────────────


def typed_events(
    events: DataFrame, event_type: str, schema: str, type_column: str = "event_type", payload: str = "props"
) -> DataFrame:
    """Events of one type with their payload as columns. Works on batches and streams."""
    keep = [c for c in events.columns if c not in (type_column, payload)]
    own = events.filter(F.col(type_column) == event_type)
    if not schema:
        return own.select(*keep)
    return own.select(*keep, F.from_json(payload, schema).alias("p")).select(*keep, "p.*")


def route_events(
    stream: DataFrame,
    schemas: dict[str, str],
    consumers: dict[str, Callable[[DataFrame, int], None]],
    checkpoint: str,
    type_column: str = "event_type",
    payload: str = "props",
) -> None:
    """Hand each event type to its consumer with a typed payload, one source read per batch."""

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for event_type, consume in consumers.items():
                typed = typed_events(batch, event_type, schemas[event_type], type_column, payload)
                consume(typed, batch_id)
        finally:
            batch.unpersist()

    run_to_end(stream, fan_out, checkpoint)


# ── throttling ───────────────────────────────────────────────────────────────


def _chain_starts(times: np.ndarray, i: int, width: int) -> list[int]:
    """Indexes of the events that open a timer, from event ``i`` on."""
    out = []
    while i < len(times):
        out.append(i)
        i = int(np.searchsorted(times, times[i] + width, side="left"))
    return out


def _block_exits(times: np.ndarray, width: int) -> np.ndarray:
    """For each event: when is the last timer of the block free, if that event opens one?"""
    follower = np.searchsorted(times, times + width, side="left")
    exits = times + width
    for i in range(len(times) - 1, -1, -1):
        if follower[i] < len(times):
            exits[i] = exits[follower[i]]
    return exits


def _join_tables(opens, exits, last) -> tuple[np.ndarray, np.ndarray, int]:
    """The table of a longer block from the tables of the blocks it is made of, in order."""
    heads, free = opens[0], exits[0].copy()
    for j in range(1, len(opens)):
        inside = free <= last[j]
        free[inside] = exits[j][np.searchsorted(opens[j], free[inside], side="left")]
        if j == 1:
            # entered after the last event of the first block
            heads, free = np.append(heads, opens[1][0]), np.append(free, exits[1][0])
    return heads, free, int(last[-1])


def _entry_times(start: int, opens, exits, last) -> list[int]:
    """When each of some consecutive blocks is entered, if the first is entered at ``start``."""
    free, entered = start, []
    for o, e, end in zip(opens, exits, last):
        entered.append(free)
        if free <= end:
            free = int(e[int(np.searchsorted(o, free, side="left"))])
    return entered


def _largest_block(events: DataFrame, keys: list[str], micros: str, length: int) -> int:
    """The most events of a key in one stretch of time, each stretch counted map-side."""
    stretch = F.floor(F.col(micros) / length).alias("_stretch")
    counts = events.where(F.col(micros).isNotNull()).groupBy(*keys, stretch).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


_TABLE = "opens array<bigint>, exits array<bigint>, last bigint"


def throttle(
    events: DataFrame,
    keys: list[str],
    micros: str,
    width: int = THROTTLE_MICROS,
    period: int = PERIOD_MICROS,
    busy: int = BUSY_EVENTS,
    block_events: int = BLOCK_EVENTS,
) -> DataFrame:
    """Firings of a timer that the first event opens and later events do not extend.

    ``micros`` is a bigint event time. An event at or after the firing opens
    the next timer. One row per firing: the keys, ``opened`` and ``fired``.
    Events without a time open nothing.

    A count tells whether some key has more than ``block_events`` distinct times in 64
    timer widths. If so, chains are found by pointers that double (see
    ``chain_openings``), where no row holds more than two times. Otherwise blocks
    are folded, and no row holds more than ``busy`` or ``block_events`` times.

    A key is never folded in one piece. Its time is cut into blocks: a period
    (a day) where the key is quiet, 64 timer widths where it has more than
    ``busy`` events in the period. Each block states, for the few events that
    may open its first timer, when its last timer is free. The tables of a
    period join into one that is no larger. Only these are chained per key; the
    times at which blocks are entered then go back down, and every block is
    folded on its own.
    """
    short = BLOCKS_PER_WINDOW * width
    period = max(period, short)
    if _largest_block(events, keys, micros, short) > block_events:
        opened = chain_openings(events, keys, micros, width)
        return opened.withColumn("fired", F.col("opened") + width)

    @F.pandas_udf(_TABLE)
    def summarise(starts: pd.Series, times: pd.Series) -> pd.DataFrame:
        rows = []
        for start, t in zip(starts, times):
            # a timer of an earlier block is free before this block's start + width
            n = min(int(np.searchsorted(t, start + width, side="left")) + 1, len(t))
            rows.append((t[:n], _block_exits(t, width)[:n], int(t[-1])))
        return pd.DataFrame(rows, columns=["opens", "exits", "last"])

    @F.pandas_udf(_TABLE)
    def lengthen(opens: pd.Series, exits: pd.Series, last: pd.Series) -> pd.DataFrame:
        rows = [_join_tables(*r) for r in zip(opens, exits, last)]
        return pd.DataFrame(rows, columns=["opens", "exits", "last"])

    @F.pandas_udf("array<bigint>")
    def enter(start: pd.Series, opens: pd.Series, exits: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([_entry_times(int(s), *r) for s, *r in zip(start, opens, exits, last)])

    @F.pandas_udf("array<bigint>")
    def fire(times: pd.Series, entered: pd.Series) -> pd.Series:
        firsts = (int(np.searchsorted(t, e, side="left")) for t, e in zip(times, entered))
        return pd.Series([t[_chain_starts(t, i, width)] for t, i in zip(times, firsts)])

    # the key as one struct, which is never null itself: rows with null keys join too
    key = "_key"
    unit = [key, "_period"]
    timed = events.filter(F.col(micros).isNotNull()).select(
        F.struct(*keys).alias(key), F.col(micros).alias("t")
    ).withColumn("_period", F.floor(F.col("t") / period).cast("bigint"))
    crowded = timed.groupBy(*unit).agg((F.count("*") > busy).alias("_busy")).filter("_busy")
    # a block is known by its start, so blocks of both lengths stay in time order
    start = F.col("_period") * period
    offset = F.col("t") - start
    start = F.when(F.col("_busy"), start + offset - F.pmod(offset, F.lit(short))).otherwise(start)
    blocks = (
        timed.join(crowded, unit, "left")
        .withColumn(BLOCK, start)
        .groupBy(*unit, BLOCK)
        .agg(F.array_sort(F.collect_set("t")).alias("times"))
    )
    tables = blocks.select(*unit, BLOCK, summarise(BLOCK, "times").alias("s")).select(*unit, BLOCK, "s.*")

    def gather(df: DataFrame, by: list[str], place: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(place, "opens", "exits", "last")))
        return df.groupBy(*by).agg(listed.alias("bs"))

    def entries(df: DataFrame, by: list[str], place: str, entered: Column | str) -> DataFrame:
        times = enter(entered, "bs.opens", "bs.exits", "bs.last")
        pairs = F.arrays_zip(F.col(f"bs.{place}").alias("place"), times.alias("entered"))
        return df.select(*by, F.explode(pairs).alias("e")).select(
            *by, F.col("e.place").alias(place), "e.entered"
        )

    # up: blocks to periods, periods to one chain per key
    periods = gather(tables, unit, BLOCK)
    joined = periods.select(*unit, lengthen("bs.opens", "bs.exits", "bs.last").alias("s"))
    chain = gather(joined.select(*unit, "s.*"), [key], "_period")
    # down: when is each period entered, then each of its blocks
    period_entries = entries(chain, [key], "_period", F.lit(NEVER))
    block_entries = entries(periods.join(period_entries, unit), unit, BLOCK, "entered")
    fired = blocks.join(block_entries, [*unit, BLOCK]).select(
        key, F.explode(fire("times", "entered")).alias("opened")
    )
    return fired.select(f"{key}.*", "opened", (F.col("opened") + width).alias("fired"))


class ThrottleProcessor(StatefulProcessor):
    """Stream form of the throttle: one open timer per key, event time in microseconds."""

    def __init__(self, key: str, micros: str, width: int, expire: bool):
        self.key, self.micros, self.width, self.expire = key, micros, width, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "free bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([p[self.micros].to_numpy(np.int64) for p in rows]))
        free = self.free.get()[0] if self.free.exists() else NEVER
        first = int(np.searchsorted(times, free, side="left"))
        starts = _chain_starts(times, first, self.width)
        if not starts:
            return
        opened = times[starts]
        free = int(opened[-1]) + self.width
        self.free.update((free,))
        if self.expire:
            # no row older than the watermark arrives, so a timer behind it can be forgotten
            self.handle.registerTimer(-(-free // 1000))
        yield pd.DataFrame({self.key: [key[0]] * len(opened), "opened": opened, "fired": opened + self.width})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expired = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.free.exists() and self.free.get()[0] <= expired:
            self.free.clear()
        return iter(())

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: With it a batch stores what it changed of the state, without it every partition's whole files, batch after batch.
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"
#: State partitions for each core of the cluster, and the fewest. Every batch opens and commits them all, even empty ones.
STATE_PARTITIONS_PER_CORE, LEAST_STATE_PARTITIONS = 2, 32


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Use the state store that arbitrary stateful operators need, for queries started inside.

    A batch costs by its rows: only changes of the state are stored, over as many partitions as keep the cores busy, or
    as the session shuffles over if that is less.
    """
    cores = spark.sparkContext.defaultParallelism
    partitions = max(STATE_PARTITIONS_PER_CORE * cores, LEAST_STATE_PARTITIONS)
    settings = {
        STATE_STORE: ROCKSDB, CHANGELOG: "true", PARTITIONS: str(min(partitions, int(spark.conf.get(PARTITIONS)))),
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def throttle_stream(
    stream: DataFrame,
    key: str,
    micros: str,
    width: int = THROTTLE_MICROS,
    event_time: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """Throttle as a stateful stream. The session must use the RocksDB state store.

    Batches must arrive in time order per key; an event older than the open
    timer is absorbed by it. With ``event_time``, a timestamp column, rows later
    than ``delay`` are dropped and the state of quiet keys is removed.
    """
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, opened bigint, fired bigint"
    if event_time:
        chosen = stream.select(key, micros, event_time).withWatermark(event_time, delay)
    else:
        chosen = stream.select(key, micros)
    return chosen.groupBy(key).transformWithStateInPandas(
        ThrottleProcessor(key, micros, width, expire=event_time is not None),
        schema,
        "Append",
        "EventTime" if event_time else "None",
    )


# ── state changes ────────────────────────────────────────────────────────────


def activation_changes(events: DataFrame, key: str, flag: str, order: list[str], block: Column) -> DataFrame:
    """``activated`` and ``deactivated`` rows, only where the flag of a key changes.

    A key starts inactive. ``block`` cuts the history of a key into time buckets.
    """
    seen = previous_value(events, [key], order, flag, block, "_previous")
    before = F.coalesce("_previous", F.lit(False))
    return (
        seen.filter(F.col(flag) != before)
        .withColumn("change", F.when(F.col(flag), "activated").otherwise("deactivated"))
        .drop("_previous")
    )


class ActivationProcessor(StatefulProcessor):
    """Stream form of the state change filter: the last flag per key."""

    def __init__(self, key: str, flag: str, order: list[str]):
        self.key, self.flag, self.order = key, flag, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "flag boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, ignore_index=True)
        first = bool(self.last.get()[0]) if self.last.exists() else False
        flags = pdf[self.flag].astype(bool)
        changed = pdf[flags != flags.shift(fill_value=first)]
        self.last.update((bool(flags.iloc[-1]),))
        if len(changed):
            names = np.where(changed[self.flag].astype(bool), "activated", "deactivated")
            yield changed[[self.key, *self.order]].assign(change=names)

    def close(self) -> None:
        pass


#: Rows of a key that wait in one value with its flag, and rows that are taken at a time; more wait in a list, so many in each item.
WAITING_ROWS, TAKEN_ROWS = 1000, 10_000


def _packed(rows: list | dict) -> bytes | None:
    """What waits, as one value of the state: to read or write it is one call, however much it is."""
    return pickle.dumps(rows) if rows else None


class OrderedActivationProcessor(StatefulProcessor):
    """The state change filter in event time: rows wait until the watermark passes them and are then taken in order.

    A batch reads and writes the state of a key once. The rows of a key with many of them are not in it but in a list,
    to which those of a batch are only added.
    """

    def __init__(self, key: str, flag: str, order: list[str], forget_micros: int | None):
        self.key, self.flag, self.order, self.forget = key, flag, order, forget_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "flag boolean, at bigint")
        # the timer, the rows that wait for it, and whether more do in the list
        self.timer = handle.getValueState("timer", "at bigint, waiting binary, more boolean")
        self.rows = handle.getListState("rows", "waiting binary")
        self.out = Row(self.key, *self.order, "change")

    def _wake(self, set_for: int | None, micros: int) -> int:
        """Have a timer no later than that; one timer at a time."""
        at = -(-micros // 1000)
        if set_for is not None:
            if set_for <= at:
                return set_for
            self.handle.deleteTimer(set_for)
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # not in the plan: a filter would move below the watermark
        told = ((r[MICROS], *[r[c] for c in self.order], r[self.flag]) for r in rows if r[self.flag] is not None)
        first, timer, waiting, more = None, None, [], False
        while arrived := list(islice(told, TAKEN_ROWS)):
            if first is None and (kept := self.timer.get()):
                timer, held, more = kept
                waiting = pickle.loads(held) if held else []
            waiting += arrived
            if len(waiting) > WAITING_ROWS:
                starts = range(0, len(waiting), WAITING_ROWS)
                self.rows.appendList([(_packed(waiting[i : i + WAITING_ROWS]),) for i in starts])
                waiting, more = [], True
            own = min(r[0] for r in arrived)
            first = own if first is None else min(first, own)
        if first is not None:
            self.timer.update((self._wake(timer, first), _packed(waiting), more))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.timer.get()
        if not kept:
            return
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        _, held, more = kept
        waiting = pickle.loads(held) if held else []
        if more:
            for (pack,) in self.rows.get():
                waiting += pickle.loads(pack)
            self.rows.clear()
        ready = sorted((r for r in waiting if r[0] <= reached), key=lambda r: r[1:-1])
        rest = [r for r in waiting if r[0] > reached]
        before = self.last.get()
        flag, at = before or (False, reached)
        for r in ready:
            if flag and self.forget is not None and r[0] - at >= self.forget:
                flag = False
            if bool(r[-1]) != flag:
                flag = bool(r[-1])
                yield self.out(key[0], *r[1:-1], "activated" if flag else "deactivated")
            at = r[0]
        more = len(rest) > WAITING_ROWS
        if more:
            self.rows.put([(_packed(rest[i : i + WAITING_ROWS]),) for i in range(0, len(rest), WAITING_ROWS)])
        timer = self._wake(None, min(r[0] for r in rest)) if rest else None
        quiet = self.forget is not None and reached >= at + self.forget
        if flag and not (quiet and not rest):
            if (flag, at) != before:
                self.last.update((flag, at))
            if self.forget is not None and not rest:
                timer = self._wake(None, at + self.forget)
        elif before:
            # a key without state is inactive, so nothing is lost with it
            self.last.clear()
        if timer is None:
            self.timer.clear()
        else:
            self.timer.update((timer, None if more else _packed(rest), more))

    def close(self) -> None:
        pass


def _micros(duration: str) -> int:
    return pd.Timedelta(duration) // pd.Timedelta(microseconds=1)


def activation_stream(
    stream: DataFrame,
    key: str,
    flag: str,
    order: list[str],
    event_time: str | None = None,
    delay: str = "10 minutes",
    forget: str | None = None,
) -> DataFrame:
    """State changes as a stateful stream. The session must use the RocksDB state store.

    Without ``event_time``, batches must arrive in ``order`` per key. With it, a timestamp column, rows may arrive
    in any order up to ``delay`` late: they wait until the watermark has passed them. A key that is inactive then
    leaves no state; an active one that is quiet for ``forget`` is taken for inactive, if that is given.
    Rows without a flag only move the watermark, as a heartbeat does.
    """
    fields = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in [key, *order])
    if event_time is None:
        return (
            stream.where(F.col(flag).isNotNull())
            .select(key, flag, *order)
            .groupBy(key)
            .transformWithStateInPandas(
                ActivationProcessor(key, flag, order), f"{fields}, change string", "Append", "None"
            )
        )
    kept = [c for c in dict.fromkeys([key, flag, *order, event_time])]
    processor = OrderedActivationProcessor(key, flag, order, None if forget is None else _micros(forget))
    return (
        stream.withWatermark(event_time, delay)
        .select(*kept, F.unix_micros(event_time).alias(MICROS))
        .groupBy(key)
        .transformWithState(processor, f"{fields}, change string", "Append", "EventTime")
    )


# ── chunk assembly ───────────────────────────────────────────────────────────

# Stream line markers and the paths of a text delta, tried in order.
SSE_PREFIX = "data:"
SSE_DONE = "[DONE]"
DELTA_PATHS = ["$.message.content", "$.delta.text", "$.choices[0].delta.content"]


def line_delta(line: Column | str, paths: list[str] = DELTA_PATHS) -> Column:
    """Text delta of one line: JSON, or ``data:`` JSON; anything else is empty."""
    line = F.col(line) if isinstance(line, str) else line
    body = F.when(
        F.startswith(line, F.lit(SSE_PREFIX)), F.substring(line, len(SSE_PREFIX) + 1, 1 << 30)
    ).otherwise(line)
    delta = F.coalesce(*[F.get_json_object(body, p) for p in paths], F.lit(""))
    return F.when(F.contains(line, F.lit(SSE_DONE)), "").otherwise(delta)


CHUNKS_PER_BLOCK = 16_384


def assemble_lines(chunks: DataFrame) -> DataFrame:
    """Whole lines from byte chunks. ``chunks``: request, seq, data.

    A piece belongs to the line whose number is the count of newlines before
    it in the request, so a line may span any number of chunks and no request
    has to fit in one task. Blank lines are skipped.
    """
    counted = running_sums(
        chunks,
        ["request"],
        ["seq"],
        {"newlines": F.regexp_count("data", F.lit("\n"))},
        F.floor(F.col("seq") / CHUNKS_PER_BLOCK),
    )
    before = F.col("newlines") - F.regexp_count("data", F.lit("\n"))
    pieces = counted.select(
        "request", "seq", before.alias("before"), F.posexplode(F.split("data", "\n")).alias("i", "piece")
    )
    lines = (
        pieces.filter(F.col("piece") != "")
        .groupBy("request", (F.col("before") + F.col("i")).alias("line_no"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("ps"))
    )
    text = F.array_join(F.transform("ps", lambda p: p["piece"]), "")
    return lines.select("request", "line_no", text.alias("line")).filter(F.btrim("line") != "")


def assemble_deltas(chunks: DataFrame, paths: list[str] = DELTA_PATHS) -> DataFrame:
    """Non-empty text deltas per request and line."""
    lines = assemble_lines(chunks).withColumn("delta", line_delta("line", paths))
    return lines.filter(F.col("delta") != "").select("request", "line_no", "delta")


def assemble_text(chunks: DataFrame, paths: list[str] = DELTA_PATHS) -> DataFrame:
    """The answer text of each request: its deltas in order. A request is one message."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "delta")))
    joined = assemble_deltas(chunks, paths).groupBy("request").agg(ordered.alias("ds"))
    return joined.select("request", F.array_join(F.transform("ds", lambda d: d["delta"]), "").alias("text"))


#: Chunks in a block of those that wait.
WAITING_CHUNKS = 256


class LineProcessor(StatefulProcessor):
    """Stream form of the line assembly: chunks ahead of their turn wait, the others are taken in sequence.

    Of each request the unfinished tail, the number of its lines and of the next chunk are kept, and the chunks that
    wait, by number, until it ends: with its last chunk or, in event time, after a silence. Chunks of the block whose
    turn it is wait beside the tail, so a batch reads and writes the state of a short request once; those of later
    blocks wait block by block.
    """

    def __init__(self, event_time: str | None = None, silence_micros: int = 0):
        self.event_time, self.silence = event_time, silence_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState(
            "carry", "tail string, n_lines bigint, next bigint, timer bigint, waiting binary, n_later bigint"
        )
        self.later = handle.getMapState("waiting", "block bigint", "chunks binary")
        self.out = Row("request", "line_no", "line")

    def _block(self, block: int) -> dict | None:
        held = self.later.getValue((block,))
        return pickle.loads(held[0]) if held else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # not in the plan: a filter would move below the watermark
            return
        tail, n, due, timer, held, n_later = self.carry.get() or ("", 0, 0, None, None, 0)
        here = pickle.loads(held) if held else {}
        ended, latest, stored = False, None, n_later
        while not ended and (taken := list(islice(rows, TAKEN_ROWS))):
            ahead: dict[int, dict] = {}
            for r in taken:
                seq = r["seq"]
                if seq is not None and seq >= due:  # not a chunk that comes again
                    block = seq // WAITING_CHUNKS
                    own = here if block == due // WAITING_CHUNKS else ahead.setdefault(block, {})
                    own[seq] = (r["data"] or "", r["ends"])
            if self.event_time:
                newest = max(r[self.event_time] for r in taken)
                latest = newest if latest is None else max(latest, newest)
            parts = [tail]
            while not ended and due in here:
                data, ended = here.pop(due)
                parts.append(data)
                due += 1
                if due % WAITING_CHUNKS == 0 and not ended:
                    block = due // WAITING_CHUNKS
                    here = ahead.pop(block, {})
                    if n_later and (before := self._block(block)) is not None:
                        self.later.removeKey((block,))
                        n_later -= 1
                        here = before | here
            *whole, tail = "".join(parts).split("\n")
            if ended:
                whole.append(tail)
            else:
                for block, chunks in ahead.items():
                    before = self._block(block) if n_later else None
                    n_later += before is None
                    stored += before is None
                    self.later.updateValue((block,), (_packed((before or {}) | chunks),))
            yield from self._lines(key, n, whole)
            n += len(whole)
        if ended:
            self._forget(timer, stored > 0)
            return
        if latest is not None:
            at = -(-(latest + self.silence) // 1000)
            if timer is None or at > timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at)
                timer = at
        self.carry.update((tail, n, due, timer, _packed(here), n_later))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A silent request ends: what waits behind a lost chunk follows, and its last line needs no newline."""
        kept = self.carry.get()
        if not kept:
            return
        tail, n, _, timer, held, n_later = kept
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        waiting = pickle.loads(held) if held else {}
        if n_later:
            for pack in list(self.later.values()):
                waiting |= pickle.loads(pack[0])
        data = "".join(waiting[seq][0] for seq in sorted(waiting))
        yield from self._lines(key, n, (tail + data).split("\n"))
        self._forget(None, n_later > 0)

    def _lines(self, key, n: int, lines: list[str]) -> Iterator[Row]:
        for i, line in enumerate(lines):
            if line.strip():
                yield self.out(key[0], n + i, line)

    def _forget(self, timer: int | None, later: bool) -> None:
        self.carry.clear()
        if later:
            self.later.clear()
        if timer is not None:
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def assemble_stream(
    stream: DataFrame,
    ends: Column | None = None,
    event_time: str | None = None,
    delay: str = "10 minutes",
    silence: str = "30 minutes",
) -> DataFrame:
    """Finished lines as a stateful stream; chunks of a request, numbered from 0, may arrive in any order.

    A chunk that is ahead waits for those before it; one that comes twice counts once. ``ends`` tells the last chunk
    of a request: its last line needs no newline, and nothing is remembered of the request from then on. With
    ``event_time``, a timestamp column, chunks more than ``delay`` late are dropped, and a request that is silent for
    ``silence`` ends as well: chunks behind one that is lost follow without it. Rows without a request only move the watermark.
    """
    key_type = stream.schema["request"].dataType.simpleString()
    mark = F.lit(False) if ends is None else F.coalesce(ends, F.lit(False))
    columns = ["request", F.col("seq").cast("bigint").alias("seq"), "data", mark.alias("ends")]
    processor, mode = LineProcessor(), "None"
    if event_time:
        stream = stream.withWatermark(event_time, delay)
        processor, mode = LineProcessor(MICROS, _micros(silence)), "EventTime"
        columns += [event_time, F.unix_micros(event_time).alias(MICROS)]
    return (
        stream.select(*columns)
        .groupBy("request")
        .transformWithState(processor, f"request {key_type}, line_no bigint, line string", "Append", mode)
    )


# ── rescans, tails, counts, new files ────────────────────────────────────────


def incremental_scan(
    stream: DataFrame, store: str, checkpoint: str, path: str = "path", order: str | None = None
) -> None:
    """Scan documents as they arrive; the newest scan of a document replaces its findings.

    Each batch writes its findings and the list of documents it scanned under
    its own batch id, so a retried batch replaces only itself. See
    ``current_findings`` for the replacement and ``compact_findings`` for what keeps
    the store small. Where a document may arrive more than once in a batch, ``order``
    names the column that tells its newest text.
    """

    def scan(batch: DataFrame, batch_id: int) -> None:
        newest = first_wins(batch, path, [F.desc(order)]) if order else batch
        security_scan(newest).write.mode("overwrite").parquet(f"{store}/findings/batch_id={batch_id}")
        batch.select(path).distinct().write.mode("overwrite").parquet(
            f"{store}/scanned/batch_id={batch_id}"
        )

    run_to_end(stream, scan, checkpoint)


def _batches_after(spark: SparkSession, store: str, kind: str, mark: int) -> list[str]:
    """The folders of batches that are not in the compacted findings."""
    numbers = (int(f.removeprefix("batch_id=")) for f in folders(spark, f"{store}/{kind}"))
    return [f"{store}/{kind}/batch_id={n}" for n in sorted(numbers) if n > mark]


def _findings_since(spark: SparkSession, store: str, path: str, mark: int) -> tuple[DataFrame, DataFrame] | None:
    """Findings of the newest scan of each document in the batches after ``mark``, and the documents they scanned."""
    parts = _batches_after(spark, store, "scanned", mark)
    if not parts:
        return None
    scanned = spark.read.option("basePath", f"{store}/scanned").parquet(*parts)
    found = spark.read.option("basePath", f"{store}/findings").parquet(*_batches_after(spark, store, "findings", mark))
    newest = scanned.groupBy(path).agg(F.max("batch_id").alias("batch_id"))
    return found.join(newest, [path, "batch_id"], "left_semi").drop("batch_id"), newest.select(path)


def current_findings(spark: SparkSession, store: str, path: str = "path") -> DataFrame:
    """Findings of the newest scan of each document: the compacted ones, but for documents scanned since, and these scans'."""
    base = current_generation(spark, store)
    since = _findings_since(spark, store, path, base.mark)
    if since is None:
        if not base.files:
            raise ValueError(f"{store}: nothing scanned yet")
        return spark.read.parquet(*base.files)
    found, scanned = since
    if not base.files:
        return found
    return spark.read.parquet(*base.files).join(scanned, path, "left_anti").unionByName(found)


def compact_findings(spark: SparkSession, store: str, path: str = "path") -> Generation:
    """Write the current findings as one generation, which then stands for all batches up to now.

    The new files count from the moment their manifest is in place. A compaction that is cut off before changes nothing,
    and one that is cut off after it only leaves files that ``drop_superseded`` removes. Batches that end meanwhile are
    later than its mark and stay.
    """
    base = current_generation(spark, store)
    numbers = [int(p.rsplit("=", 1)[1]) for p in _batches_after(spark, store, "scanned", base.mark)]
    if not numbers:
        return base
    files = write_files(current_findings(spark, store, path), store)
    return publish(spark, store, files, base, max(numbers))


def drop_superseded(spark: SparkSession, store: str) -> None:
    """Delete the batches that the current generation stands for, and files of older generations.

    Afterwards the store holds one scan of each document. Not while older findings are being read.
    """
    mark = current_generation(spark, store).mark
    for kind in ("findings", "scanned"):
        for f in folders(spark, f"{store}/{kind}"):
            if int(f.removeprefix("batch_id=")) <= mark:
                delete_path(spark, f"{store}/{kind}/{f}")
    drop_unlisted(spark, store)


def tail_logs(stream: DataFrame, pattern: str, start: Column, message: str = "message", ts: str = "ts") -> DataFrame:
    """New log rows that hold a text, from a start time; the checkpoint keeps the position."""
    return stream.filter(F.contains(message, F.lit(pattern)) & (F.col(ts) >= start))


def outcome_counts(
    stream: DataFrame, outcomes: dict[str, str], ts: str = "ts", type_column: str = "event_type"
) -> DataFrame:
    """Per hour, how many requests started, ended well and failed.

    ``outcomes`` maps event types to outcome names. Rows later than ten minutes
    behind the newest are dropped, which bounds the state.
    """
    pairs = [F.lit(x) for kv in outcomes.items() for x in kv]
    named = stream.withColumn("outcome", F.try_element_at(F.create_map(*pairs), F.col(type_column)))
    return (
        named.filter(F.col("outcome").isNotNull())
        # event time must carry a zone; a plain time is read in the session zone
        .withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, "10 minutes")
        .groupBy(F.window(ts, "1 hour"), "outcome")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("hour"), "outcome", "n")
    )


def latest_counts(updates: DataFrame) -> DataFrame:
    """Last value of each hour and outcome from the updates of all batches."""
    return updates.groupBy("hour", "outcome").agg(F.max_by("n", "batch_id").alias("n"))


def incremental_files(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet") -> DataFrame:
    """Stream of the files that arrived since the last run."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


