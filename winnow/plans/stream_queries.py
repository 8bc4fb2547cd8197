"""Event streams and user code, each run to its end and read back as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import trim_space
from winnow.operators import hooks
from winnow.operators.packs import cloud, containers, infra, stacks
from winnow.operators.packs.default_hooks import DEFAULT_HOOKS
from winnow.plans.registry import Source, query
from winnow.plans.text_queries import _rule_sql, epoch_micros, lines_sql
from winnow.sources.scratch import scratch_dir
from winnow.streaming import events as ev
from winnow.streaming.chains import chain_openings

# ── routing, tails, counts ───────────────────────────────────────────────────

_PROPS = "k bigint"


@query(
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS sum_k
       FROM events GROUP BY event_type"""
)
def routed_events(src: Source) -> DataFrame:
    """Every event type, each handed to its own consumer with a typed payload."""
    folder = scratch_dir(src.spark, "routes")
    kinds = ["click", "error", "purchase", "signup", "view"]

    def consumer(kind: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            target = f"{folder}/out/event_type={kind}/batch_id={batch_id}"
            batch.write.mode("overwrite").parquet(target)

        return write

    stream = ev.read_stream(src.spark, src.folder, "events")
    ev.route_events(
        stream, {k: _PROPS for k in kinds}, {k: consumer(k) for k in kinds}, f"{folder}/checkpoint"
    )
    routed = src.spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/*/*")
    return routed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"))


_KINDS = list(ev.EVENT_SCHEMAS)


def payload_events(src: Source) -> DataFrame:
    """The events as the twelve kinds of a typed bus, each with a payload of its own fields as JSON."""
    text = lambda name: F.concat(F.lit(f"{name} "), F.col("user_id").cast("string"))

    def value(name: str, kind: str) -> Column:
        own = F.col("event_id") if kind == "bigint" else text(name)
        return F.array(own, F.lit("b")) if kind == "array<string>" else own

    payload = F.lit("{}")
    for i, (kind, schema) in enumerate(ev.EVENT_SCHEMAS.items()):
        fields = [f.split(" ") for f in schema.split(", ")] if schema else []
        own = F.to_json(F.struct(*[value(n, t).alias(n) for n, t in fields])) if fields else F.lit("{}")
        payload = F.when(F.col("event_id") % len(_KINDS) == i, own).otherwise(payload)
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    kind = kinds[(F.col("event_id") % len(_KINDS)).cast("int")]
    return src("events").select("event_id", "user_id", kind.alias("event_type"), payload.alias("props"))


def _payload_sql() -> str:
    parts = []
    for i, (kind, schema) in enumerate(ev.EVENT_SCHEMAS.items()):
        fields = [f.split(" ") for f in schema.split(", ")] if schema else []
        texts = {
            "string": "'{0} ' || user_id", "bigint": "CAST(event_id AS VARCHAR)", "array<string>": "'{0} ' || user_id || '+b'",
        }
        line = " || '|' || ".join(texts[t].format(n) for n, t in fields) or "''"
        parts.append(f"SELECT event_id, '{kind}' AS event_type, {line} AS payload FROM events WHERE event_id % {len(_KINDS)} = {i}")
    return " UNION ALL ".join(parts)


@query(_payload_sql())
def routed_payloads(src: Source) -> DataFrame:
    """All twelve kinds of events, each handed to a consumer that sees the fields of its kind as columns."""
    folder = scratch_dir(src.spark, "payloads")
    payload_events(src).repartition(4).write.parquet(f"{folder}/in")
    stream = src.spark.readStream.schema("event_id long, user_id long, event_type string, props string")

    def consumer(kind: str):
        fields = [f.split(" ") for f in ev.EVENT_SCHEMAS[kind].split(", ")] if ev.EVENT_SCHEMAS[kind] else []
        texts = [F.array_join(n, "+") if t == "array<string>" else F.col(n).cast("string") for n, t in fields]

        def write(batch: DataFrame, batch_id: int) -> None:
            rows = batch.select("event_id", F.lit(kind).alias("event_type"), F.concat_ws("|", *texts).alias("payload"))
            rows.write.mode("overwrite").parquet(f"{folder}/out/kind={_KINDS.index(kind)}/batch_id={batch_id}")

        return write

    stream = stream.option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    ev.route_events(stream, ev.EVENT_SCHEMAS, {k: consumer(k) for k in _KINDS}, f"{folder}/checkpoint")
    return src.spark.read.parquet(f"{folder}/out").select("event_id", "event_type", "payload")


@query("SELECT event_id, user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE event_type = 'signup'")
def typed_signups(src: Source) -> DataFrame:
    typed = ev.typed_events(src("events"), "signup", _PROPS)
    return typed.select("event_id", "user_id", "k")


@query(
    """SELECT event_id, event_type FROM events
       WHERE contains(event_type, 'err') AND ts >= TIMESTAMP '2024-01-10 00:00:00'"""
)
def tailed_logs(src: Source) -> DataFrame:
    stream = ev.read_stream(src.spark, src.folder, "events")
    start = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    tail = ev.tail_logs(stream, "err", start, message="event_type")
    return ev.sink_table(tail.select("event_id", "event_type"), "tail").drop("batch_id")


@query(
    """SELECT event_id, event_type FROM events
       WHERE contains(event_type, 'err') AND ts >= TIMESTAMP '2024-01-10 00:00:00'"""
)
def tailed_logs_resumed(src: Source) -> DataFrame:
    """A tail that stops and goes on twice: its checkpoint holds the place, so no row comes twice and none is missed."""
    folder, events = scratch_dir(src.spark, "resumed"), src("events").select("event_id", "event_type", "ts")
    start = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{folder}/in")
        stream = ev.incremental_files(src.spark, f"{folder}/in", events.schema)
        tail = ev.tail_logs(stream, "err", start, message="event_type").select("event_id", "event_type")
        ev.run_to_end(tail, ev.write_batch(f"{folder}/out"), f"{folder}/checkpoint")
    return src.spark.read.parquet(f"{folder}/out").select("event_id", "event_type")


@query(
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour,
              CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS outcome,
              count(*) AS n
       FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1, 2"""
)
def hourly_outcomes(src: Source) -> DataFrame:
    stream = ev.read_stream(src.spark, src.folder, "events")
    outcomes = {"signup": "started", "purchase": "done", "error": "failed"}
    updates = ev.sink_table(ev.outcome_counts(stream, outcomes), "outcomes", mode="update")
    latest = ev.latest_counts(updates)
    return latest.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


# ── throttling ───────────────────────────────────────────────────────────────

_SIX_HOURS = 6 * 3600 * 1_000_000


def _throttle_sql(width: int, name: str) -> str:
    return f"""WITH RECURSIVE e AS (
         SELECT {name} AS id, epoch_us(ts) AS t FROM events),
       fired AS (
         SELECT id, min(t) AS opened FROM e GROUP BY id
         UNION ALL
         SELECT id, opened FROM (
           SELECT f.id, (SELECT min(t) FROM e WHERE e.id = f.id AND e.t >= f.opened + {width}) AS opened FROM fired f) n
         WHERE opened IS NOT NULL)
       SELECT id, opened, opened + {width} AS fired FROM fired"""


@query(_throttle_sql(_SIX_HOURS, "user_id"))
def throttled_users(src: Source) -> DataFrame:
    timed = src("events").select(F.col("user_id").alias("id"), epoch_micros("ts").alias("micros"))
    return ev.throttle(timed, ["id"], "micros", _SIX_HOURS)


@query(_throttle_sql(_SIX_HOURS, "0::BIGINT"))
def throttled_single_key(src: Source) -> DataFrame:
    """One key that holds every row: where it is busy, short blocks keep it spread over tasks."""
    timed = src("events").select(F.lit(0).cast("bigint").alias("id"), epoch_micros("ts").alias("micros"))
    return ev.throttle(timed, ["id"], "micros", _SIX_HOURS, period=100 * _SIX_HOURS, busy=500)


_MONTH = 30 * 24 * 3600 * 1_000_000


@query(_throttle_sql(_MONTH, "0::BIGINT"))
def throttled_single_key_month(src: Source) -> DataFrame:
    """A timer of a month on a key that holds every row: its events are never gathered."""
    timed = src("events").select(F.lit(0).cast("bigint").alias("id"), epoch_micros("ts").alias("micros"))
    return ev.throttle(timed, ["id"], "micros", _MONTH, block_events=1000)


@query(_throttle_sql(_SIX_HOURS, "user_id"))
def throttled_users_by_pointers(src: Source) -> DataFrame:
    """The openings of every user by pointers that double, whatever the blocks hold."""
    timed = src("events").select(F.col("user_id").alias("id"), epoch_micros("ts").alias("micros"))
    return chain_openings(timed, ["id"], "micros", _SIX_HOURS).withColumn("fired", F.col("opened") + _SIX_HOURS)


@query(_throttle_sql(_SIX_HOURS, "user_id"))
def throttled_stream(src: Source) -> DataFrame:
    stream = ev.read_stream(src.spark, src.folder, "events")
    timed = stream.select(F.col("user_id").alias("id"), epoch_micros("ts").alias("micros"))
    with ev.rocksdb_state(src.spark):
        return ev.sink_table(ev.throttle_stream(timed, "id", "micros", _SIX_HOURS), "throttle").drop(
            "batch_id"
        )


# ── state changes ────────────────────────────────────────────────────────────

_CHANGES = """SELECT user_id, event_id, CASE WHEN active THEN 'activated' ELSE 'deactivated' END AS change
       FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS before
             FROM <<activations>>) a WHERE active <> before"""


@query(_CHANGES)
def activation_changes(src: Source) -> DataFrame:
    changes = ev.activation_changes(
        src("activations"), "user_id", "active", ["ts", "event_id"], F.date_trunc("hour", "ts")
    )
    return changes.select("user_id", "event_id", "change")


@query(_CHANGES)
def activation_changes_unordered(src: Source) -> DataFrame:
    """Events that arrive up to eight days late, taken in the order of their time; a heartbeat ends the stream."""
    folder = scratch_dir(src.spark, "unordered")
    flagged = src("events").select(
        "user_id", "ts", "event_id", (F.col("value") > 34.59).alias("active"), F.col("ts").cast("timestamp").alias("at")
    )
    # every second event is one file later than its time; the files overlap
    day = F.unix_date(F.to_date("ts"))
    part = F.floor(day / 4).cast("int") + (F.xxhash64("event_id") % 2 == 0).cast("int")
    placed = flagged.withColumn("part", part)
    # the events are read once, whatever time they span; then each file is written from its own part, in order
    placed.where("part IS NOT NULL").write.partitionBy("part").parquet(f"{folder}-parts")
    parts = src.spark.read.schema(placed.schema).parquet(f"{folder}-parts")
    for p in sorted(r["part"] for r in parts.select("part").distinct().collect()):
        parts.where(F.col("part") == p).drop("part").repartition(1).write.parquet(f"{folder}/{p:09d}")
    beat = [F.lit(None).cast(t).alias(c) for c, t in flagged.dtypes if c != "at"]
    far = src.spark.range(1).select(*beat, F.lit("2100-01-01").cast("timestamp").alias("at"))
    far.write.parquet(f"{folder}/999999999")
    stream = src.spark.readStream.schema(flagged.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    with ev.rocksdb_state(src.spark):
        changes = ev.activation_stream(stream, "user_id", "active", ["ts", "event_id"], event_time="at", delay="9 days")
        return ev.sink_table(changes, "activation").select("user_id", "event_id", "change")


@query(_CHANGES)
def activation_change_stream(src: Source) -> DataFrame:
    stream = ev.read_stream(src.spark, src.folder, "events")
    flagged = stream.select("user_id", "ts", "event_id", (F.col("value") > 34.59).alias("active"))
    with ev.rocksdb_state(src.spark):
        changes = ev.activation_stream(flagged, "user_id", "active", ["ts", "event_id"])
        return ev.sink_table(changes, "activation").select("user_id", "event_id", "change")


# ── chunk assembly ───────────────────────────────────────────────────────────

PIECE, CHUNK = 20, 33


def answer_chunks(src: Source) -> DataFrame:
    """Each message as a stream of JSON lines, cut into chunks that ignore line ends.

    Even turns are plain JSON lines, odd turns ``data:`` lines with blank lines,
    a line that is not JSON and a closing mark.
    """
    n_pieces = F.greatest(F.ceil(F.length("text") / PIECE), F.lit(1)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), n_pieces - 1), lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE))
    )
    plain = F.transform(
        pieces, lambda p: F.to_json(F.struct(F.struct(p.alias("content")).alias("message")))
    )
    events = F.transform(
        pieces,
        lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.struct(p.alias("text")).alias("delta")))),
    )
    body = F.when(F.col("turn") % 2 == 0, F.array_join(plain, "\n")).otherwise(
        F.concat(F.lit("data: {oops\n\n"), F.array_join(events, "\n\n"), F.lit("\ndata: [DONE]\n"))
    )
    cut = F.sequence(F.lit(0), F.floor((F.length("body") - 1) / CHUNK).cast("int"))
    return (
        src("conversations")
        .select(F.concat_ws("-", "conv_id", "turn").alias("request"), body.alias("body"))
        .select("request", "body", F.explode(cut).alias("seq"))
        .select(
            "request",
            "seq",
            F.substring("body", F.col("seq") * CHUNK + 1, F.lit(CHUNK)).alias("data"),
            ((F.col("seq") + 1) * CHUNK >= F.length("body")).alias("ends"),
        )
    )


@query("SELECT conv_id || '-' || turn AS request, text FROM conversations WHERE text <> ''")
def answers_assembled(src: Source) -> DataFrame:
    return ev.assemble_text(answer_chunks(src))


@query(
    """SELECT conv_id || '-' || turn AS request, CAST(ceil(length(text) / 20.0) AS BIGINT)
              + CASE WHEN turn % 2 = 0 THEN 0 ELSE 2 END AS n_lines
       FROM conversations WHERE text <> ''"""
)
def answer_lines(src: Source) -> DataFrame:
    lines = ev.assemble_lines(answer_chunks(src))
    return lines.groupBy("request").agg(F.count("*").alias("n_lines"))


@query(
    """SELECT conv_id || '-' || turn AS request, CAST(ceil(length(text) / 20.0) AS BIGINT)
              + CASE WHEN turn % 2 = 0 THEN 0 ELSE 2 END AS n_lines
       FROM conversations WHERE text <> ''"""
)
def answer_line_stream(src: Source) -> DataFrame:
    """The chunks as a stream, in files and batches without any order; plain answers end on a chunk that is marked as the last."""
    folder = scratch_dir(src.spark, "chunks")
    answer_chunks(src).repartition(6, F.xxhash64("request", "seq")).write.parquet(f"{folder}/in")
    stream = src.spark.readStream.schema("request string, seq int, data string, ends boolean")
    stream = stream.option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    with ev.rocksdb_state(src.spark):
        lines = ev.sink_table(ev.assemble_stream(stream, F.col("ends")), "lines")
    return lines.groupBy("request").agg(F.count("*").alias("n_lines"))


# ── rescans and new files ────────────────────────────────────────────────────


_RESCANNED = (
    """SELECT rule_id, count(*) AS n FROM (%s) f GROUP BY rule_id"""
    % _rule_sql(
        lines_sql(
            "(SELECT path, CASE WHEN path LIKE '%1.py' THEN 'import os' || chr(10) || 'h = hashlib.md5(x)' ELSE content END AS content"
            " FROM <<risky_files>>) r",
            "path",
            "content",
        ),
        "path",
    )
)


@query(_RESCANNED)
def rescanned_files(src: Source) -> DataFrame:
    """All files arrive, then some arrive again with new content; the newest findings count."""
    return _rescanned(src, compact=False)


@query(_RESCANNED)
def rescanned_files_compacted(src: Source) -> DataFrame:
    """The same with a compaction after each arrival: the store holds one scan of each file."""
    return _rescanned(src, compact=True)


def _rescanned(src: Source, compact: bool) -> DataFrame:
    folder = scratch_dir(src.spark, "rescan")
    files = src("risky_files").select("path", "content")
    saved = files.filter(F.endswith("path", F.lit("1.py"))).withColumn(
        "content", F.lit("import os\nh = hashlib.md5(x)")
    )
    arriving, store = f"{folder}/arriving", f"{folder}/store"
    for batch in (files, saved):
        batch.write.mode("append").parquet(arriving)
        stream = ev.incremental_files(src.spark, arriving, files.schema)
        ev.incremental_scan(stream, store, f"{folder}/checkpoint")
        if compact:
            ev.compact_findings(src.spark, store)
            ev.drop_superseded(src.spark, store)
    current = ev.current_findings(src.spark, store)
    return current.groupBy("rule_id").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def new_files_only(src: Source) -> DataFrame:
    """Three arrivals, one run after each; every file is read exactly once."""
    folder = scratch_dir(src.spark, "arrivals")
    events = src("events").select("event_id", "event_type")
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{folder}/in")
        stream = ev.incremental_files(src.spark, f"{folder}/in", events.schema)
        ev.run_to_end(stream, _numbered(f"{folder}/out"), f"{folder}/checkpoint")
    seen = src.spark.read.parquet(f"{folder}/out")
    return seen.groupBy("event_type").agg(F.count("*").alias("n"))


def _numbered(path: str):
    return ev.write_batch(path)


# ── user code ────────────────────────────────────────────────────────────────


def _rewrite(content: str, path: str, language: str) -> str:
    """Rewrite the Python files; SQL files come back empty, others as they are; one kind fails."""
    if language == "python":
        return content.replace("the ", "THE_")
    if language == "sql":
        return ""
    if language == "javascript" and "token" in content:
        raise ValueError(path)
    return content


@query(
    """SELECT CASE WHEN path LIKE '%.py' AND contains(content, 'the ') THEN 'changed'
                   WHEN path LIKE '%.js' AND contains(content, 'token') THEN 'failed' ELSE 'unchanged' END AS status,
              count(*) AS n_files
       FROM <<files>> WHERE path NOT LIKE '%.md' GROUP BY 1"""
)
def transform_status(src: Source) -> DataFrame:
    done = hooks.apply_transform(src("files"), _rewrite, [".py", ".js", ".sql"])
    return hooks.transform_counts(done)


@query(
    """SELECT path, CASE WHEN path LIKE '%.py' THEN replace(content, 'the ', 'THE_') ELSE content END AS content
       FROM <<files>> WHERE path NOT LIKE '%.md'"""
)
def transformed_files(src: Source) -> DataFrame:
    done = hooks.apply_transform(src("files"), _rewrite, [".py", ".js", ".sql"])
    return done.select("path", "content")


@query(
    """SELECT key, line FROM (
         SELECT 'k8s' AS key, '- kind ' || kind AS line FROM (
           SELECT unnest(regexp_extract_all(content, '(?m)^kind:\\s*(\\S+)', 1)) AS kind FROM <<ws_files>>
           WHERE path LIKE '%.yaml' AND contains(content, 'apiVersion')) a
         UNION ALL SELECT 'providers', '- ' || p FROM (
           SELECT DISTINCT unnest(regexp_extract_all(content, 'provider\\s+"([^"]+)"', 1)) AS p FROM <<ws_files>> WHERE path LIKE '%.tf') b
         UNION ALL SELECT 'stacks', '- ' || ws || ': terraform' FROM (
           SELECT DISTINCT ws FROM <<ws_files>> WHERE path LIKE '%.tf') c) h"""
)
def hook_report(src: Source) -> DataFrame:
    """Lines of three collectors; a fourth that asks for a missing column is skipped."""
    dash = lambda c: F.concat(F.lit("- "), c)
    selected = [
        hooks.Hook("k8s", containers.k8s_manifests, lambda: dash(F.concat(F.lit("kind "), "kind"))),
        hooks.Hook("providers", infra.tf_providers, lambda: dash(F.col("provider"))),
        hooks.Hook(
            "stacks",
            lambda files: stacks.detect_stacks(files).filter(F.col("stack") == "terraform"),
            lambda: dash(F.concat(F.col("ws").cast("string"), F.lit(": "), "stack")),
        ),
        hooks.Hook("broken", cloud.gcp_function_files, lambda: F.col("no_such_column")),
    ]
    return hooks.hook_lines(src("ws_files"), selected)


@query(
    """SELECT doc_id, lang || ': ' || replace(trim(regexp_replace(text, '[0-9]+', '#', 'g'), chr(9) || chr(10) || ' '), 'an', 'AN') AS text
       FROM documents"""
)
def chained_rewrites(src: Source) -> DataFrame:
    """Rewriters in order, each on the result of the one before."""
    steps = [
        lambda df: df.select("doc_id", "lang", "text"),
        lambda df: df.withColumn("text", F.regexp_replace("text", "[0-9]+", "#")),
        lambda df: df.withColumn("text", F.replace(trim_space("text"), F.lit("an"), F.lit("AN"))),
        lambda df: df.select("doc_id", F.concat("lang", F.lit(": "), "text").alias("text")),
    ]
    return hooks.chain(src("documents"), steps)


def _hooks_sql() -> str:
    """The lines of every default hook, stated for the files that the view makes."""

    def rows(key: str, line: str, where: str, source: str = "f", distinct: bool = False) -> str:
        return f"SELECT {'DISTINCT ' if distinct else ''}'{key}' AS key, {line} AS line FROM {source} WHERE {where}"

    def found(pattern: str, where: str) -> str:
        return f"(SELECT ws, path, unnest(regexp_extract_all(content, {pattern}, 1)) AS m FROM f WHERE {where}) x"

    def of(kind: str, *cases: tuple[str, str]) -> str:
        return " UNION ALL ".join(f"SELECT ws, {name} AS {kind} FROM f WHERE {where}" for name, where in cases)

    source = r"regexp_matches(path, '\.(py|ts|js)$')"
    services = of(
        "s", ("'Functions'", "path = 'main.py' OR path LIKE 'src/j%'"),
        ("'Blob Storage'", "path LIKE 'src/i%' OR path LIKE 'src/j%'"), ("'Identity'", "path LIKE 'src/i%'"),
    )
    triggers = of(
        "s", ("CASE WHEN contains(content, 'timerTrigger') THEN 'Timer' ELSE 'Queue' END", "path = 'function.json'"),
        ("'HTTP'", "path = 'main.py'"), ("'Timer'", "path LIKE 'src/i%'"), ("'Blob'", "path LIKE 'src/j%'"),
    )
    gcp = {
        "firestore": "path LIKE 'src/g%'", "cloud_functions": "path LIKE 'cloud-functions/%'", "bigquery": "path LIKE 'src/g%'",
        "pubsub": "path LIKE 'src/h%'", "cloud_storage": "path LIKE 'src/g%'", "app_engine": "path = 'app.yaml'",
        "terraform": "path LIKE 'terraform/%'",
    }
    flags = ", ".join(f"CASE WHEN bool_or({where}) THEN '{name}' END" for name, where in gcp.items())
    stacks_found = of(
        "stack",
        ("'spark'", "path IN ('bundle.yml', 'databricks.yml', '.databrickscfg', 'requirements.txt') OR path LIKE 'src/c%'"),
        ("'aws'", "path LIKE 'src/a%' OR path LIKE 'src/b%'"),
        ("'gcp'", "path IN ('app.yaml', 'package.json') OR path LIKE 'cloud-functions/%' OR path LIKE 'terraform/%' OR path LIKE 'src/g%'"),
        ("'azure'", "path IN ('function.json', '.env', 'package.json') OR path LIKE 'src/i%' OR path LIKE 'src/j%'"),
        ("'airflow'", "path = 'airflow.cfg' OR path LIKE 'dags/%'"),
        ("'dbt'", "path = 'dbt_project.yml' OR path LIKE 'models/n%'"),
        ("'docker'", "path IN ('Dockerfile', 'docker-compose.yml', 'compose.yaml')"),
        ("'kubernetes'", "path LIKE 'k8s/%'"),
        ("'terraform'", "path LIKE '%.tf'"),
        ("'fastapi'", "path IN ('pyproject.toml', 'main.py')"),
        ("'django'", "path IN ('requirements.txt', 'proj/settings.py')"),
        ("'pytest'", "path IN ('pytest.ini', 'pyproject.toml')"),
        ("'pytorch'", "path = 'pyproject.toml' OR path LIKE 'net/%'"),
        ("'jupyter'", "path LIKE '%.ipynb'"),
        ("'security'", "TRUE"),
    )
    findings = f"({_rule_sql(lines_sql('f', 'path', 'content'), 'path')}) r"
    kernel = "regexp_extract(content, '\"name\": \"(\\w+)\"', 1)"
    kind = "CASE path WHEN 'bundle.yml' THEN 0 WHEN 'databricks.yml' THEN 1 WHEN '.databrickscfg' THEN 3 END"
    fixtures = found(r"'def (db\w)'", "path = 'tests/conftest.py'")
    parts = [
        rows("k8s.manifests", "'- Pod/(unnamed) (ns: default) — ' || path", "path LIKE 'k8s/d%'"),
        rows(
            "k8s.manifests",
            r"'- Service/' || regexp_extract(content, 'name: (svc\d+)', 1) || ' (ns: ' || regexp_extract(content, 'namespace: (\w+)', 1) || ') — ' || path",
            "path LIKE 'k8s/ns%'",
        ),
        rows("k8s.namespaces", r"'- ' || regexp_extract(content, 'namespace: (\w+)', 1)", "path LIKE 'k8s/ns%'", distinct=True),
        rows(
            "k8s.helm",
            r"'- ' || regexp_extract(c.content, 'name: (\S+)', 1) || ' v' || regexp_extract(c.content, 'version: (\S+)', 1) || ': '"
            " || CASE WHEN v.path IS NULL THEN '' ELSE 'replicas, image' END",
            "c.path LIKE '%/Chart.yaml'",
            "f c LEFT JOIN f v ON v.path = replace(c.path, 'Chart.yaml', 'values.yaml')",
        ),
        rows("docker.stages", "'- `Dockerfile`: stage0 (FROM python:3)'", "path = 'Dockerfile'"),
        rows(
            "docker.compose",
            "'- `' || path || '`: ' || m",
            "path = 'docker-compose.yml' OR ws NOT IN (SELECT ws FROM f WHERE path = 'docker-compose.yml')",
            found(r"'(?m)^  (\w[\w-]*):'", "path IN ('docker-compose.yml', 'compose.yaml')"),
        ),
        rows("terraform.providers", "'- ' || m", "TRUE", found("'provider \"(\\w+)\"'", "path LIKE '%.tf'"), distinct=True),
        rows("terraform.resources", "'- aws_s3_bucket.' || m", "TRUE", found("'\"(b\\d+)\"'", "path LIKE 'infra/%'")),
        rows("terraform.variables", "'- ' || m", "TRUE", found("'variable \"(\\w+)\"'", "path LIKE 'infra/%'")),
        rows("aws.resources", "'- ' || m", "TRUE", found(r"'(AWS::\w+::\w+)'", "path LIKE '%/template.%'"), distinct=True),
        rows(
            "aws.services", "'- ' || m", "TRUE",
            found("'(?:(?:client|resource)\\( ?[''\"]|@aws-sdk/client-|new AWS\\.)([\\w-]+)'", source), distinct=True,
        ),
        rows("gcp.imports", "'- ' || m", "TRUE", found(r"'from (google\.cloud[.\w]*)'", source), distinct=True),
        rows("gcp.imports", "'- ' || m", "TRUE", found("'(@google-cloud/[\\w-]+)'", source), distinct=True),
        rows("azure.services", "'- ' || s", "TRUE", f"(SELECT DISTINCT ws, s FROM ({services}) y) x"),
        rows("azure.triggers", "'- ' || s", "TRUE", f"(SELECT DISTINCT ws, s FROM ({triggers}) y) x"),
        rows(
            "spark.features",
            "'- ' || CASE k WHEN 0 THEN 'Databricks Asset Bundle' WHEN 1 THEN 'Databricks Workflow' WHEN 3 THEN 'Databricks CLI' ELSE 'PySpark' END",
            "TRUE",
            f"(SELECT ws, min({kind}) AS k FROM f GROUP BY ws) x",
        ),
        rows("dbt.project", r"'- shop v' || regexp_extract(content, '(2\.\w)', 1)", "path = 'dbt_project.yml'"),
        rows("dbt.models", "'- ' || path || ' [view]'", "path LIKE 'models/n%'"),
        rows(
            "dbt.sources",
            "'- source(' || chr(39) || m || chr(39) || ', ...) — schema: ext, tables: ' || m",
            "TRUE",
            found(r"'name: (raw\d+)'", "path LIKE '%sources.yml'"),
        ),
        rows("airflow.dags", "'- ' || path || ' — dag_id: ' || regexp_extract(path, '([^/]*)\\.py$', 1)", "path LIKE 'dags/%'"),
        rows("airflow.operators", "'- operator: ' || regexp_extract(path, '(r\\d+)', 1)", "path LIKE 'plugins/%'"),
        rows("airflow.operators", "'- sensor: ' || regexp_extract(path, '(r\\d+)', 1)", "path LIKE 'plugins/%'"),
        rows("airflow.config", "'- airflow.cfg: ' || regexp_extract(content, '(Local\\w)', 1) || ', ?'", "path = 'airflow.cfg'"),
        rows("fastapi.routes", "'  GET ' || regexp_extract(content, '(/items/\\d+)', 1) || ' → read() [' || path || ']'", "path LIKE 'api/%'"),
        rows("fastapi.routes", "'  POST /y → (unknown)() [' || path || ']'", "path LIKE 'api/%'"),
        rows("fastapi.models", "'- ' || m || ' (2 fields)'", "TRUE", found(r"'class (Item\w)'", "path LIKE 'schemas/%'"), distinct=True),
        rows("fastapi.models", "'- B (0 fields)'", "path = 'shop/models.py'", distinct=True),
        rows("fastapi.dependencies", "'- ' || m", "TRUE", found(r"'Depends\((\w+)\)'", "path LIKE 'api/%'"), distinct=True),
        rows("django.apps", "'- ' || split_part(path, '/', 1)", "path IN ('shop/models.py', 'blog/views.py')", distinct=True),
        rows("django.models", "'- shop: ' || regexp_extract(content, '(A\\d+)', 1) || ', B'", "path = 'shop/models.py'"),
        rows("django.settings", "'- proj/settings.py: '", "path = 'proj/settings.py'"),
        rows(
            "pytest.config", "'Config: ' || path",
            "path = 'pytest.ini' OR path = 'pyproject.toml' AND ws NOT IN (SELECT ws FROM f WHERE path = 'pytest.ini')",
        ),
        rows(
            "pytest.fixtures", "names", "names IS NOT NULL",
            f"(SELECT 'session scope: ' || string_agg(DISTINCT m, ', ' ORDER BY m) AS names FROM {fixtures}) y",
        ),
        rows("pytest.fixtures", "'function scope: client'", "path = 'tests/conftest.py'", distinct=True),
        rows(
            "pytest.structure", "'- ' || d || ': ' || n", "TRUE",
            "(SELECT regexp_extract(path, '^(.*)/', 1) AS d, 2 * count(*) AS n FROM f WHERE path LIKE 'tests/unit%' GROUP BY 1) x",
        ),
        rows("pytorch.models", "'- ' || path || ': Net'", "path LIKE 'net/%'"),
        rows("pytorch.names", "unnest(['- optimizer: Adam', '- loss: MSELoss'])", "path LIKE 'net/%'", distinct=True),
        rows("jupyter.notebooks", "'- `' || path || '`: 0 cells (0 code, 0 markdown) — kernel: unknown (python)'", "path LIKE 'notebooks/l%'"),
        rows("jupyter.notebooks", f"'- `' || path || '`: 2 cells (1 code, 1 markdown) — kernel: ' || {kernel} || ' (python)'", "path LIKE 'notebooks/w%'"),
        rows("jupyter.kernels", f"'- ' || {kernel}", "path LIKE 'notebooks/w%'", distinct=True),
        rows(
            "git.status", "'- modified: ' || 2 * n || ', staged: ' || 2 * n || ', untracked: ' || n", "TRUE",
            "(SELECT ws, count(*) AS n FROM f WHERE path = 'git-status.txt' GROUP BY ws) x",
        ),
        rows("git.recentCommits", "'- ' || unnest([split_part(content, chr(10), 1), 'c2', 'c4', 'c5'])", "path = 'git-log.txt'"),
        rows("security.findings", "'- ' || category || ': ' || n", "TRUE", f"(SELECT category, count(*) AS n FROM {findings} GROUP BY category) x"),
        rows("security.findings", "'- all: ' || n", "TRUE", f"(SELECT count(*) AS n FROM {findings}) x"),
        rows("gcp.services", "'- ' || s", "s <> ''", f"(SELECT ws, concat_ws(', ', {flags}) AS s FROM f GROUP BY ws) x"),
        rows("workspace.stacks", "'- ' || ws || ': ' || stack", "TRUE", f"(SELECT DISTINCT ws, stack FROM ({stacks_found}) y) x"),
    ]
    return f"WITH f AS MATERIALIZED (SELECT * FROM <<hook_files>>) {' UNION ALL '.join(parts)}"


@query(_hooks_sql())
def default_hook_lines(src: Source) -> DataFrame:
    """Lines of all default hooks over the workspaces, which are read once for their files and once for their names."""
    return hooks.routed_hook_lines(src("hook_files"), DEFAULT_HOOKS)
