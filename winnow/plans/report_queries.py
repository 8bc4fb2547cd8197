"""Summaries, budgets, newest-first selection and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions import paths
from winnow.operators import aggregate, context, scan, select
from winnow.operators.packs import data
from winnow.operators.select import lookahead_match, topk_with_overflow
from winnow.operators.skew import numbered
from winnow.plans.registry import Source, query
from winnow.plans.text_queries import _rule_sql, lines_sql
from winnow.sources.objects import list_objects

_CORPUS = """(SELECT path, content FROM <<files>> UNION ALL SELECT path, content FROM <<page_files>>
             UNION ALL SELECT path, content FROM <<risky_files>>) c"""
_FINDINGS = "({}) f".format(_rule_sql(lines_sql(_CORPUS, "path", "content"), "path"))


def _findings(src: Source) -> DataFrame:
    corpus = src("files").select("path", "content")
    for name in ("page_files", "risky_files"):
        corpus = corpus.unionByName(src(name).select("path", "content"))
    return scan.security_scan(corpus)


# ── summaries ────────────────────────────────────────────────────────────────


@query(
    f"""SELECT category, count(*) AS total, count(*) FILTER (severity = 'high') AS high,
               count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
        FROM {_FINDINGS} GROUP BY ROLLUP (category)"""
)
def findings_summary(src: Source) -> DataFrame:
    return aggregate.findings_summary(_findings(src))


@query(
    f"""SELECT path, count(*) AS n_findings, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories
        FROM {_FINDINGS} GROUP BY path"""
)
def findings_by_file(src: Source) -> DataFrame:
    found = aggregate.findings_by_file(_findings(src))
    return found.withColumn("categories", F.array_join("categories", ", "))


@query(f"SELECT count(DISTINCT path) AS n_files, count(*) AS n_findings FROM {_FINDINGS}")
def findings_totals(src: Source) -> DataFrame:
    return aggregate.findings_totals(aggregate.findings_by_file(_findings(src)))


@query(
    """SELECT coalesce(name, 'unknown') AS name, count(*) AS n_errors,
              substr(arg_max(message, {'a': ts, 'b': log_id}), 1, 100) AS first_message
       FROM <<error_logs>> GROUP BY 1"""
)
def errors_by_function(src: Source) -> DataFrame:
    return aggregate.errors_by_function(src("error_logs"), 100)


@query(
    """SELECT coalesce(name, 'unknown') AS name, count(*) AS n_errors,
              arg_max(message, {'a': ts, 'b': log_id}) AS first_message
       FROM <<error_logs>> GROUP BY 1"""
)
def errors_by_function_whole(src: Source) -> DataFrame:
    return aggregate.errors_by_function(src("error_logs"))


@query(
    f"""SELECT path, severity, CAST(GROUPING(path, severity) AS INTEGER) AS level, count(*) AS n_findings,
               CAST(count(DISTINCT rule_id) AS INTEGER) AS n_rules
        FROM {_FINDINGS} GROUP BY ROLLUP (path, severity)"""
)
def findings_rollup(src: Source) -> DataFrame:
    """Findings of every file and severity, of every file, and of all."""
    return aggregate.findings_rollup(_findings(src))


@query(
    """SELECT count(*) FILTER (state = 'RUNNING') AS n_running, count(*) AS n_total,
              (SELECT count(*) FROM <<jobs>>) AS n_jobs FROM <<clusters>>"""
)
def fleet_status(src: Source) -> DataFrame:
    n_jobs = src("jobs").agg(F.count("*")).scalar()
    return aggregate.fleet_status(src("clusters")).withColumn("n_jobs", n_jobs)


@query(
    """SELECT CAST(sum(length(content)) AS BIGINT) AS used FROM <<context_parts>> WHERE kind <> 'plugin'"""
)
def context_used(src: Source) -> DataFrame:
    return aggregate.context_used(src("context_parts"))


@query(
    """SELECT p_brand, string_agg(p_name, ', ' ORDER BY p_name) AS names FROM (
         SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS rn
         FROM (SELECT DISTINCT p_brand, p_name FROM part) d) n WHERE rn <= 8 GROUP BY p_brand"""
)
def names_per_group(src: Source) -> DataFrame:
    return aggregate.group_names(src("part"), "p_brand", "p_name", 8)


_FLAGS = {"has_token": "token = ", "has_digits": "[0-9]{6}", "has_url": "https?://", "has_tab": "\t"}


@query(
    "SELECT source, "
    + ", ".join(f"bool_or(regexp_matches(text, '{p}')) AS {n}" for n, p in _FLAGS.items())
    + " FROM documents GROUP BY source"
)
def corpus_flags(src: Source) -> DataFrame:
    docs = src("documents").select("source", F.col("text").alias("content"))
    return aggregate.feature_flags(docs, _FLAGS, ["source"])


@query(
    """SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_items FROM documents"""
)
def lines_total(src: Source) -> DataFrame:
    held = src("documents").select(F.split("text", "\n").alias("lines"))
    return aggregate.items_total(held, "lines")


@query(
    """SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
       UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'absent', CAST(0 AS BIGINT)"""
)
def inventory(src: Source) -> DataFrame:
    def load(name: str):
        return lambda: src.spark.read.parquet(f"{src.folder}/{name}.parquet")

    kinds = {n: load(n) for n in ("customer", "orders", "events", "absent")}
    return aggregate.inventory_counts(src.spark, kinds)


# ── budgets ──────────────────────────────────────────────────────────────────

_BUDGET = 2000


@query(
    f"""SELECT conv_id, turn, role, text, running FROM (
          SELECT *, CAST(sum(length(text)) OVER w AS BIGINT) AS running, row_number() OVER w AS rn FROM conversations
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) m
        WHERE running <= {_BUDGET} OR rn = 1"""
)
def message_window(src: Source) -> DataFrame:
    return select.window_messages(src("conversations"), _BUDGET)


@query(
    """SELECT conv_id, turn FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) m WHERE rn <= 3"""
)
def last_messages(src: Source) -> DataFrame:
    return select.last_n(src("conversations").select("conv_id", "turn"), 3)


def _cut(n: str, marker: str) -> str:
    return f"CASE WHEN length(content) > {n} THEN substr(content, 1, CAST({n} AS BIGINT)) || chr(10) || '{marker}' ELSE content END"


@query(
    r"""WITH n AS (SELECT ctx, count(*) AS n FROM <<context_parts>> WHERE kind = 'related' GROUP BY ctx)
        SELECT p.ctx, part_id, kind, path, CASE kind
          WHEN 'active' THEN """
    + _cut("500", "... (truncated to fit context budget)")
    + """ WHEN 'related' THEN """
    + _cut("floor(250.0 / n)", "... (truncated to fit context budget)")
    + r""" WHEN 'diff' THEN CASE WHEN length(content) <= 100 THEN content
               WHEN contains(substr(content, 1, 101), chr(10))
               THEN regexp_extract(substr(content, 1, 101), '(?s)^(.*)\n', 1) || chr(10) || '... (diff truncated)'
               ELSE substr(content, 1, 100) || chr(10) || '... (diff truncated)' END
          ELSE content END AS content
        FROM <<context_parts>> p LEFT JOIN n ON p.ctx = n.ctx"""
)
def budget_allocation(src: Source) -> DataFrame:
    return select.allocate_budget(src("context_parts"), 1000)


@query(
    """SELECT path, line, message FROM <<diagnostics>> WHERE severity = 'error'
       ORDER BY path, line, col, message LIMIT 15"""
)
def capped_errors(src: Source) -> DataFrame:
    errors = src("diagnostics").filter(F.col("severity") == "error")
    order = [F.col("path"), F.col("line"), F.col("col"), F.col("message")]
    return select.cap_errors(errors, order).select("path", "line", "message")


_TOTAL = 1000


@query(
    r"""WITH parts AS (
          SELECT *, row_number() OVER (PARTITION BY ctx, kind ORDER BY path) AS rk FROM <<context_parts>>),
        kept AS (SELECT * FROM parts WHERE kind = 'plugin' OR rk <= CASE kind WHEN 'related' THEN 5 ELSE 1 END),
        n AS (SELECT ctx, count(*) AS n FROM kept WHERE kind = 'related' GROUP BY ctx),
        errs AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY path, line, col, message) AS rk
                         FROM <<diagnostics>> WHERE severity = 'error') e WHERE rk <= 3),
        sections AS (
          SELECT ctx, 0 AS s, 0 AS p, '## Active file: ' || path || ' (text)' AS t FROM kept WHERE kind = 'active'
          UNION ALL SELECT ctx, 1, 0, '```text' || chr(10) || """
    + _cut("500", "... (truncated to fit context budget)")
    + r""" || chr(10) || '```' FROM kept WHERE kind = 'active'
          UNION ALL SELECT doc, 2, 0, '## Errors (' || count(*) || '):' FROM errs GROUP BY doc
          UNION ALL SELECT doc, 3, rk, '- [error] ' || path || ':' || line || ' — ' || message FROM errs
          UNION ALL SELECT ctx, 4, 0, '## Git changes:' || chr(10) || CASE WHEN length(content) <= 100 THEN content
               WHEN contains(substr(content, 1, 101), chr(10))
               THEN regexp_extract(substr(content, 1, 101), '(?s)^(.*)\n', 1) || chr(10) || '... (diff truncated)'
               ELSE substr(content, 1, 100) || chr(10) || '... (diff truncated)' END
            FROM kept WHERE kind = 'diff' AND content <> ''
          UNION ALL SELECT ctx, 5, rk, content FROM kept WHERE kind = 'plugin' AND content <> ''
          UNION ALL SELECT k.ctx, 6, rk, '## Related: ' || path || chr(10) || '```text' || chr(10) || """
    + _cut("floor(250.0 / n)", "... (truncated to fit context budget)")
    + r""" || chr(10) || '```' FROM kept k JOIN n ON k.ctx = n.ctx WHERE kind = 'related'
          UNION ALL SELECT DISTINCT ctx, 7, 0, '## Instruction:' || chr(10) || 'review ' || ctx FROM <<context_parts>>)
        SELECT ctx, string_agg(t, chr(10) || chr(10) ORDER BY s, p) AS request FROM sections GROUP BY ctx"""
)
def request_texts(src: Source) -> DataFrame:
    """Files, errors, changes and instruction of every context as one request text."""
    parts = src("context_parts")
    errors = src("diagnostics").filter(F.col("severity") == "error").withColumn("ctx", F.col("doc"))
    instructions = parts.select("ctx").distinct().select(
        "ctx", F.concat(F.lit("review "), F.col("ctx").cast("string")).alias("instruction")
    )
    return context.request_texts(context.context_sections(parts, errors, instructions, _TOTAL))


# ── state per job, newest failures ───────────────────────────────────────────

_LATEST = "(SELECT job_id, arg_max(state, {'a': started, 'b': run_id}) AS state FROM <<runs>> GROUP BY job_id) r"


@query(
    f"""SELECT j.job_id, job_name, coalesce(state, 'NO_RUNS') AS state
        FROM (SELECT * FROM <<jobs>> ORDER BY job_id LIMIT 10) j LEFT JOIN {_LATEST} ON j.job_id = r.job_id"""
)
def latest_run_first_jobs(src: Source) -> DataFrame:
    return select.latest_run_per_job(src("jobs"), src("runs"), 10)


@query(
    f"""SELECT j.job_id, job_name, coalesce(state, 'NO_RUNS') AS state
        FROM <<jobs>> j LEFT JOIN {_LATEST} ON j.job_id = r.job_id"""
)
def latest_run_each_job(src: Source) -> DataFrame:
    return select.latest_run_per_job(src("jobs"), src("runs"))


@query(
    """SELECT c.c_custkey AS job_id, coalesce(r.state, 'NO_RUNS') AS state FROM customer c
       LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, {'a': o_orderdate, 'b': o_orderkey}) AS state
                  FROM orders GROUP BY o_custkey) r ON c.c_custkey = r.o_custkey"""
)
def latest_order_state(src: Source) -> DataFrame:
    """Newest state of every customer's orders, including customers without any."""
    jobs = src("customer").select(F.col("c_custkey").alias("job_id"))
    runs = src("orders").select(
        F.col("o_custkey").alias("job_id"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("started"),
        F.col("o_orderstatus").alias("state"),
    )
    return select.latest_run_per_job(jobs, runs, first_jobs=None)


@query(
    """SELECT name, log_id, substr(message, 1, 200) AS message, CAST(rn AS INTEGER) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, log_id DESC) AS rn FROM <<error_logs>>
         WHERE name IN (SELECT 'fn-' || regexp_extract(resource, '[0-9]+$') AS name FROM <<functions>> ORDER BY name LIMIT 5)) l
       WHERE rn <= 2"""
)
def recent_errors(src: Source) -> DataFrame:
    functions = src("functions").select(F.regexp_extract("resource", "[^/]+$", 0).alias("name"))
    return select.recent_errors(functions, src("error_logs"), 5, limit=200).drop("ts")


@query(
    """SELECT name, log_id, message, CAST(rn AS INTEGER) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, log_id DESC) AS rn FROM <<error_logs>>
         WHERE name IN (SELECT 'fn-' || regexp_extract(resource, '[0-9]+$') FROM <<functions>>)) l
       WHERE rn <= 2"""
)
def recent_errors_everywhere(src: Source) -> DataFrame:
    functions = src("functions").select(F.regexp_extract("resource", "[^/]+$", 0).alias("name"))
    return select.recent_errors(functions, src("error_logs")).drop("ts")


@query(
    """SELECT run_id, job_id FROM (
         SELECT * FROM (SELECT * FROM <<runs>> ORDER BY started DESC, run_id DESC LIMIT 20) n
         WHERE state = 'FAILED' ORDER BY started DESC, run_id DESC LIMIT 3) f"""
)
def recent_failures(src: Source) -> DataFrame:
    return select.recent_failures(src("runs")).select("run_id", "job_id")


@query(
    """SELECT 0 AS part, path || ' [' || materialization || ']' AS label FROM (
         SELECT path, CASE WHEN contains(content, 'materialized=''table''') THEN 'table'
                           WHEN contains(content, 'materialized=''incremental''') THEN 'incremental' ELSE 'view' END AS materialization
         FROM <<dbt_model_files>> WHERE path LIKE 'models/%.sql' ORDER BY path LIMIT 20) m
       UNION ALL SELECT 1, '... and ' || (count(*) - 20) || ' more' FROM <<dbt_model_files>> WHERE path LIKE 'models/%.sql'"""
)
def models_report(src: Source) -> DataFrame:
    models = data.dbt_models(src("dbt_model_files"))
    label = F.concat("path", F.lit(" ["), "materialization", F.lit("]"))
    return topk_with_overflow(models, label, [F.col("path")], 20)


@query(
    """SELECT 0 AS part, r_name AS label FROM region"""
)
def short_report(src: Source) -> DataFrame:
    """A report that is shorter than its limit has no overflow line."""
    return topk_with_overflow(src("region"), F.col("r_name"), [F.col("r_regionkey")], 20)


@query(
    """SELECT CAST(row_number() OVER (ORDER BY is_dir DESC, name) AS INTEGER) AS pos, name FROM (
         SELECT contains(key, '/') AS is_dir, split_part(key, '/', 1) AS name FROM <<object_keys>> GROUP BY 1, 2) o
"""
)
def objects_in_order(src: Source) -> DataFrame:
    """All entries of a sorted listing with their place, numbered in ranges of the order."""
    listed = select.sort_objects(list_objects(src("object_keys")), F.col("is_dir"), "name")
    placed = numbered(listed, ["is_dir", "name"], "pos", descending=("is_dir",))
    return placed.select(F.col("pos").cast("int").alias("pos"), "name")


@query(
    r"""WITH l AS (
          SELECT path, unnest(string_split(content, chr(10))) AS line,
                 CAST(generate_subscripts(string_split(content, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM <<k8s_files>>),
        w AS (SELECT *, lead(line, 1) OVER p AS a, lead(line, 2) OVER p AS b FROM l
              WINDOW p AS (PARTITION BY path ORDER BY line_no))
        SELECT path, line_no, line, coalesce(nullif(regexp_extract(coalesce(a, ''), '^\s+name: (\S+)', 1), ''),
               nullif(regexp_extract(coalesce(b, ''), '^\s+name: (\S+)', 1), '')) AS found
        FROM w WHERE regexp_matches(line, '^(?:kind|metadata):')"""
)
def lookahead_lines(src: Source) -> DataFrame:
    return lookahead_match(src("k8s_files"), r"^(?:kind|metadata):", r"^\s+name: (\S+)", 2)


# ── scalar functions ─────────────────────────────────────────────────────────


@query(
    """SELECT o_orderkey, substr(o_orderpriority, 1, 3) AS head, right(o_orderpriority, 3) AS tail,
              instr(o_orderpriority, '-') - 1 AS first_dash, starts_with(o_orderpriority, '1') AS starts,
              ends_with(o_orderpriority, 'W') AS ends, contains(o_orderpriority, 'HIGH') AS has,
              lower(o_orderpriority) AS low, upper(lower(o_orderpriority)) AS up,
              array_to_string(list_reverse(string_split(o_orderpriority, '-')), '+') AS rejoined,
              printf('%.2f', o_totalprice) AS fixed, CAST(floor(o_totalprice / 1000) AS BIGINT) AS floored,
              greatest(o_custkey, o_orderkey) AS biggest, try_cast(o_orderpriority AS BIGINT) AS parsed,
              coalesce(nullif(replace(o_orderstatus, 'P', ''), ''), 'empty') AS filled
       FROM orders"""
)
def scalar_text_and_numbers(src: Source) -> DataFrame:
    p = F.col("o_orderpriority")
    return src("orders").select(
        "o_orderkey",
        F.substring(p, 1, 3).alias("head"),
        F.right(p, F.lit(3)).alias("tail"),
        (F.instr(p, "-") - 1).cast("bigint").alias("first_dash"),
        F.startswith(p, F.lit("1")).alias("starts"),
        F.endswith(p, F.lit("W")).alias("ends"),
        F.contains(p, F.lit("HIGH")).alias("has"),
        F.lower(p).alias("low"),
        F.upper(F.lower(p)).alias("up"),
        F.array_join(F.reverse(F.split(p, "-")), "+").alias("rejoined"),
        F.format_string("%.2f", "o_totalprice").alias("fixed"),
        F.floor(F.col("o_totalprice") / 1000).alias("floored"),
        F.greatest("o_custkey", "o_orderkey").alias("biggest"),
        p.try_cast("bigint").alias("parsed"),
        F.coalesce(F.nullif(F.replace("o_orderstatus", F.lit("P"), F.lit("")), F.lit("")), F.lit("empty")).alias("filled"),
    )


@query(
    r"""SELECT doc_id, len(words) AS n_words, list_sum(list_transform(words, lambda w: length(w)))::BIGINT AS n_letters,
               len(list_filter(words, lambda w: length(w) > 6)) AS n_long,
               len(list_filter(words, lambda w: contains(w, '='))) > 0 AS any_eq,
               len(list_filter(words, lambda w: length(w) >= 0)) = len(words) AS every,
               list_contains(words, 'the') AS has_the, len(list_distinct(words)) AS n_distinct,
               regexp_extract(text, '([0-9]+)', 1) AS digits, len(regexp_extract_all(text, '[0-9]+')) AS n_digits,
               json_extract_string('{"a": {"b": "' || lang || '"}}', '$.a.b') AS from_json
        FROM (SELECT *, string_split_regex(text, '\s+') AS words FROM documents) d"""
)
def scalar_collections(src: Source) -> DataFrame:
    words = src("documents").withColumn("words", F.split("text", r"\s+"))
    doc = F.to_json(F.struct(F.struct(F.col("lang").alias("b")).alias("a")))
    zero = F.lit(0).cast("bigint")
    return words.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.aggregate("words", zero, lambda a, w: a + F.length(w)).alias("n_letters"),
        F.size(F.filter("words", lambda w: F.length(w) > 6)).cast("bigint").alias("n_long"),
        F.exists("words", lambda w: F.contains(w, F.lit("="))).alias("any_eq"),
        F.forall("words", lambda w: F.length(w) >= 0).alias("every"),
        F.array_contains("words", "the").alias("has_the"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        F.regexp_extract("text", "([0-9]+)", 1).alias("digits"),
        F.regexp_count("text", F.lit("[0-9]+")).cast("bigint").alias("n_digits"),
        F.get_json_object(doc, "$.a.b").alias("from_json"),
    )


@query(
    """SELECT path, regexp_extract(path, '[^/]*$') AS base, regexp_extract(path, '^(.*)/', 1) AS dir,
              regexp_extract(path, '[.][^./]*$') AS ext, regexp_extract(path, '([^/]*)[.][^./]*$', 1) AS stem,
              regexp_extract(path, '/(.*)$', 1) AS relative
       FROM <<code_files>>"""
)
def scalar_paths(src: Source) -> DataFrame:
    files = src("code_files").select("path")
    return files.select(
        "path",
        paths.base_name("path").alias("base"),
        paths.dir_name("path").alias("dir"),
        paths.extension("path").alias("ext"),
        paths.stem("path").alias("stem"),
        F.regexp_extract("path", "^[^/]*/(.*)$", 1).alias("relative"),
    )
