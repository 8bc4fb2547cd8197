"""Scans, sources, sinks and text operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions import labels, paths, text
from winnow.operators import scan, select
from winnow.operators.generated import generated_files, safe_paths
from winnow.operators.packs.ml import clean_outputs, notebook_stats
from winnow.operators.rules import DIAGNOSTIC_ACTIONS, FUNCTION_PATTERNS, LINE_ACTIONS, SCAN_RULES
from winnow.plans.registry import Source, query
from winnow.plans.views import TABLES
from winnow.sources import files as file_source
from winnow.sources import tables
from winnow.sources.objects import list_objects
from winnow.sources.scratch import scratch_dir


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ── sources and sinks ────────────────────────────────────────────────────────


@query("SELECT * FROM orders")
def scan_orders(src: Source) -> DataFrame:
    return tables.scan_table(src.spark, src.folder, "orders")


@query(
    """SELECT source, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines,
              CAST(sum(length(text) + 1) AS BIGINT) AS n_chars
       FROM documents GROUP BY source"""
)
def scan_text_tree(src: Source) -> DataFrame:
    """Documents written as a deep tree of text files, scanned back and measured per folder."""
    root = scratch_dir(src.spark, "tree")
    src("documents").select("source", "text").write.option("maxRecordsPerFile", 64).partitionBy(
        "source"
    ).text(f"{root}/a/b/c/d/e")
    found = file_source.scan_files(src.spark, root, [".txt"])
    return found.groupBy(F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("source")).agg(
        F.sum(F.regexp_count("content", F.lit("\n"))).alias("n_lines"),
        F.sum(F.length("content").cast("bigint")).alias("n_chars"),
    )


@query(
    """SELECT path, CASE WHEN path LIKE '%.js' THEN replace(content, 'e', 'E') ELSE content END AS content FROM <<files>>
       UNION ALL SELECT concat('new/', path), content FROM <<files>> WHERE path LIKE '%.sql'"""
)
def write_and_replace_files(src: Source) -> DataFrame:
    """Write all files, each in two versions, then a second set that replaces some and adds others; read the store."""
    store = scratch_dir(src.spark, "files")
    files = src("files").select("path", "content")
    older = files.select("path", F.concat("content", F.lit(" old")).alias("content"), F.lit(1).alias("version"))
    file_source.write_files(older.unionByName(files.withColumn("version", F.lit(2))), store, order="version")
    replaced = files.filter(F.endswith("path", F.lit(".js"))).withColumn(
        "content", F.replace("content", F.lit("e"), F.lit("E"))
    )
    added = files.filter(F.endswith("path", F.lit(".sql"))).withColumn(
        "path", F.concat(F.lit("new/"), "path")
    )
    file_source.write_files(replaced.unionByName(added), store)
    return file_source.read_files(src.spark, store)


@query(
    """SELECT contains(key, '/') AS is_dir, split_part(key, '/', 1) AS name, count(*) AS n_objects,
              CAST(sum(size) AS BIGINT) AS n_bytes, round(sum(size) / 1048576.0, 2) AS size_mb
       FROM <<object_keys>> GROUP BY 1, 2"""
)
def list_top_level(src: Source) -> DataFrame:
    return list_objects(src("object_keys"))


@query(
    """SELECT contains(rest, '/') AS is_dir, split_part(rest, '/', 1) AS name, count(*) AS n_objects,
              CAST(sum(size) AS BIGINT) AS n_bytes, round(sum(size) / 1048576.0, 2) AS size_mb
       FROM (SELECT substr(key, 26) AS rest, size FROM <<object_keys>>
             WHERE starts_with(key, 'spam-farm.example.org/en/') AND key <> 'spam-farm.example.org/en/') b
       GROUP BY 1, 2"""
)
def list_one_folder(src: Source) -> DataFrame:
    return list_objects(src("object_keys"), "spam-farm.example.org/en/")


_PREVIEW = """SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS newest,
                     max(CASE WHEN o_totalprice < 0 THEN o_orderstatus END) AS missing
              FROM {orders} GROUP BY o_orderpriority ORDER BY o_orderpriority"""


@query(
    """SELECT o_orderpriority, CAST(count(*) AS VARCHAR) AS n,
              CAST(max(o_orderdate) AS VARCHAR) AS newest, 'NULL' AS missing,
              CAST(5 AS BIGINT) AS total_rows FROM orders GROUP BY o_orderpriority"""
)
def sql_preview(src: Source) -> DataFrame:
    src("orders").createOrReplaceTempView("winnow_orders")
    return tables.run_sql(src.spark, _PREVIEW.replace("{orders}", "winnow_orders"))


@query(
    """SELECT substr(coalesce(CAST(text AS VARCHAR), 'NULL'), 1, 50) AS text,
              CAST(doc_id AS VARCHAR) AS doc_id, (SELECT count(*) FROM documents) AS total_rows
       FROM documents ORDER BY documents.doc_id LIMIT 50"""
)
def sql_preview_cuts_cells(src: Source) -> DataFrame:
    src("documents").createOrReplaceTempView("winnow_documents")
    return tables.run_sql(
        src.spark,
        "SELECT text, doc_id FROM winnow_documents WHERE doc_id >= :low ORDER BY doc_id",
        args={"low": 0},
    )


_SQL_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>",
}
_TABLE_NAMES = sorted(TABLES)


_WHENS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SQL_TYPES.items())
_TYPE_CASE = f"CASE data_type {_WHENS} ELSE data_type END"


@query(
    f"""SELECT table_name, CAST(ordinal_position AS BIGINT) AS position, column_name,
               {_TYPE_CASE} AS type_text, concat('  - `', column_name, '` ', {_TYPE_CASE}) AS line
        FROM information_schema.columns
        WHERE table_name IN ({", ".join(_quote(t) for t in _TABLE_NAMES)})"""
)
def catalog_columns(src: Source) -> DataFrame:
    """Catalog listing of views over the tables, each column as one schema line."""
    for name in _TABLE_NAMES:
        src(name).createOrReplaceTempView(f"winnow_{name}")
    listed = tables.describe_catalog(src.spark).filter(
        F.col("table_name").isin(*[f"winnow_{n}" for n in _TABLE_NAMES])
    )
    return listed.select(
        F.replace("table_name", F.lit("winnow_"), F.lit("")).alias("table_name"),
        "position",
        "column_name",
        "type_text",
        labels.schema_text("column_name", "type_text", ~F.col("nullable"), "comment").alias("line"),
    )


@query(
    f"""SELECT table_name, string_agg('  - `' || column_name || '` ' || {_TYPE_CASE}, chr(10) ORDER BY ordinal_position)
               AS columns, '  (none)' AS partition_keys
        FROM information_schema.columns WHERE table_name IN ({", ".join(_quote(t) for t in _TABLE_NAMES)}) GROUP BY table_name"""
)
def table_schemas(src: Source) -> DataFrame:
    for name in _TABLE_NAMES:
        src(name).createOrReplaceTempView(f"winnow_{name}")
    listed = tables.describe_tables(src.spark, [f"winnow_{name}" for name in _TABLE_NAMES])
    return tables.schema_listing(listed).drop("catalog", "database").withColumn(
        "table_name", F.replace("table_name", F.lit("winnow_"), F.lit(""))
    )


_TWO_DATABASES = {"winnow_shop": "customer", "winnow_stock": "part"}


@query(
    " UNION ALL ".join(
        f"""SELECT 'spark_catalog' AS catalog, '{database}' AS database, 'items' AS table_name,
                   CAST(ordinal_position AS BIGINT) AS position, column_name, {_TYPE_CASE} AS type_text
            FROM information_schema.columns WHERE table_name = '{table}'"""
        for database, table in _TWO_DATABASES.items()
    )
)
def catalog_of_two_databases(src: Source) -> DataFrame:
    """Two databases that hold a table of the same name, found by walking all catalogs."""
    spark = src.spark
    for database, table in _TWO_DATABASES.items():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{scratch_dir(spark, database)}'")
        path = f"{src.folder}/{table}.parquet"
        spark.sql(f"CREATE OR REPLACE VIEW {database}.items AS SELECT * FROM parquet.`{path}`")
    listed = tables.describe_levels(spark).where(F.col("database").isin(*_TWO_DATABASES))
    return listed.select("catalog", "database", "table_name", "position", "column_name", "type_text")


@query(
    """SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS n_rows
       FROM customer ORDER BY c_custkey LIMIT 10"""
)
def sample_customers(src: Source) -> DataFrame:
    return tables.sample_table(src("customer").select("c_custkey", "c_name"), ["c_custkey"], 10)


@query("SELECT * FROM lineitem WHERE l_orderkey = 77 AND l_returnflag = 'A'")
def lookup_by_key(src: Source) -> DataFrame:
    return tables.query_by_key(src("lineitem"), l_orderkey=77, l_returnflag="A")


# ── languages, lines, rules ──────────────────────────────────────────────────


@query(
    """SELECT path, CASE regexp_extract(path, '[^.]*$') WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript'
                    WHEN 'sql' THEN 'sql' ELSE 'text' END AS language,
              CASE regexp_extract(path, '[^.]*$') WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript'
                    WHEN 'sql' THEN 'sql' WHEN 'md' THEN 'markdown' ELSE 'plaintext' END AS object_language
       FROM <<files>>"""
)
def file_languages(src: Source) -> DataFrame:
    named = scan.with_language(src("files").select("path"))
    return named.withColumn("object_language", paths.object_language_of("path"))


_LINES = """SELECT path, CAST(generate_subscripts(string_split(content, chr(10)), 1) - 1 AS INTEGER) AS line_no,
                   unnest(string_split(content, chr(10))) AS line FROM <<files>>"""


@query(_LINES)
def file_lines(src: Source) -> DataFrame:
    return scan.explode_lines(src("files").select("path", "content"))


@query(
    """SELECT * FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no,
              unnest(string_split(text, chr(10))) AS line FROM <<generated>>) l
       WHERE NOT (ltrim(line, chr(9) || ' ') LIKE '#%' OR ltrim(line, chr(9) || ' ') LIKE '//%'
                  OR ltrim(line, chr(9) || ' ') LIKE '*%' OR ltrim(line, chr(9) || ' ') LIKE '/*%')"""
)
def lines_without_comments(src: Source) -> DataFrame:
    return scan.drop_comment_lines(scan.explode_lines(src("generated"), "text"))


# look-ahead stated with plain patterns; the same for lines with one such call
_NO_LOOKAHEAD = {
    15: (
        r"\bexec\s*\(\s*",
        r"(?:\/\/|#|\/\*|\*)\s*.*\bexec\b|\bexec\s*\([\"'](?:git|ls|dir|cd|make|npm|pip|python|bash|sh)\b",
    ),
    16: (
        r"http:\/\/",
        r"(?i)(?:example\.com|test|localhost|placeholder|todo|fixme|schema|namespace|xmlns|dtd|w3\.org|ietf\.org)"
        r"|http:\/\/(?:localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])",
    ),
    19: (r"hashlib\.sha1\s*\(", r"(?i)(?:git|content.address|deduplicate)"),
}
_CHECKSUM = "regexp_matches(line, '(?i)checksum') AND NOT regexp_matches(line, '(?i)checksum.*password')"


# the white space of JavaScript, spelled out for an engine whose own is ASCII
_SPACES = r"\t\n\v\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _spaced(pattern: str) -> str:
    return pattern.replace(r"\s", f"[{_SPACES}]")


def _rule_sql(lines: str, keys: str) -> str:
    """One SELECT per rule that a regular-expression engine without look-ahead can run."""
    parts = []
    for r in SCAN_RULES:
        pattern, exclude = _NO_LOOKAHEAD.get(r.rule_id, (r.pattern, r.exclude))
        pattern, exclude = _spaced(pattern), exclude and _spaced(exclude)
        flags = "(?i)" if pattern.startswith("(?i)") else ""
        before = f"{flags}^(.*?)(?:{pattern.removeprefix('(?i)')})"
        start = f"length(regexp_extract(line, {_quote(before)}, 1))"
        hit = f"regexp_extract(line, {_quote(pattern)})"
        where = f"regexp_matches(line, {_quote(pattern)})"
        if exclude:
            where += f" AND NOT regexp_matches(line, {_quote(exclude)})"
        if r.rule_id == 19:
            where += f" AND NOT ({_CHECKSUM})"
        parts.append(
            f"""SELECT {keys}, line_no, CAST({r.rule_id} AS INTEGER) AS rule_id,
                       CAST({start} AS INTEGER) AS "column",
                       CAST({start} + length({hit}) AS INTEGER) AS end_column,
                       {_quote(r.severity)} AS severity, {_quote(r.category)} AS category,
                       {_quote(r.message)} AS message, substr({hit}, 1, 80) AS pattern
                FROM scanned WHERE {where}"""
        )
    union = "\nUNION ALL\n".join(parts)
    return (
        f"WITH scanned AS (SELECT * FROM ({lines}) l WHERE NOT regexp_matches(line, '^[{_SPACES}]*(#|//|\\*|/\\*)')) {union}"
    )


def lines_sql(table: str, key: str, content: str) -> str:
    return f"""SELECT {key}, CAST(generate_subscripts(string_split({content}, chr(10)), 1) - 1 AS INTEGER) AS line_no,
                      unnest(string_split({content}, chr(10))) AS line FROM {table}"""


@query(_rule_sql(lines_sql("<<files>>", "path", "content"), "path"))
def security_scan_documents(src: Source) -> DataFrame:
    return scan.security_scan(src("files").select("path", "content"))


@query(_rule_sql(lines_sql("<<page_files>>", "path", "content"), "path"))
def security_scan_urls(src: Source) -> DataFrame:
    return scan.security_scan(src("page_files").select("path", "content"))


@query(_rule_sql(lines_sql("pages", "page_id", "html"), "page_id"))
def security_scan_html(src: Source) -> DataFrame:
    return scan.security_scan(src("pages").select("page_id", "html"), content="html")


@query(_rule_sql(lines_sql("<<settings_texts>>", "id", "content"), "id"))
def security_scan_settings(src: Source) -> DataFrame:
    return scan.security_scan(src("settings_texts"))


@query(_rule_sql(lines_sql("<<risky_files>>", "path", "content"), "path"))
def security_scan_code(src: Source) -> DataFrame:
    return scan.security_scan(src("risky_files"))


@query(
    """SELECT CAST(min(rule_id) AS INTEGER) AS first_rule, CAST(max(rule_id) AS INTEGER) AS last_rule,
              count(DISTINCT rule_id) AS n_rules, count(*) AS n_findings FROM (%s) f"""
    % _rule_sql(lines_sql("<<risky_files>>", "path", "content"), "path")
)
def rules_that_fire(src: Source) -> DataFrame:
    found = scan.security_scan(src("risky_files"))
    return found.agg(
        F.min("rule_id").alias("first_rule"),
        F.max("rule_id").alias("last_rule"),
        F.countDistinct("rule_id").alias("n_rules"),
        F.count("*").alias("n_findings"),
    )


CODE = "SELECT path, content FROM <<api_files>> UNION ALL SELECT path, content FROM <<ws_files>> UNION ALL SELECT path, content FROM <<files>>"


def code_files(src: Source) -> DataFrame:
    out = src("api_files").select("path", "content")
    out = out.unionByName(src("ws_files").select("path", "content"))
    return out.unionByName(src("files").select("path", "content"))


_LANG_CASE = (
    "CASE regexp_extract(path, '[^.]*$') "
    + " ".join(f"WHEN {_quote(e[1:])} THEN {_quote(l)}" for e, l in paths.EXTENSION_LANGUAGE.items())
    + " ELSE 'text' END"
)
_CODE_LINES = f"""SELECT path, {_LANG_CASE} AS language, line_no, line
                  FROM ({lines_sql("(" + CODE + ") c", "path", "content")}) x"""


@query(
    f"SELECT * FROM ({_CODE_LINES}) l WHERE "
    + " OR ".join(
        f"(language = {_quote(lang)} AND regexp_matches(line, {_quote(p)}))" for lang, p in FUNCTION_PATTERNS.items()
    )
)
def function_index(src: Source) -> DataFrame:
    found = scan.index_functions(scan.with_language(code_files(src)))
    return found.select("path", "language", "line_no", "line")


def _tag_sql() -> str:
    parts = []
    for a in LINE_ACTIONS:
        langs = f"language IN ({', '.join(_quote(x) for x in a.languages)}) AND " if a.languages else ""
        if a.action == "pytest.generate_test":  # look-ahead, stated as two patterns
            test = r"regexp_matches(line, '^def \w+\s*\(') AND NOT regexp_matches(line, '^def test_')"
        else:
            test = f"regexp_matches(line, {_quote(a.pattern)})"
        parts.append(f"SELECT path, line_no, {_quote(a.action)} AS action FROM code WHERE {langs}{test}")
    return f"WITH code AS MATERIALIZED ({_CODE_LINES}) " + " UNION ALL ".join(parts)


@query(_tag_sql())
def line_actions(src: Source) -> DataFrame:
    tagged = scan.tag_lines(scan.with_language(code_files(src)))
    return tagged.select("path", "line_no", "action")


@query(
    " UNION ALL ".join(
        f"""SELECT DISTINCT path, {_quote(a.action)} AS action FROM <<diagnostics>>
            WHERE {f"language IN ({', '.join(_quote(x) for x in a.languages)}) AND" if a.languages else ""}
                  regexp_matches(message, {_quote(a.pattern)})"""
        for a in DIAGNOSTIC_ACTIONS
    )
)
def diagnostic_actions(src: Source) -> DataFrame:
    return scan.match_actions(src("diagnostics"))


@query(
    """SELECT path, line + 1 AS line, col + 1 AS col, message, severity, coalesce(source, 'unknown') AS source
       FROM <<diagnostics>> WHERE severity <> 'info' AND path LIKE 'ws/%'"""
)
def diagnostics_under_root(src: Source) -> DataFrame:
    return scan.filter_diagnostics(src("diagnostics"), "ws/")


# ── cutting, masking, joining text ───────────────────────────────────────────


@query(
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10)
                           || '... (truncated to fit context budget)' ELSE text END AS text FROM documents"""
)
def truncated_documents(src: Source) -> DataFrame:
    return src("documents").select("doc_id", text.truncate_text("text", 500).alias("text"))


@query(
    r"""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text
              WHEN NOT contains(substr(text, 1, 401), chr(10)) THEN substr(text, 1, 400) || chr(10) || '... (diff truncated)'
              ELSE regexp_extract(substr(text, 1, 401), '(?s)^(.*)\n', 1) || chr(10) || '... (diff truncated)' END AS text
       FROM documents"""
)
def documents_cut_at_newline(src: Source) -> DataFrame:
    return src("documents").select("doc_id", text.truncate_at_newline("text", 400).alias("text"))


_TRIM = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)"


@query(
    r"""SELECT doc_id, trim(regexp_replace(text, '(?m)^```\w*\n?|```\s*$', '', 'g'), """
    + _TRIM
    + """) AS text FROM <<generated>>"""
)
def fences_stripped(src: Source) -> DataFrame:
    return src("generated").select("doc_id", text.strip_fences("text").alias("text"))


@query(
    r"""SELECT id, regexp_replace(regexp_replace(content, '(?m)SECRET_KEY\s*=.*$', 'SECRET_KEY = <redacted>', 'g'),
                                  ':[^:@]+@', ':***@', 'g') AS content FROM <<settings_texts>>"""
)
def secrets_masked(src: Source) -> DataFrame:
    return src("settings_texts").select("id", text.redact("content").alias("content"))


@query(
    """SELECT doc_id, concat_ws(chr(10) || chr(10), '## Active file: ' || source,
              CASE WHEN lang = 'en' THEN nullif('', '') ELSE '### ' || lang END,
              nullif(CASE WHEN n_chars > 300 THEN '' ELSE text END, ''),
              '## Instruction:' || chr(10) || 'review') AS prompt
       FROM documents"""
)
def prompt_sections(src: Source) -> DataFrame:
    return src("documents").select(
        "doc_id",
        text.sections_text(
            F.concat(F.lit("## Active file: "), "source"),
            F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("### "), "lang")),
            F.when(F.col("n_chars") > 300, "").otherwise(F.col("text")),
            F.lit("## Instruction:\nreview"),
        ).alias("prompt"),
    )


@query(
    """SELECT doc_id, path, content FROM (
         SELECT doc_id, 'out/src/a' || doc_id || '.py' AS path, trim(text, %(trim)s) AS content FROM documents WHERE doc_id %% 5 = 0
         UNION ALL SELECT doc_id, 'out/lib/' || source || '.js', 'x' FROM documents WHERE doc_id %% 5 = 0
         UNION ALL SELECT doc_id, 'out/b.ts', 'y' FROM documents WHERE doc_id %% 5 = 1
         UNION ALL SELECT doc_id, 'out/generated.txt', trim(regexp_replace(text, '(?m)^```\\w*\\n?|```\\s*$', '', 'g'), %(trim)s)
                   FROM <<generated>> WHERE doc_id %% 5 IN (2, 4) AND trim(text, %(trim)s) <> '') g"""
    % {"trim": _TRIM}
)
def generated_file_rows(src: Source) -> DataFrame:
    """Fenced file sections of generated text, safe paths only; other text becomes one file."""
    return generated_files(src("generated"), "out", keep=["doc_id"])


@query(
    """WITH RECURSIVE p AS (
         SELECT page_id, 'site/' || regexp_replace(url, '^https?://', '') ||
                CASE page_id % 4 WHEN 0 THEN '/../../x' WHEN 1 THEN '/../../../../../../etc' WHEN 2 THEN '/./a//b'
                     ELSE '' END AS path FROM pages),
       start AS (SELECT page_id, path, string_split(path, '/') AS todo, CAST([] AS VARCHAR[]) AS kept, TRUE AS ok FROM p),
       fold AS (
         SELECT * FROM start
         UNION ALL
         SELECT page_id, path, todo[2:],
                CASE WHEN todo[1] IN ('', '.') THEN kept WHEN todo[1] = '..' THEN kept[1:len(kept) - 1]
                     ELSE list_append(kept, todo[1]) END,
                ok AND NOT (todo[1] = '..' AND len(kept) = 0)
         FROM fold WHERE len(todo) > 0)
       SELECT page_id, array_to_string(kept, '/') AS path FROM fold
       WHERE len(todo) = 0 AND ok AND kept[1] = 'site' AND len(kept) > 0"""
)
def safe_page_paths(src: Source) -> DataFrame:
    """Paths that stay inside the base folder once ``..`` is resolved."""
    suffix = (
        F.when(F.col("page_id") % 4 == 0, "/../../x")
        .when(F.col("page_id") % 4 == 1, "/../../../../../../etc")
        .when(F.col("page_id") % 4 == 2, "/./a//b")
        .otherwise("")
    )
    raw = src("pages").select(
        "page_id", F.concat(F.regexp_replace("url", "^https?://", ""), suffix).alias("path")
    )
    return safe_paths(raw, "site")


# ── logs, runs, times, labels ────────────────────────────────────────────────


@query(
    """SELECT log_id, name, message FROM <<messages>>
       WHERE contains(message, 'ERROR') AND ts >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY ts, log_id LIMIT 100"""
)
def log_filter(src: Source) -> DataFrame:
    start = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    found = select.filter_logs(src("messages"), "ERROR", start, 100)
    return found.select("log_id", "name", "message")


@query(
    """SELECT log_id, name, message FROM <<messages>>
       WHERE contains(message, 'ERROR') AND ts >= TIMESTAMP '2024-01-05 00:00:00'"""
)
def log_filter_whole(src: Source) -> DataFrame:
    start = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return select.filter_logs(src("messages"), "ERROR", start).select("log_id", "name", "message")


@query(
    """SELECT log_id, severity, message FROM <<messages>>
       WHERE resource = 'cloud_function' AND severity IN ('ERROR', 'WARNING')"""
)
def logs_at_severity_whole(src: Source) -> DataFrame:
    found = select.filter_logs_by_severity(src("messages"), "WARNING", "cloud_function", None)
    return found.select("log_id", "severity", "message")


@query(
    """SELECT log_id, severity, message FROM <<messages>>
       WHERE resource = 'cloud_function' AND severity IN ('ERROR', 'WARNING') ORDER BY ts DESC, log_id DESC LIMIT 50"""
)
def logs_at_severity(src: Source) -> DataFrame:
    found = select.filter_logs_by_severity(src("messages"), "WARNING", "cloud_function", 50)
    return found.select("log_id", "severity", "message")


@query("SELECT run_id, job_id FROM <<runs>> WHERE state = 'FAILED' OR error IS NOT NULL")
def failed_run_rows(src: Source) -> DataFrame:
    return select.failed_runs(src("runs"), "state", "error").select("run_id", "job_id")


@query(
    """SELECT cluster_id, state FROM <<clusters>> WHERE state = 'PENDING'"""
)
def clusters_with_problem(src: Source) -> DataFrame:
    found = select.problem_or_all(src("clusters"), F.col("state") == "PENDING")
    return found.select("cluster_id", "state")


@query("SELECT cluster_id, state FROM <<clusters>>")
def clusters_without_problem(src: Source) -> DataFrame:
    found = select.problem_or_all(src("clusters"), F.col("state") == "BROKEN")
    return found.select("cluster_id", "state")


@query("SELECT log_id, coalesce(text, substr(payload, 1, 5)) AS message FROM <<logs>>")
def log_messages(src: Source) -> DataFrame:
    return src("logs").select("log_id", labels.log_text("text", "payload", 5).alias("message"))


@query("SELECT regexp_extract(resource, '[^/]*$') AS name FROM <<functions>>")
def function_short_names(src: Source) -> DataFrame:
    return src("functions").select(paths.short_name("resource").alias("name"))


@query(
    """SELECT event_id, strftime(ts - INTERVAL (microsecond(ts) % 1000) MICROSECOND, '%Y-%m-%d %H:%M:%S.%g') AS from_millis,
              strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_seconds,
              strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_iso,
              strftime(ts - INTERVAL (microsecond(ts) % 1000) MICROSECOND, '%Y-%m-%d %H:%M:%S.%g') AS from_millis_text
       FROM events"""
)
def times_normalised(src: Source) -> DataFrame:
    """Four encodings of each event time read back as timestamps."""
    micros = epoch_micros("ts")
    fmt = "yyyy-MM-dd HH:mm:ss"
    millis = F.floor(micros / 1000).cast("bigint")
    raw = src("events").select(
        "event_id",
        millis.alias("ms"),
        F.floor(micros / 1_000_000).cast("bigint").alias("s"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        millis.cast("string").alias("ms_text"),
    )
    utc = lambda c: F.to_utc_timestamp(c, F.current_timezone())
    return raw.select(
        "event_id",
        F.date_format(utc(labels.from_epoch_millis("ms")), fmt + ".SSS").alias("from_millis"),
        F.date_format(utc(labels.from_epoch_seconds("s")), fmt).alias("from_seconds"),
        F.date_format(labels.from_iso("iso"), fmt).alias("from_iso"),
        F.date_format(utc(labels.from_epoch_millis("ms_text")), fmt + ".SSS").alias("from_millis_text"),
    )


def epoch_micros(ts: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


@query(
    """SELECT conv_id, turn, CASE
          WHEN contains(lower(instruction), 'explain') OR contains(lower(instruction), 'what') THEN 'explain code'
          WHEN contains(lower(instruction), 'test') THEN 'generate tests'
          WHEN contains(lower(instruction), 'fix') THEN 'fix errors'
          WHEN contains(lower(instruction), 'refactor') THEN 'refactor code'
          ELSE 'assist with this request' END AS task FROM <<instructions>>"""
)
def task_labels(src: Source) -> DataFrame:
    return src("instructions").select(
        "conv_id", "turn", labels.classify_task("instruction").alias("task")
    )


@query(
    """SELECT id, CASE WHEN code IN (401, 403) THEN 'auth'
          WHEN code = 404 THEN CASE WHEN lower(message) LIKE '%model%' OR lower(message) LIKE '%not found%'
                                    THEN 'model-missing' ELSE 'not-found' END
          WHEN code = 429 THEN 'rate-limit' WHEN code IN (500, 502, 503) THEN 'server' ELSE 'other' END AS class,
          CASE WHEN system_error LIKE '%ECONNREFUSED%' THEN 'refused' WHEN system_error LIKE '%ENOTFOUND%' THEN 'host-not-found'
               WHEN system_error LIKE '%ETIMEDOUT%' OR system_error LIKE '%ENETUNREACH%' THEN 'unreachable'
               ELSE 'connection' END AS connection_class
       FROM <<responses>>"""
)
def error_classes(src: Source) -> DataFrame:
    return src("responses").select(
        "id",
        labels.classify_error("code", "message").alias("class"),
        labels.classify_connection_error("system_error").alias("connection_class"),
    )


@query(
    """SELECT cluster_id, CASE WHEN min_workers IS NOT NULL THEN min_workers || '-' || max_workers || ' workers (autoscale)'
              ELSE coalesce(num_workers, 0) || ' workers' END AS workers FROM <<clusters>>"""
)
def cluster_workers(src: Source) -> DataFrame:
    return src("clusters").select(
        "cluster_id", labels.workers_label("num_workers", "min_workers", "max_workers").alias("workers")
    )


@query(
    """SELECT cluster_id, CASE WHEN cluster_id % 4 = 3 THEN 'Unknown' WHEN state = 'RUNNING' THEN 'Ready' ELSE state END AS status
       FROM <<clusters>>"""
)
def service_ready_status(src: Source) -> DataFrame:
    state = F.when(F.col("state") == "RUNNING", "CONDITION_SUCCEEDED").otherwise(F.col("state"))
    kind = F.when(F.col("cluster_id") % 4 == 3, "Routes").otherwise("Ready")
    conditions = F.array(
        F.struct(F.lit("Config").alias("type"), F.lit("x").alias("state")),
        F.struct(kind.alias("type"), state.alias("state")),
        F.struct(kind.alias("type"), F.lit("later").alias("state")),
    )
    return src("clusters").select("cluster_id", labels.ready_status(conditions).alias("status"))


@query(
    """SELECT o_custkey, 'Tasks=[' || string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) || '] | '
              || CASE WHEN o_custkey % 3 = 0 THEN 'No schedule'
                      ELSE 'Schedule: 0 ' || (o_custkey % 24) || ' * * * (UTC)' END AS label
       FROM orders GROUP BY o_custkey"""
)
def job_labels(src: Source) -> DataFrame:
    jobs = src("orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_set("o_orderpriority")).alias("tasks")
    )
    hour = (F.col("o_custkey") % 24).cast("string")
    cron = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("0 "), hour, F.lit(" * * *")))
    return jobs.select("o_custkey", labels.job_label("tasks", cron, F.lit("UTC")).alias("label"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '(none)'
              ELSE '  nation=' || s_nationkey || chr(10) || '  team=' || s_name END AS settings FROM supplier"""
)
def settings_as_text(src: Source) -> DataFrame:
    settings = F.create_map(
        F.lit("team"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string")
    )
    held = F.when(F.col("s_suppkey") % 7 != 0, settings)
    return src("supplier").select("s_suppkey", labels.map_text(held).alias("settings"))


# ── notebooks ────────────────────────────────────────────────────────────────


def notebook_files(src: Source) -> DataFrame:
    """One notebook per sixteen turns of a conversation: a cell per message, outputs on code cells."""
    kind = (
        F.when(F.col("role") == "assistant", "code").when(F.col("role") == "user", "markdown").otherwise("raw")
    )
    cell = F.struct(
        kind.alias("cell_type"),
        F.col("text").alias("source"),
        F.col("turn").alias("execution_count"),
        F.array(F.struct(F.col("role").alias("data"))).alias("outputs"),
    )
    part = F.floor(F.col("turn") / 16).alias("part")
    body = src("conversations").groupBy("conv_id", part).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))), lambda c: c["cell"]
        ).alias("cells")
    )
    spec = F.when(
        F.col("conv_id") % 3 != 0,
        F.struct(
            F.concat(F.lit("k"), (F.col("conv_id") % 4).cast("string")).alias("name"),
            F.when(F.col("conv_id") % 3 == 1, "scala").alias("language"),
        ),
    )
    doc = F.to_json(F.struct("cells", F.struct(spec.alias("kernelspec")).alias("metadata")))
    return body.select(
        F.concat(
            F.lit("nb/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("part").cast("string"), F.lit(".ipynb")
        ).alias("path"),
        F.when(F.col("conv_id") % 10 == 9, F.lit("{broken")).otherwise(doc).alias("content"),
    )


@query(
    """SELECT 'nb/' || conv_id || '-' || (turn // 16) || '.ipynb' AS path,
              CASE WHEN conv_id % 10 = 9 THEN 0 ELSE count(*) END AS n_cells,
              CASE WHEN conv_id % 10 = 9 THEN 0 ELSE count(*) FILTER (role = 'assistant') END AS n_code,
              CASE WHEN conv_id % 10 = 9 THEN 0 ELSE count(*) FILTER (role = 'user') END AS n_markdown,
              CASE WHEN conv_id % 10 = 9 OR conv_id % 3 = 0 THEN 'unknown' ELSE 'k' || (conv_id % 4) END AS kernel,
              CASE WHEN conv_id % 10 <> 9 AND conv_id % 3 = 1 THEN 'scala' ELSE 'python' END AS language
       FROM conversations GROUP BY conv_id, turn // 16"""
)
def notebooks_read(src: Source) -> DataFrame:
    """Notebook cells, kernel and language; broken notebooks count as empty."""
    return notebook_stats(notebook_files(src))


@query(
    """SELECT 'nb/' || conv_id || '-' || (turn // 16) || '.ipynb' AS path,
              CASE WHEN conv_id % 10 = 9 THEN 0 ELSE count(*) FILTER (role <> 'assistant') END AS n_outputs,
              CASE WHEN conv_id % 10 = 9 THEN 0 ELSE count(*) FILTER (role <> 'assistant') END AS n_counts,
              CASE WHEN conv_id % 10 = 9 THEN 0 ELSE count(*) END AS n_cells,
              CASE WHEN conv_id % 10 = 9 THEN 0 ELSE CAST(sum(length(text)) AS BIGINT) END AS n_source
       FROM conversations GROUP BY conv_id, turn // 16"""
)
def notebooks_cleaned(src: Source) -> DataFrame:
    """What is left after cleaning: outputs and counts of non-code cells, and all sources."""
    cleaned = clean_outputs(notebook_files(src))
    schema = "cells array<struct<cell_type string, source string, execution_count bigint, outputs array<string>>>"
    cells = F.coalesce(F.from_json("content", schema)["cells"], F.array())
    zero = F.lit(0).cast("bigint")
    return cleaned.select("path", cells.alias("cells")).select(
        "path",
        F.aggregate("cells", zero, lambda a, c: a + F.size(c["outputs"])).alias("n_outputs"),
        F.size(F.filter("cells", lambda c: c["execution_count"].isNotNull())).cast("bigint").alias("n_counts"),
        F.size("cells").cast("bigint").alias("n_cells"),
        F.aggregate("cells", zero, lambda a, c: a + F.length(c["source"])).alias("n_source"),
    )
