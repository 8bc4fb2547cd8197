"""Joins and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators import joins
from winnow.plans.registry import Source, query

_SIBLINGS = """
    named AS (SELECT path, regexp_extract(path, '^(.*)/', 1) AS dir, regexp_extract(path, '[^/]*$') AS name,
                     regexp_extract(path, '([^/]*)[.][^./]*$', 1) AS part FROM <<files>>),
    near AS (
      SELECT a.path, b.path AS sibling, CAST(row_number() OVER (PARTITION BY a.path ORDER BY b.name) AS INTEGER) AS rank
      FROM named a JOIN named b ON a.dir = b.dir AND a.path <> b.path AND contains(b.name, a.part))"""


@query(f"WITH {_SIBLINGS} SELECT path, sibling, rank FROM near WHERE rank <= 5")
def sibling_files(src: Source) -> DataFrame:
    return joins.siblings(src("files"))


# directory, then one step per segment: only './x', '../x' and '../dir/x' occur
_TARGETS = r"""
    calls AS (
      SELECT path, regexp_extract(path, '^(.*)/', 1) AS dir,
             unnest(regexp_extract_all(content, '(?:import|require|from)\s+[''"]([^''"]+)[''"]', 1)) AS spec,
             generate_subscripts(regexp_extract_all(content, '(?:import|require|from)\s+[''"]([^''"]+)[''"]', 1), 1) - 1 AS pos
      FROM <<code_files>>),
    based AS (
      SELECT path, pos, CASE WHEN starts_with(spec, '../') THEN regexp_replace(dir, '/?[^/]*$', '') ELSE dir END
             || '/' || regexp_replace(spec, '^[.]+/', '') AS base
      FROM calls WHERE starts_with(spec, '.')),
    tried AS (
      SELECT path, pos, ltrim(base, '/') || suffix AS target, k
      FROM based, (VALUES ('', 0), ('.ts', 1), ('.js', 2), ('/index.ts', 3), ('/index.js', 4)) s(suffix, k)),
    hits AS (
      SELECT t.path, t.pos, arg_min(t.target, t.k) AS target FROM tried t
      WHERE t.target IN (SELECT path FROM <<code_files>>) GROUP BY t.path, t.pos),
    linked AS (SELECT path, target, CAST(min(pos) AS INTEGER) AS pos FROM hits GROUP BY path, target)"""


@query(f"WITH {_TARGETS} SELECT * FROM linked")
def import_links(src: Source) -> DataFrame:
    return joins.import_targets(src("code_files"))


@query(
    f"""WITH {_SIBLINGS.replace("<<files>>", "<<code_files>>")}, {_TARGETS},
        both_kinds AS (
          SELECT path, sibling AS related, 0 AS source, rank AS pos FROM near WHERE rank <= 5
          UNION ALL SELECT path, target, 1, pos FROM linked),
        first AS (SELECT path, related, min({{'s': source, 'p': pos}}) AS o FROM both_kinds GROUP BY path, related),
        ranked AS (SELECT path, related, CAST(row_number() OVER (PARTITION BY path ORDER BY o.s, o.p, related) AS INTEGER) AS rank
                   FROM first)
        SELECT * FROM ranked WHERE rank <= 5"""
)
def related_files(src: Source) -> DataFrame:
    return joins.related_files(src("code_files"))


@query(
    """SELECT e.name, e.n_errors, f.config
       FROM (SELECT coalesce(name, 'unknown') AS name, count(*) AS n_errors FROM <<error_logs>> GROUP BY 1) e
       LEFT JOIN (SELECT regexp_extract(resource, '[^/]*$') AS name, config FROM <<functions>>) f ON e.name = f.name"""
)
def errors_with_config(src: Source) -> DataFrame:
    errors = src("error_logs").groupBy(F.coalesce("name", F.lit("unknown")).alias("name")).agg(
        F.count("*").alias("n_errors")
    )
    return joins.errors_with_config(errors, src("functions"))


@query(
    """SELECT r.run_id, r.job_id, coalesce(j.job_name, 'Job ' || r.job_id) AS job_name,
              CASE WHEN j.job_id IS NULL THEN '  (no task details)'
                   WHEN r.job_id % 3 = 0 THEN '  - load' || chr(10) || '  - check: of ' || j.job_name
                   ELSE '  - load' END AS task_text
       FROM <<runs>> r LEFT JOIN <<jobs>> j ON r.job_id = j.job_id WHERE r.state = 'FAILED'"""
)
def failed_runs_with_job(src: Source) -> DataFrame:
    load = F.struct(F.lit("load").alias("task_key"), F.lit(None).cast("string").alias("description"))
    check = F.struct(
        F.lit("check").alias("task_key"), F.concat(F.lit("of "), "job_name").alias("description")
    )
    tasks = F.when(F.col("job_id") % 3 == 0, F.array(load, check)).otherwise(F.array(load))
    failed = src("runs").filter(F.col("state") == "FAILED").select("run_id", "job_id")
    return joins.runs_with_job(failed, src("jobs").withColumn("tasks", tasks))


@query(
    """SELECT k.table_name, k.attribute, k.key_type, coalesce(a.attribute_type, '?') AS attribute_type
       FROM <<key_columns>> k LEFT JOIN <<attributes>> a ON k.table_name = a.table_name AND k.attribute = a.attribute"""
)
def key_column_types(src: Source) -> DataFrame:
    return joins.key_types(src("key_columns"), src("attributes"))


@query("SELECT * FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def enabled_suppliers(src: Source) -> DataFrame:
    disabled = src("nation").filter(F.col("n_regionkey") == 2).select(F.col("n_nationkey").alias("s_nationkey"))
    return joins.drop_disabled(src("supplier"), disabled, "s_nationkey")


_DETECTED = "SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase'"
_ACTIVE = "SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'signup'"


@query(
    f"""SELECT coalesce(d.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'activated' ELSE 'deactivated' END AS change
        FROM ({_DETECTED}) d FULL JOIN ({_ACTIVE}) a ON d.id = a.id WHERE d.id IS NULL OR a.id IS NULL"""
)
def activation_difference(src: Source) -> DataFrame:
    def ids(kind: str) -> DataFrame:
        return src("events").filter(F.col("event_type") == kind).select(F.col("user_id").alias("id"))

    return joins.activation_diff(ids("purchase"), ids("signup"))


@query(
    """SELECT user_id, event_id, event_type FROM
       (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) e WHERE rn = 1"""
)
def first_event_per_user(src: Source) -> DataFrame:
    rows = src("events").select("user_id", "event_id", "event_type", "ts")
    return joins.first_wins(rows, "user_id", [F.col("ts"), F.col("event_id")]).drop("ts")


@query(
    """SELECT doc_id, stage FROM (
         SELECT doc_id, 'staged' AS stage FROM labels WHERE quality = 1 AND toxic = 1
         UNION ALL SELECT doc_id, 'unstaged' FROM labels WHERE quality = 0 AND toxic = 1) c
       ORDER BY stage, doc_id LIMIT 10"""
)
def first_changes(src: Source) -> DataFrame:
    toxic = src("labels").filter(F.col("toxic") == 1)
    staged = toxic.filter(F.col("quality") == 1).select("doc_id")
    working = toxic.filter(F.col("quality") == 0).select("doc_id")
    return joins.union_changes(staged, working, "doc_id", 10)


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def part_names_in_order(src: Source) -> DataFrame:
    return joins.distinct_ordered(src("part"), "p_name", ["p_partkey"])


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'")
def priorities_but_low(src: Source) -> DataFrame:
    return joins.exclude_values(src("orders"), "o_orderpriority", ["5-LOW"])


@query(
    """SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY k) AS INTEGER) AS pos, name, error FROM (
         SELECT 0 AS source, 'fn-' || regexp_extract(resource, '[0-9]+$') AS name, 'Function state: ' || state AS error,
                row_number() OVER (ORDER BY resource) AS k
         FROM (SELECT * FROM <<functions>> ORDER BY resource LIMIT 5) f WHERE state <> 'ACTIVE'
         UNION ALL
         SELECT 1, coalesce(name, 'unknown'), message, row_number() OVER (ORDER BY ts DESC, log_id DESC)
         FROM (SELECT * FROM <<error_logs>> ORDER BY ts DESC, log_id DESC LIMIT 3) l) u"""
)
def current_problems(src: Source) -> DataFrame:
    return joins.union_problems(src("functions"), src("error_logs"), 5).drop("at")


@query(
    """SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY k) AS INTEGER) AS pos, name, error FROM (
         SELECT 0 AS source, 'fn-' || regexp_extract(resource, '[0-9]+$') AS name, 'Function state: ' || state AS error,
                row_number() OVER (ORDER BY resource) AS k FROM <<functions>> WHERE state <> 'ACTIVE'
         UNION ALL
         SELECT 1, coalesce(name, 'unknown'), message, row_number() OVER (ORDER BY ts DESC, log_id DESC)
         FROM (SELECT * FROM <<error_logs>> ORDER BY ts DESC, log_id DESC LIMIT 3) l) u"""
)
def problems_of_all_functions(src: Source) -> DataFrame:
    return joins.union_problems(src("functions"), src("error_logs")).drop("at")


@query(
    """SELECT 'topic' AS kind, topic_name AS name FROM <<topics>>
       WHERE topic NOT IN (SELECT topic FROM <<subscriptions>>)
       UNION ALL SELECT 'subscription', subscription_name FROM <<subscriptions>>
       WHERE topic NOT IN (SELECT topic FROM <<topics>>)"""
)
def messaging_orphans(src: Source) -> DataFrame:
    return joins.orphans(src("topics"), src("subscriptions"))
