"""dbt projects and Airflow deployments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.paths import base_name, stem
from winnow.functions.text import all_groups, trim_space
from winnow.operators.packs import distinct_in_order, matching, or_default

# Patterns, names and defaults.
YAML_VALUE = r"""['"]?([^'"\n\r]+)['"]?"""
MATERIALIZED = r"""\+materialized:\s*['"]?(\w+)['"]?"""
CONFIG_CALL = r"\{\{\s*config\s*\(([^)]+)\)\s*\}\}"
CONFIG_MATERIALIZED = r"""materialized\s*=\s*['"](\w+)['"]"""
SOURCE_PATH = r"(?:schema|sources)\.ya?ml$"
SOURCE_BLOCK = (
    r"""- name:\s*['"]?([^'"\n\r]+)['"]?\s*\n(?:\s+schema:\s*['"]?([^'"\n\r]+)['"]?)?"""
)
SOURCE_NAME = r"""- name:\s*['"]?([^'"\n\r]+)['"]?\s*\n"""
PROJECT_DEFAULTS = {"name": "unknown", "version": "1.0.0", "profile": "default"}
PATH_DEFAULTS = {"model": "models", "test": "tests", "macro": "macros", "seed": "seeds"}
DAG_ID = r"""dag_id\s*=\s*['"]([^'"]+)['"]"""
SCHEDULE_TEXT = r"""schedule(?:_interval)?\s*=\s*['"]([^'"]+)['"]"""
SCHEDULE_OTHER = r"schedule(?:_interval)?\s*=\s*(None|timedelta\([^)]+\))"
COMPONENTS = {
    "operator": r"class\s+\w+Operator\s*\(",
    "sensor": r"class\s+\w+Sensor\s*\(",
    "hook": r"class\s+\w+Hook\s*\(",
}
CONFIG_KEYS = {
    "executor": "executor",
    "database_conn": "sql_alchemy_conn",
    "dag_folder": "dags_folder",
    "max_active_runs": "max_active_runs_per_dag",
}
PASSWORD_IN_URL = r"^((?s:.*?)):[^:@]+@"


def _path_list(kind: str) -> Column:
    raw = F.regexp_extract("content", rf"{kind}-paths:\s*\[([^\]]+)\]", 1)
    items = F.transform(
        F.split(raw, ","), lambda p: trim_space(F.regexp_replace(p, r"""['"]""", ""))
    )
    return F.when(raw == "", F.array(F.lit(PATH_DEFAULTS[kind]))).otherwise(items)


def dbt_project(files: DataFrame) -> DataFrame:
    """Settings of each project file, with defaults for what is missing."""

    def setting(key: str) -> Column:
        found = F.regexp_extract("content", rf"(?m)^{key}:\s*{YAML_VALUE}", 1)
        return F.when(found == "", PROJECT_DEFAULTS[key]).otherwise(trim_space(found))

    return files.filter(base_name("path") == "dbt_project.yml").select(
        "path",
        *[setting(k).alias(k) for k in PROJECT_DEFAULTS],
        *[_path_list(k).alias(f"{k}_paths") for k in PATH_DEFAULTS],
        distinct_in_order(all_groups("content", MATERIALIZED)).alias("materializations"),
    )


def dbt_models(files: DataFrame) -> DataFrame:
    """SQL files under ``models/`` with their materialization (default view)."""
    inner = F.regexp_extract("content", CONFIG_CALL, 1)
    return matching(files, r"^models/.*\.sql$").select(
        "path",
        or_default(F.regexp_extract(inner, CONFIG_MATERIALIZED, 1), "view").alias("materialization"),
    )


def dbt_sources(files: DataFrame, max_tables: int | None = None) -> DataFrame:
    """Named entries of source files; every entry lists the (first) names of its whole file as tables."""
    sources = matching(files, SOURCE_PATH, "sources:")
    names = all_groups("content", SOURCE_NAME)
    tables = F.transform(names if max_tables is None else F.slice(names, 1, max_tables), trim_space)
    rows = sources.select(
        "path",
        F.array_join(tables, ", ").alias("tables"),
        F.posexplode(all_groups("content", SOURCE_BLOCK, 0)).alias("pos", "block"),
    )
    name = trim_space(F.regexp_extract("block", SOURCE_BLOCK, 1))
    schema = trim_space(F.regexp_extract("block", SOURCE_BLOCK, 2))
    return rows.select(
        "path",
        "pos",
        name.alias("name"),
        F.coalesce(F.nullif(schema, F.lit("")), name).alias("schema"),
        "tables",
    )


def airflow_dags(files: DataFrame) -> DataFrame:
    """DAG id (default: file stem) and schedule of the files under ``dags/``."""
    schedule = F.coalesce(
        F.nullif(F.regexp_extract("content", SCHEDULE_TEXT, 1), F.lit("")),
        F.nullif(F.regexp_extract("content", SCHEDULE_OTHER, 1), F.lit("")),
    )
    dag_id = F.nullif(F.regexp_extract("content", DAG_ID, 1), F.lit(""))
    return matching(files, r"(?:^|/)dags/.*\.py$").select(
        "path", F.coalesce(dag_id, stem("path")).alias("dag_id"), schedule.alias("schedule")
    )


def airflow_config(files: DataFrame) -> DataFrame:
    """Four settings of each ``airflow.cfg``; the password of the connection is masked."""

    def setting(key: str) -> Column:
        return F.nullif(trim_space(F.regexp_extract("content", rf"(?m)^{key}\s*=\s*(.+)$", 1)), F.lit(""))

    cols = {n: setting(k) for n, k in CONFIG_KEYS.items()}
    cols["database_conn"] = F.regexp_replace(cols["database_conn"], PASSWORD_IN_URL, "$1:***@")
    return files.filter(base_name("path") == "airflow.cfg").select(
        "path", *[c.alias(n) for n, c in cols.items()]
    )


def airflow_components(files: DataFrame) -> DataFrame:
    """Files under ``plugins/`` that define operators, sensors or hooks, one row per kind."""
    kinds = F.array_compact(
        F.array(*[F.when(F.rlike("content", F.lit(p)), F.lit(k)) for k, p in COMPONENTS.items()])
    )
    return matching(files, r"(?:^|/)plugins/.*\.py$").select(
        "path", stem("path").alias("name"), F.explode(kinds).alias("kind")
    )


