"""FastAPI routes, Pydantic models, dependencies, Django apps, models and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.paths import base_name, dir_name
from winnow.functions.text import all_groups
from winnow.operators.joins import distinct_ordered
from winnow.operators.packs import distinct_in_order, extract, matching
from winnow.operators.select import lookahead_match
from winnow.operators.skew import top_per_key

# Patterns and names.
PY_PATH = r"\.py$"
METHODS = "get|post|put|delete|patch|head|options"
ROUTE_FILE = r"@(?:app|router)\.(?:get|post|put|delete|patch)"
ROUTE = rf"""@(?:app|router)\.({METHODS})\s*\(\s*['"]([^'"]+)['"]"""
ROUTE_CALL = rf"@(?:app|router)\.({METHODS})\s*\("
FUNCTION = r"(?:async\s+)?def\s+(\w+)\s*\("
LINES_AHEAD = 3
MODEL_CLASS_BODY = (
    r"(?m)^class\s+(\w+)\s*\(\s*(?:Base)?Model\s*\)(?=((?s:.*?))(?:\nclass |\z))"
)
MODEL_FIELD = r"(?m)^\s{4}(\w+)\s*:"
DEPENDS = r"Depends\s*\(\s*(\w+)\s*\)"
YIELD_FUNCTION = r"def\s+\w+\s*\([^)]*\)\s*(?:->\s*\w+\s*)?:(?s:.*?)yield"
DJANGO_MODEL = r"(?m)^class\s+(\w+)\s*\(\s*(?:models\.Model|[\w.]*Model[\w.]*)\s*\)"
DJANGO_FILES = ["models.py", "views.py", "urls.py", "admin.py", "forms.py", "serializers.py"]
SKIPPED_APPS = [
    "node_modules", ".git", "__pycache__", "dist", "build", ".venv", "venv", "env", ".env", "migrations",
]
SECRET_SETTING = r"(?m)SECRET_KEY\s*=.*$"
SECRET_MASK = "SECRET_KEY = <redacted>"
INSTALLED_APPS = r"INSTALLED_APPS\s*=\s*\[(?s:.*?)\]"
DATABASES = r"DATABASES\s*=\s*\{(?s:.*?)\n\}"
MIDDLEWARE = r"MIDDLEWARE\s*=\s*\[(?s:.*?)\]"
QUOTED_NAME = r"'([\w.]+)'"
ENGINE = r"'ENGINE':\s*'([\w.]+)'"
SETTING_FLAGS = {
    "has_drf": "(?i)rest_framework",
    "has_celery": "(?i)celery",
    "has_cors": "(?i)corsheaders",
    "has_channels": "(?i)channels",
}


def fastapi_routes(files: DataFrame) -> DataFrame:
    """Route decorators with the function defined within the next three lines."""
    routed = matching(files, PY_PATH, "@").filter(F.rlike("content", F.lit(ROUTE_FILE)))
    found = lookahead_match(routed.select("path", "content"), ROUTE, FUNCTION, LINES_AHEAD)
    return found.select(
        "path",
        "line_no",
        F.upper(F.regexp_extract("line", ROUTE, 1)).alias("method"),
        F.regexp_extract("line", ROUTE, 2).alias("route"),
        F.coalesce("found", F.lit("(unknown)")).alias("function"),
    )


def fastapi_route_count(files: DataFrame) -> DataFrame:
    counted = matching(files, PY_PATH).select(F.regexp_count("content", F.lit(ROUTE_CALL)).alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_routes"))


def pydantic_models(files: DataFrame) -> DataFrame:
    """Model classes, first sighting only, with the fields up to the next class."""
    py = matching(files, PY_PATH).filter(
        F.contains("content", F.lit("BaseModel")) | F.contains("content", F.lit("pydantic"))
    )
    classes = py.select(
        "path",
        F.posexplode(
            F.arrays_zip(
                all_groups("content", MODEL_CLASS_BODY, 1).alias("name"),
                all_groups("content", MODEL_CLASS_BODY, 2).alias("body"),
            )
        ).alias("pos", "c"),
    )
    models = classes.select(
        "path",
        "pos",
        "c.name",
        F.regexp_count("c.body", F.lit(MODEL_FIELD)).cast("bigint").alias("n_fields"),
    )
    return top_per_key(models, ["name"], [F.col("path"), F.col("pos")], 1).select(
        "name", "path", "n_fields"
    )


def fastapi_dependencies(files: DataFrame) -> DataFrame:
    """Per file with dependencies: distinct names and the count of yielding functions."""
    py = matching(files, PY_PATH, "Depends")
    return py.select(
        "path",
        distinct_in_order(all_groups("content", DEPENDS)).alias("depends"),
        F.regexp_count("content", F.lit(YIELD_FUNCTION)).cast("bigint").alias("n_yield"),
    )


def dependency_names(files: DataFrame) -> DataFrame:
    """Distinct dependency names of the corpus with the place of their first sighting."""
    calls = extract(matching(files, PY_PATH, "Depends"), DEPENDS, {"name": 1})
    return distinct_ordered(calls, "name", ["path", "pos"])


def django_apps(files: DataFrame) -> DataFrame:
    """Top-level directories with models or views, and which of the usual files they hold."""
    top = files.filter(F.rlike("path", F.lit(r"^[^/]+/[^/]+\.py$")) & base_name("path").isin(*DJANGO_FILES))
    apps = top.filter(~dir_name("path").isin(*SKIPPED_APPS)).groupBy(dir_name("path").alias("app"))
    flags = {f"has_{n.removesuffix('.py')}": F.bool_or(base_name("path") == n) for n in DJANGO_FILES}
    return apps.agg(*[f.alias(n) for n, f in flags.items()]).filter("has_models or has_views")


def django_models(files: DataFrame) -> DataFrame:
    """Model classes of each app's models file, in order."""
    models = matching(files, r"^[^/]+/models\.py$", "class").select(
        dir_name("path").alias("app"), all_groups("content", DJANGO_MODEL).alias("models")
    )
    return models.filter((F.size("models") > 0) & ~F.col("app").isin(*SKIPPED_APPS))


def django_settings(
    files: DataFrame, max_apps: int | None = None, max_middleware: int | None = None
) -> DataFrame:
    """Apps, engines, middleware and feature flags of settings files; the secret is masked first."""
    safe = files.filter(base_name("path") == "settings.py").select(
        "path", F.regexp_replace("content", SECRET_SETTING, SECRET_MASK).alias("content")
    )

    def names(section: str, item: str, n: int | None = None) -> Column:
        found = all_groups(F.regexp_extract("content", section, 0), item)
        return F.slice(found, 1, n) if n is not None else found

    return safe.select(
        "path",
        names(INSTALLED_APPS, QUOTED_NAME, max_apps).alias("installed_apps"),
        names(DATABASES, ENGINE).alias("databases"),
        names(MIDDLEWARE, QUOTED_NAME, max_middleware).alias("middleware"),
        *[F.rlike("content", F.lit(p)).alias(n) for n, p in SETTING_FLAGS.items()],
    )
