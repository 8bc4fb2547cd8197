"""Kubernetes manifests, Helm charts, Dockerfiles and compose files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.paths import base_name, dir_name
from winnow.functions.text import all_groups, trim_space
from winnow.operators.joins import exclude_values
from winnow.operators.packs import extract, first_existing, matching, or_default

# Patterns and names.
YAML_PATH = r"\.ya?ml$"
API_PATTERN = r"apiVersion:\s*\S+"
KIND_PATTERN = r"kind:\s*\S+"
DOCUMENT_BREAK = r"(?m)^---\s*$"
DOC_KIND = r"(?m)^kind:\s*(\S+)"
DOC_NAME = r"(?m)^\s{0,4}name:\s*(\S+)"
DOC_NAMESPACE = r"(?m)^\s{0,4}namespace:\s*(\S+)"
VALUE_KEY = r"(?m)^([a-zA-Z][a-zA-Z0-9_]*):"
FROM_LINE = r"(?im)^FROM\s+(\S+)(?:\s+AS\s+(\S+))?"
DOCKERFILE_PATH = r"(?:^|/)Dockerfile[^/]*$|(?i:\.dockerfile)$"
COMPOSE_NAMES = ["docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]
# a service key and the lines up to the next one or to a line that is not indented
SERVICE = r"(?m)^  (\w[\w-]*):[ \t\r]*(?=\n|\z)((?:\n(?!  \w[\w-]*:[ \t\r]*(?:\n|\z)|\S)[^\n]*)*+)"
NOT_SERVICES = ["networks", "volumes", "configs", "secrets"]
IMAGE_PATTERN = r"image:\s*(\S+)"
PORTS_SECTION = r"(?m)ports:((?s:.*?))(?=\n  \w|\n\w|$)"
PORT_ITEM = r"""- ["']?(\d[\d.:/-]+)["']?"""


def _manifests(files: DataFrame) -> DataFrame:
    return matching(files, YAML_PATH, "apiVersion:").filter(
        F.rlike("content", F.lit(API_PATTERN)) & F.rlike("content", F.lit(KIND_PATTERN))
    )


def k8s_manifests(files: DataFrame) -> DataFrame:
    """One row per YAML document with a kind: kind, name and namespace."""
    docs = _manifests(files).select(
        "path", F.posexplode(F.split("content", DOCUMENT_BREAK)).alias("doc_no", "doc")
    )
    found = docs.select(
        "path",
        "doc_no",
        F.regexp_extract("doc", DOC_KIND, 1).alias("kind"),
        or_default(F.regexp_extract("doc", DOC_NAME, 1), "(unnamed)").alias("name"),
        or_default(F.regexp_extract("doc", DOC_NAMESPACE, 1), "default").alias("namespace"),
    )
    return found.filter(F.col("kind") != "")


def k8s_namespaces(files: DataFrame) -> DataFrame:
    """Distinct namespaces except ``default``."""
    found = extract(_manifests(files), DOC_NAMESPACE, {"namespace": 1})
    return exclude_values(found, "namespace", ["default"])


def helm_chart(files: DataFrame, max_keys: int | None = None) -> DataFrame:
    """Name, version and description of each chart and the (first) top-level keys of its values."""
    named = files.filter(base_name("path").isin("Chart.yaml", "values.yaml")).select(
        dir_name("path").alias("dir"), base_name("path").alias("file"), "content"
    )

    def field(key: str):
        return trim_space(F.regexp_extract("content", rf"(?m)^{key}:\s*(.+)", 1)).alias(key)

    charts = named.filter(F.col("file") == "Chart.yaml").select(
        "dir", field("name"), field("version"), field("description")
    )
    keys = all_groups("content", VALUE_KEY)
    keys = keys if max_keys is None else F.slice(keys, 1, max_keys)
    values = named.filter(F.col("file") == "values.yaml").select("dir", keys.alias("value_keys"))
    return charts.join(values, "dir", "left").withColumn(
        "value_keys", F.coalesce("value_keys", F.array().cast("array<string>"))
    )


def dockerfile_stages(files: DataFrame) -> DataFrame:
    """Base image and stage name of every FROM line; the default name counts from 0."""
    stages = extract(matching(files, DOCKERFILE_PATH), FROM_LINE, {"base": 1, "name": 2})
    default = F.concat(F.lit("stage"), F.col("pos").cast("string"))
    return stages.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), default))


def compose_services(files: DataFrame) -> DataFrame:
    """Services of compose files with image, ports and health check flag.

    All come from the lines of the service itself, however many. Ports are only
    seen on the line of ``ports:`` itself.
    """
    keys = files.select(
        *[c for c in files.columns if c != "content"],
        F.posexplode(
            F.arrays_zip(
                all_groups("content", SERVICE, 1).alias("name"),
                all_groups("content", SERVICE, 2).alias("body"),
            )
        ).alias("pos", "s"),
    )
    keep = [c for c in keys.columns if c != "s"]
    body = F.col("s.body")
    return keys.filter(~F.col("s.name").isin(*NOT_SERVICES)).select(
        *keep,
        F.col("s.name").alias("name"),
        F.regexp_extract(body, IMAGE_PATTERN, 1).alias("image"),
        all_groups(F.regexp_extract(body, PORTS_SECTION, 0), PORT_ITEM).alias("ports"),
        F.rlike(body, F.lit("(?i)healthcheck:")).alias("has_healthcheck"),
    )


def compose_service_names(files: DataFrame) -> DataFrame:
    """Per workspace, the services of the first existing compose file. ``files``: ws, path, content."""
    chosen = first_existing(files, COMPOSE_NAMES)
    return compose_services(chosen).select("ws", "path", "pos", "name")
