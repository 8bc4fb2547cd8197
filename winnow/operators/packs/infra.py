"""Terraform files and cloud templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.paths import base_name
from winnow.functions.text import trim_space
from winnow.operators.joins import distinct_ordered
from winnow.operators.packs import extract, matching

# Patterns and names.
TF_PATH = r"\.tf$"
PROVIDER = r'provider\s+"([^"]+)"'
RESOURCE = r'resource\s+"([^"]+)"\s+"([^"]+)"'
VARIABLE = r'(?s)variable\s+"([^"]+)"\s*\{([^}]*)\}'
VARIABLE_TYPE = r"type\s*=\s*(\S+)"
VARIABLE_DEFAULT = r'default\s*=\s*"?([^"\n]+)"?'
TEMPLATE_NAMES = ["template.yaml", "template.yml", "template.json"]
TEMPLATE_TYPE = r"""Type:\s*['"]?(AWS::\w+::\w+)"""


def tf_providers(files: DataFrame) -> DataFrame:
    """Distinct providers with the place of their first sighting."""
    found = extract(matching(files, TF_PATH, "provider"), PROVIDER, {"provider": 1})
    return distinct_ordered(found, "provider", ["path", "pos"])


def tf_resources(files: DataFrame) -> DataFrame:
    return extract(matching(files, TF_PATH, "resource"), RESOURCE, {"type": 1, "name": 2})


def tf_variables(files: DataFrame) -> DataFrame:
    """Variable blocks up to the first closing brace: name, type and default (null when absent)."""
    blocks = extract(matching(files, TF_PATH, "variable"), VARIABLE, {"name": 1, "body": 2})
    default = trim_space(F.regexp_extract("body", VARIABLE_DEFAULT, 1))
    return blocks.select(
        "path",
        "pos",
        "name",
        F.nullif(F.regexp_extract("body", VARIABLE_TYPE, 1), F.lit("")).alias("type"),
        F.when(F.rlike("body", F.lit(VARIABLE_DEFAULT)), default).alias("default"),
    )


def cfn_resources(files: DataFrame) -> DataFrame:
    """Distinct template resource types with the place of their first sighting."""
    templates = files.filter(base_name("path").isin(*TEMPLATE_NAMES))
    found = extract(templates, TEMPLATE_TYPE, {"type": 1})
    return distinct_ordered(found, "type", ["path", "pos"])
