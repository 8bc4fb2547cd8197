"""Which technology stacks a workspace uses."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import ascii_boundary


class StackRule(NamedTuple):
    """A stack is present when some file meets one of its rules.

    ``path`` is a pattern on the relative path; ``content``, when given, must
    also be found in the text.
    """

    stack: str
    path: str
    content: str | None = None


_PY, _PY_JS = r"\.py$", r"\.(?:py|js|ts)$"
_DEPS = r"^(?:requirements\.txt|pyproject\.toml|setup\.py)$"

# Stack rules, marker files first, then texts of dependency and source files.
STACK_RULES = [
    StackRule("spark", r"^(?:\.databricks(?:/.*)?|databricks\.ya?ml|\.databrickscfg|bundle\.ya?ml)$"),
    StackRule("spark", _DEPS, r"(?i)pyspark|databricks-connect|databricks-sdk"),
    StackRule("spark", _PY, r"from pyspark|import pyspark|SparkSession|spark\s*=\s*SparkSession"),
    StackRule(
        "aws",
        r"^(?:samconfig\.toml|samconfig\.yaml|cdk\.json|serverless\.ya?ml|buildspec\.yml|appspec\.yml"
        r"|taskdef\.json|Dockerrun\.aws\.json|\.aws/credentials|\.aws/config)$",
    ),
    StackRule("aws", r"^template\.ya?ml$", r"(?i)AWSTemplateFormatVersion"),
    StackRule(
        "aws",
        r"^(?:requirements\.txt|pyproject\.toml|setup\.py|package\.json)$",
        r"(?i)boto3|aws-cdk|@aws-sdk|aws-sdk|serverless|aws-lambda",
    ),
    StackRule(
        "aws",
        _PY_JS,
        r"""import\s+boto3|from\s+boto3|from\s+aws_cdk|require\(['"]aws-sdk['"]\)|@aws-sdk\/""",
    ),
    StackRule(
        "gcp",
        r"^(?:app\.ya?ml|\.gcloudignore|cloudbuild\.ya?ml|firebase\.json|firestore\.rules"
        r"|firestore\.indexes\.json|\.firebaserc|cloud-functions/.*)$",
    ),
    StackRule("gcp", _DEPS, r"(?i)google-cloud|functions-framework|firebase-admin"),
    StackRule("gcp", r"^package\.json$", r"(?i)@google-cloud\/|firebase-admin|firebase-functions"),
    StackRule("gcp", r"^terraform/[^/]+\.tf$", r"""provider\s+["']google["']"""),
    StackRule(
        "gcp", _PY_JS, r"""from google\.cloud|require\(['"]@google-cloud\/|google-cloud-|functions_framework"""
    ),
    StackRule(
        "azure",
        r"^(?:host\.json|local\.settings\.json|function\.json|azure-pipelines\.ya?ml|\.azure(?:/.*)?"
        r"|azuredeploy\.json|main\.bicep)$|\.bicep$",
    ),
    StackRule(
        "azure",
        r"^appsettings\.json$",
        r"(?i)AccountEndpoint=|DefaultEndpointsProtocol=|\.azure\.com|\.windows\.net",
    ),
    StackRule("azure", r"^\.env$", r"(?m)^AZURE_"),
    StackRule("azure", _DEPS, r"(?i)azure-functions|azure-storage|azure-cosmos|azure-identity|azure-mgmt"),
    StackRule("azure", r"^package\.json$", r'"@azure/'),
    StackRule("azure", r"\.csproj$", r"(?i)Microsoft\.Azure\.|Azure\.Functions|Azure\.Storage|Azure\.Cosmos"),
    StackRule(
        "azure",
        r"\.(?:py|cs|ts|js)$",
        r"""from azure\.|require\s*\(\s*['"]@azure\/|using\s+Azure\.|Microsoft\.Azure\.|Azure\.\w+""",
    ),
    StackRule("airflow", r"^airflow\.cfg$|^dags/[^/]+\.py$"),
    StackRule("airflow", _PY, r"from airflow|import airflow"),
    StackRule("dbt", r"^(?:dbt_project\.yml|profiles\.yml|models/[^/]+\.sql)$"),
    StackRule("docker", r"^(?:[^/]+/)?(?:Dockerfile[^/]*|[^/]*(?i:\.dockerfile))$"),
    StackRule("docker", r"^(?:docker-compose\.ya?ml|compose\.ya?ml|\.dockerignore)$"),
    StackRule("kubernetes", r"^(?:kustomization\.ya?ml|Chart\.yaml|skaffold\.yaml)$"),
    StackRule("kubernetes", r"\.ya?ml$", r"^(?=[\s\S]*apiVersion:\s*\S+)(?=[\s\S]*kind:\s*\S+)"),
    StackRule("terraform", r"^(?:\.terraform(?:/.*)?|terragrunt\.hcl)$|\.tf$|\.tfvars$"),
    StackRule("fastapi", r"^(?:requirements(?:-dev|-test)?\.txt|pyproject\.toml|Pipfile)$", r"(?i)\bfastapi\b"),
    StackRule("fastapi", r"^(?:main|app|application)\.py$", r"from\s+fastapi\s+import|import\s+fastapi"),
    StackRule("django", r"^manage\.py$"),
    StackRule("django", r"^(?:requirements\.txt|pyproject\.toml|setup\.py|Pipfile)$", r"(?i)\bdjango\b"),
    StackRule("django", r"(?:^|/)settings\.py$", r"(?i)INSTALLED_APPS"),
    StackRule("pytest", r"^(?:pytest\.ini|conftest\.py)$"),
    StackRule("pytest", r"^pyproject\.toml$", r"(?i)\[tool\.pytest"),
    StackRule("pytest", r"^setup\.cfg$", r"(?i)\[tool:pytest\]"),
    StackRule("pytest", r"^tox\.ini$", r"(?i)\[pytest\]"),
    StackRule(
        "pytorch",
        r"^(?:requirements\.txt|pyproject\.toml|Pipfile|setup\.py)$",
        r"(?i)\btorch\b|\bpytorch\b|\btorchvision\b|\btorchaudio\b",
    ),
    StackRule("pytorch", _PY, r"import torch|from torch|import torchvision|import torchaudio"),
    StackRule("jupyter", r"(?i)\.ipynb$|^jupyter_notebook_config\.py$|^\.jupyter(?:/.*)?$"),
    StackRule("git", r"^\.git(?:/.*)?$"),
    StackRule("security", r""),
]


def meets(rule: StackRule) -> Column:
    """Whether a file shows the stack of a rule."""
    test = F.rlike("path", F.lit(rule.path)) if rule.path else F.lit(True)
    return test & F.rlike("content", F.lit(ascii_boundary(rule.content))) if rule.content else test


def detect_stacks(files: DataFrame, rules: list[StackRule] = STACK_RULES) -> DataFrame:
    """Distinct (ws, stack) of the workspaces in ``files``: ws, path, content.

    One boolean per stack is aggregated map-side, so the shuffle carries a
    handful of bits per workspace and task, whatever the size of a workspace.
    """
    tests: dict[str, Column] = {}
    for rule in rules:
        tests[rule.stack] = tests[rule.stack] | meets(rule) if rule.stack in tests else meets(rule)
    seen = files.groupBy("ws").agg(*[F.bool_or(t).alias(s) for s, t in tests.items()])
    present = F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in tests]))
    return seen.select("ws", F.explode(present).alias("stack"))
