"""Hooks for the extraction packs: the facts of a corpus as text lines.

``register_default_hooks`` adds them to the registry. All take files as
(ws, path, content). Each says which files it wants: all that its pack can take
a fact from, by the path and literals that any such text holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.paths import base_name
from winnow.functions.text import holds_any
from winnow.operators.aggregate import findings_summary, group_names
from winnow.operators.hooks import Hook, register_hook
from winnow.operators.packs import cloud, containers, data, infra, ml, repo, stacks, testing, web
from winnow.operators.rules import SCAN_RULES
from winnow.operators.scan import explode_lines, security_scan


def _text(*parts: str | Column) -> Column:
    """Concatenate literal texts and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _list(name: str, n: int | None = None) -> Column:
    return F.array_join(F.slice(name, 1, n) if n else F.col(name), ", ")


c = F.col

#: Saved output of the status and log commands, as files of a workspace.
STATUS_FILE, LOG_FILE = "git-status.txt", "git-log.txt"


def _output(files: DataFrame, name: str) -> DataFrame:
    """The lines of saved command output."""
    return explode_lines(files.filter(base_name("path") == name).select("ws", "content"))


def _flags(files: DataFrame) -> DataFrame:
    """The services of each workspace whose flag is set."""
    found = cloud.gcp_services(files)
    names = [n for n in found.columns if n != "ws"]
    set_ones = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return found.select("ws", F.array_join(set_ones, ", ").alias("services")).filter("services <> ''")


def _path(pattern: str, *literals: str) -> Callable[[], Column]:
    """Files whose path matches and whose content holds one of the literals, if any are given."""

    def wants() -> Column:
        test = F.rlike("path", F.lit(pattern))
        return test & holds_any("content", literals) if literals else test

    return wants


def _named(*names: str) -> Callable[[], Column]:
    """Files by their own name."""
    return lambda: base_name("path").isin(*names)


def _holds(pattern: str, patterns: Iterable[str]) -> Callable[[], Column]:
    """Files whose path matches and whose content matches one of the patterns."""
    return lambda: F.rlike("path", F.lit(pattern)) & _any(F.rlike("content", F.lit(p)) for p in patterns)


def _any(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests)


def _triggers() -> Column:
    return F.rlike("path", F.lit(r"function\.json$|\.(?:py|cs)$")) & holds_any(F.lower("content"), ["trigger", "@app."])


def _gcp() -> Column:
    marked = _any(F.rlike("path", F.lit(p)) for p in [*cloud.GCP_MARKERS.values(), cloud.GCP_TERRAFORM[0]])
    return marked | _holds(cloud.SOURCE_PATH, cloud.GCP_FLAGS.values())()


def _any_stack() -> Column:
    """Files that show a stack; the rule that every file meets shows it in every workspace."""
    return _any(stacks.meets(r) for r in stacks.STACK_RULES if r.path or r.content)


def _spark_markers() -> Column:
    return F.split("path", "/")[0].isin(*[n for names, _ in cloud.SPARK_KINDS for n in names])


def _scanned() -> Column:
    return holds_any("content", sorted({n for r in SCAN_RULES for n in r.needs}))


# The keys and the wording of the lines.
DEFAULT_HOOKS = [
    Hook(
        "k8s.manifests",
        containers.k8s_manifests,
        lambda: _text("- ", c("kind"), "/", c("name"), " (ns: ", c("namespace"), ") — ", c("path")),
        _path(containers.YAML_PATH, "apiVersion:"),
    ),
    Hook(
        "k8s.namespaces",
        containers.k8s_namespaces,
        lambda: _text("- ", c("namespace")),
        _path(containers.YAML_PATH, "apiVersion:"),
    ),
    Hook(
        "k8s.helm",
        containers.helm_chart,
        lambda: _text("- ", c("name"), " v", c("version"), ": ", _list("value_keys")),
        _named("Chart.yaml", "values.yaml"),
    ),
    Hook(
        "docker.stages",
        containers.dockerfile_stages,
        lambda: _text("- `", c("path"), "`: ", c("name"), " (FROM ", c("base"), ")"),
        _path(containers.DOCKERFILE_PATH),
    ),
    Hook(
        "docker.compose",
        containers.compose_service_names,
        lambda: _text("- `", c("path"), "`: ", c("name")),
        lambda: F.col("path").isin(*containers.COMPOSE_NAMES),
    ),
    Hook(
        "terraform.providers",
        infra.tf_providers,
        lambda: _text("- ", c("provider")),
        _path(infra.TF_PATH, "provider"),
    ),
    Hook(
        "terraform.resources",
        infra.tf_resources,
        lambda: _text("- ", c("type"), ".", c("name")),
        _path(infra.TF_PATH, "resource"),
    ),
    Hook(
        "terraform.variables",
        infra.tf_variables,
        lambda: _text("- ", c("name")),
        _path(infra.TF_PATH, "variable"),
    ),
    Hook(
        "aws.resources",
        infra.cfn_resources,
        lambda: _text("- ", c("type")),
        _named(*infra.TEMPLATE_NAMES),
    ),
    Hook(
        "aws.services",
        cloud.aws_services,
        lambda: _text("- ", c("service")),
        _path(cloud.SOURCE_PATH, "client", "resource", "AWS."),
    ),
    Hook(
        "gcp.imports",
        cloud.gcp_imports,
        lambda: _text("- ", c("import")),
        _path(cloud.SOURCE_PATH, "google.cloud", "@google-cloud/"),
    ),
    Hook(
        "azure.services",
        cloud.azure_services,
        lambda: _text("- ", c("service")),
        _holds(cloud.AZURE_SOURCE, cloud.AZURE_SERVICES.values()),
    ),
    Hook(
        "azure.triggers",
        cloud.azure_triggers,
        lambda: _text("- ", c("trigger")),
        _triggers,
    ),
    Hook(
        "spark.features",
        cloud.spark_features,
        lambda: _text("- ", c("kind")),
        _spark_markers,
        every_workspace=True,
    ),
    Hook(
        "dbt.project",
        data.dbt_project,
        lambda: _text("- ", c("name"), " v", c("version")),
        _named("dbt_project.yml"),
    ),
    Hook(
        "dbt.models",
        data.dbt_models,
        lambda: _text("- ", c("path"), " [", c("materialization"), "]"),
        _path(r"^models/.*\.sql$"),
    ),
    Hook(
        "dbt.sources",
        data.dbt_sources,
        lambda: _text("- source('", c("name"), "', ...) — schema: ", c("schema"), ", tables: ", c("tables")),
        _path(data.SOURCE_PATH, "sources:"),
    ),
    Hook(
        "airflow.dags",
        data.airflow_dags,
        lambda: _text(
            "- ", c("path"), " — dag_id: ", c("dag_id"),
            F.coalesce(_text(" [schedule: ", c("schedule"), "]"), F.lit("")),
        ),
        _path(r"(?:^|/)dags/.*\.py$"),
    ),
    Hook(
        "airflow.operators",
        data.airflow_components,
        lambda: _text("- ", c("kind"), ": ", c("name")),
        _path(r"(?:^|/)plugins/.*\.py$"),
    ),
    Hook(
        "fastapi.routes",
        web.fastapi_routes,
        lambda: _text("  ", c("method"), " ", c("route"), " → ", c("function"), "() [", c("path"), "]"),
        _path(web.PY_PATH, "@app.", "@router."),
    ),
    Hook(
        "fastapi.models",
        web.pydantic_models,
        lambda: _text("- ", c("name"), " (", c("n_fields"), " fields)"),
        _path(web.PY_PATH, "BaseModel", "pydantic"),
    ),
    Hook(
        "fastapi.dependencies",
        web.dependency_names,
        lambda: _text("- ", c("name")),
        _path(web.PY_PATH, "Depends"),
    ),
    Hook(
        "django.apps",
        web.django_apps,
        lambda: _text("- ", c("app")),
        _named(*web.DJANGO_FILES),
    ),
    Hook(
        "django.models",
        web.django_models,
        lambda: _text("- ", c("app"), ": ", _list("models")),
        _path(r"^[^/]+/models\.py$", "class"),
    ),
    Hook(
        "pytest.config",
        testing.pytest_config,
        lambda: _text("Config: ", c("config_file")),
        lambda: F.col("path").isin(*testing.CONFIG_NAMES),
    ),
    Hook(
        "pytest.fixtures",
        lambda files: group_names(testing.pytest_fixtures(files), "scope", "name"),
        lambda: _text(c("scope"), " scope: ", c("names")),
        _path(r"(?:^|/)conftest\.py$", "@pytest.fixture"),
    ),
    Hook(
        "pytest.structure",
        lambda files: testing.top_test_dirs(testing.pytest_structure(files)),
        lambda: _text("- ", c("dir"), ": ", c("n_tests")),
        _path(testing.TEST_FILE),
    ),
    Hook(
        "pytorch.models",
        ml.torch_models,
        lambda: _text("- ", c("path"), ": ", _list("classes")),
        _path(ml.PY_PATH, "nn.Module"),
    ),
    Hook(
        "pytorch.names",
        ml.torch_names,
        lambda: _text("- ", c("kind"), ": ", c("name")),
        _path(ml.PY_PATH, "optim.", "nn."),
    ),
    Hook(
        "jupyter.notebooks",
        ml.notebook_stats,
        lambda: _text(
            "- `", c("path"), "`: ", c("n_cells"), " cells (", c("n_code"), " code, ", c("n_markdown"),
            " markdown) — kernel: ", c("kernel"), " (", c("language"), ")",
        ),
        _path(r"(?i)\.ipynb$"),
    ),
    Hook(
        "jupyter.kernels",
        ml.notebook_kernels,
        lambda: _text("- ", c("kernel")),
        _path(r"(?i)\.ipynb$"),
    ),
    Hook(
        "airflow.config",
        data.airflow_config,
        lambda: _text("- ", c("path"), ": ", F.coalesce("executor", F.lit("?")), ", ", F.coalesce("dag_folder", F.lit("?"))),
        _named("airflow.cfg"),
    ),
    Hook(
        "django.settings",
        web.django_settings,
        lambda: _text("- ", c("path"), ": ", _list("installed_apps")),
        _named("settings.py"),
    ),
    Hook(
        "git.status",
        lambda files: repo.git_status_counts(_output(files, STATUS_FILE), ["ws"]),
        lambda: _text("- modified: ", c("n_modified"), ", staged: ", c("n_staged"), ", untracked: ", c("n_untracked")),
        _named(STATUS_FILE),
    ),
    Hook(
        "git.recentCommits",
        lambda files: _output(files, LOG_FILE).filter((F.col("line_no") < 5) & (F.btrim("line") != "")),
        lambda: _text("- ", c("line")),
        _named(LOG_FILE),
    ),
    Hook(
        "security.findings",
        lambda files: findings_summary(security_scan(files.select("path", "content"))),
        lambda: _text("- ", F.coalesce("category", F.lit("all")), ": ", c("total")),
        _scanned,
    ),
    Hook(
        "gcp.services",
        _flags,
        lambda: _text("- ", c("services")),
        _gcp,
    ),
    Hook(
        "workspace.stacks",
        stacks.detect_stacks,
        lambda: _text("- ", c("ws"), ": ", c("stack")),
        _any_stack,
        every_workspace=True,
    ),
]


def register_default_hooks() -> None:
    for hook in DEFAULT_HOOKS:
        register_hook(*hook)
