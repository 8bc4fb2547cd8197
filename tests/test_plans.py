"""Every registered query agrees with its SQL, and no plan holds an operator that cannot scale."""

import pytest

import __spark_entry__ as entry
from tests.parity import compare, connect
from winnow.operators import scan
from winnow.operators.generated import generated_files, safe_paths
from winnow.operators.packs import containers, data, infra, ml, repo, web
from winnow.plans.registry import load_all

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = q.build(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python
    if q.sql:
        assert compare(con, df, q.sql) == []
    else:
        df.count()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.total for r in rows if r.category is None) >= 10


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(spark, name):
    return QUERIES[name].build(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, expected",
    [
        ("lookup_by_key", "EqualTo(l_orderkey,77)"),
        ("last_messages", "WindowGroupLimit"),
        ("first_event_per_user", "WindowGroupLimit"),
        ("recent_failures", "TakeOrderedAndProject"),
        ("log_filter", "TakeOrderedAndProject"),
        ("findings_summary", "partial_count"),
        ("last_messages", "ReadSchema: struct<conv_id:bigint,turn:bigint>"),
        ("appended_events", "GreaterThan(ts,"),
    ],
)
def test_plan_holds(spark, name, expected):
    assert expected in plan_of(spark, name)


NARROW = {
    "security_scan": scan.security_scan,
    "index_functions": lambda f: scan.index_functions(scan.with_language(f)),
    "tag_lines": lambda f: scan.tag_lines(scan.with_language(f)),
    "generated_files": lambda f: generated_files(f, "out", ["path"], "content"),
    "k8s_manifests": containers.k8s_manifests,
    "dockerfile_stages": containers.dockerfile_stages,
    "compose_services": containers.compose_services,
    "tf_variables": infra.tf_variables,
    "dbt_project": data.dbt_project,
    "dbt_sources": data.dbt_sources,
    "airflow_dags": data.airflow_dags,
    "fastapi_routes": web.fastapi_routes,
    "fastapi_dependencies": web.fastapi_dependencies,
    "django_settings": web.django_settings,
    "torch_training": ml.torch_training,
    "notebook_stats": ml.notebook_stats,
    "clean_outputs": ml.clean_outputs,
    "blame_fields": repo.blame_fields,
    "safe_paths": lambda f: safe_paths(f, "base"),
}


@pytest.fixture(scope="module")
def stored_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "files")
    rows = [("a.py", "x = 1"), ("b.tf", 'resource "a" "b" {}')]
    spark.createDataFrame(rows, "path string, content string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", list(NARROW))
def test_scans_and_packs_never_shuffle(stored_files, name):
    plan = NARROW[name](stored_files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "FileScan" in plan
