"""Results depend on the rows only, not on their order or partitioning."""

import pytest
from pyspark.sql import functions as F

from winnow.operators import aggregate, joins, load, quality, select
from winnow.operators.packs import containers, documents, infra, ml, repo, stacks, testing, web
from winnow.plans.registry import Source
from winnow.streaming import events as ev

FOLDER = "/root/testdata/sf0.001"

CASES = {
    "window_messages": ("conversations", lambda d: select.window_messages(d, 800)),
    "last_n": ("conversations", lambda d: select.last_n(d, 2)),
    "allocate_budget": ("context_parts", lambda d: select.allocate_budget(d, 500)),
    "errors_by_function": ("error_logs", aggregate.errors_by_function),
    "recent_failures": ("runs", select.recent_failures),
    "first_wins": ("events", lambda d: joins.first_wins(d, "user_id", [F.col("ts"), F.col("event_id")])),
    "siblings": ("files", joins.siblings),
    "related_files": ("code_files", joins.related_files),
    "distinct_ordered": ("part", lambda d: joins.distinct_ordered(d, "p_name", ["p_partkey"])),
    "changelog": ("commits", load.changelog_groups),
    "quantiles": ("lineitem", lambda d: quality.exact_quantiles(d, "l_extendedprice", [0.1, 0.5, 0.99])),
    "duplicates": ("orders", lambda d: quality.duplicate_failures(d, ["o_custkey"])),
    "k8s": ("k8s_files", containers.k8s_manifests),
    "compose_names": ("compose_files", containers.compose_service_names),
    "providers": ("tf_files", infra.tf_providers),
    "fixtures": ("conftests", testing.pytest_fixtures),
    "pytest_config": ("pytest_files", testing.pytest_config),
    "top_dirs": ("test_files", lambda d: testing.top_test_dirs(testing.pytest_structure(d))),
    "pydantic": ("api_files", web.pydantic_models),
    "torch_names": ("torch_files", ml.torch_names),
    "stacks": ("ws_files", stacks.detect_stacks),
    "field_types": ("json_docs", documents.field_types),
    "status": ("statuses", lambda d: repo.git_status_counts(d, ["repo"])),
    "activations": (
        "activations",
        lambda d: ev.activation_changes(d, "user_id", "active", ["ts", "event_id"], F.date_trunc("hour", "ts")),
    ),
    "throttle": (
        "events",
        lambda d: ev.throttle(
            d.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), ["user_id"], "t", 3600 * 10**6, busy=3
        ),
    ),
}


@pytest.mark.parametrize("name", list(CASES))
def test_order_and_partitions_do_not_matter(spark, name):
    view, operator = CASES[name]
    df = Source(spark, FOLDER)(view)
    shuffled = df.repartition(11).withColumn("_r", F.rand(5)).sortWithinPartitions("_r").drop("_r")
    plain = sorted(map(str, operator(df).collect()))
    assert plain and plain == sorted(map(str, operator(shuffled).collect()))
