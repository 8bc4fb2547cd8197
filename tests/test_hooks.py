from collections import Counter

import pytest
from pyspark.sql import functions as F

from winnow.operators import hooks
from winnow.operators.packs.default_hooks import DEFAULT_HOOKS
from winnow.plans.views import view

FOLDER = "/root/testdata/sf0.001"


def lines(df):
    return Counter(map(tuple, df.select("key", "line").collect()))


@pytest.fixture(scope="module")
def files(spark):
    return view(spark, FOLDER, "hook_files")


def test_routed_lines_are_those_of_a_scan_for_each_hook(spark, files):
    assert len(DEFAULT_HOOKS) == 38 and all(h.wants for h in DEFAULT_HOOKS)
    routed = hooks.routed_hook_lines(files, DEFAULT_HOOKS)
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") <= plan.count("ReadSchema: struct<o_orderkey:bigint>")  # the corpus: workspaces alone
    got = lines(routed)
    assert got == lines(hooks.hook_lines(files, DEFAULT_HOOKS))
    assert {key for key, _ in got} == {h.key for h in DEFAULT_HOOKS}


def test_no_hook_misses_a_file(spark, files):
    """Each hook gets its own lines out of the files that no hook wants: none."""
    wanted = [F.coalesce(h.wants(), F.lit(False)) for h in DEFAULT_HOOKS]
    for hook, wants in zip(DEFAULT_HOOKS, wanted):
        if not hook.every_workspace and hook.key != "security.findings":  # these have lines without a file
            assert hook.collect(files.where(~wants)).count() == 0, hook.key


def test_a_broken_hook_is_skipped_and_one_without_a_wish_reads_all(spark, files):
    chosen = [
        hooks.Hook("all", lambda f: f.groupBy().count(), lambda: F.col("count").cast("string")),
        hooks.Hook("broken", lambda f: f, lambda: F.col("no_such_column")),
        hooks.Hook("broken wish", lambda f: f, lambda: F.col("path"), lambda: F.col("nothing") == 1),
        hooks.Hook("main", lambda f: f, lambda: F.col("content"), lambda: F.col("path") == "main.py"),
        hooks.Hook("none", lambda f: f, lambda: F.col("content"), lambda: F.col("path") == "nowhere"),
        hooks.Hook("each", lambda f: f.select("ws").distinct(), lambda: F.col("ws").cast("string"), lambda: F.lit(None).cast("boolean"), True),
    ]
    got = lines(hooks.routed_hook_lines(files, chosen))
    assert sum(n for (k, _), n in got.items() if k == "main") == files.where("path = 'main.py'").count()
    assert got["all", str(files.count())] == 1
    assert sum(n for (k, _), n in got.items() if k == "each") == files.select("ws").distinct().count()
    assert {k for k, _ in got} == {"all", "main", "each"}
    with pytest.raises(ValueError):
        hooks.routed_hook_lines(files, chosen[1:3])
