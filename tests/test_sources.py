from types import SimpleNamespace

import tempfile

import pytest
from pyspark.sql import functions as F

from winnow.operators.packs import ml
from winnow.sources import files, generations, objects, scratch, tables
from winnow.sources.notebooks import read_notebooks

NOTEBOOK = (
    '{"cells": [{"cell_type": "markdown", "source": ["t"]},'
    ' {"cell_type": "code", "outputs": [{"x": 1}], "execution_count": 3, "source": ["a"], "extra": {"k": [1, 2]}},'
    ' {"cell_type": "code", "outputs": [], "execution_count": null}],'
    ' "metadata": {"kernelspec": {"name": "python3"}}, "nbformat": 4}'
)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "my tree+1"
    for name, body in {
        "a.py": "x = 1\n", "sub/b.ts": "let é\n", "sub/c.md": "no", "node_modules/d.py": "no",
        "l1/l2/l3/l4/e.py": "deep", "l1/l2/l3/l4/l5/f.py": "too deep", ".py": "no ext", "g.PY": "case",
        "nb/one.ipynb": NOTEBOOK, "nb/two.ipynb": "{broken",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8")
    return str(root)


def test_scan_files(spark, tree):
    got = {r.path: r.content for r in files.scan_files(spark, tree, [".py", ".ts"]).collect()}
    assert got == {"a.py": "x = 1\n", "sub/b.ts": "let é\n", "l1/l2/l3/l4/e.py": "deep", "l1/l2/l3/l4/l5/f.py": "too deep"}


def test_notebooks(spark, tree):
    found = files.scan_files(spark, tree, [".ipynb"])
    stats = {r.path: tuple(r)[1:] for r in ml.notebook_stats(found).collect()}
    assert stats == {
        "nb/one.ipynb": (3, 2, 1, "python3", "python"), "nb/two.ipynb": (0, 0, 0, "unknown", "python"),
    }
    assert read_notebooks(spark, tree).filter("nb.cells is not null").count() == 1
    assert [r.kernel for r in ml.notebook_kernels(found).collect()] == ["python3"]
    cleaned = {r.path: r.content for r in ml.clean_outputs(found).collect()}
    assert cleaned["nb/two.ipynb"] == "{broken"
    again = spark.createDataFrame([("nb/one.ipynb", cleaned["nb/one.ipynb"])], "path string, content string")
    assert tuple(ml.notebook_stats(again).first())[1:4] == (3, 2, 1)
    import json

    nb = json.loads(cleaned["nb/one.ipynb"])
    assert nb["nbformat"] == 4 and nb["cells"][1]["outputs"] == [] and nb["cells"][1]["execution_count"] is None
    assert nb["cells"][1]["extra"] == {"k": [1, 2]} and "outputs" not in nb["cells"][0]


def test_write_files_replaces_and_adds(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), "path string, content string")
    files.write_files(rows(("a", "1"), ("b", "2"), ("c", "3")), store)
    files.write_files(rows(("b", "20"), ("d", "4")), store)
    assert sorted(map(tuple, files.read_files(spark, store).collect())) == [
        ("a", "1"), ("b", "20"), ("c", "3"), ("d", "4"),
    ]


def test_list_objects(spark):
    df = spark.createDataFrame(
        [("p/", 0), ("p/x/a", 1048576), ("p/x/b/c", 524288), ("p/z.txt", 10486), ("p/a.txt", 5), ("q/n", 1)],
        "key string, size long",
    )
    got = [(r.is_dir, r.name, r.n_objects, r.size_mb) for r in objects.list_objects(df, "p/").collect()]
    assert got == [(True, "x", 2, 1.5), (False, "a.txt", 1, 0.0), (False, "z.txt", 1, 0.01)]


def test_run_sql(spark):
    got = tables.run_sql(spark, "SELECT id, repeat('x', 60) AS long, cast(null AS int) AS n FROM range(70) ORDER BY id").collect()
    assert len(got) == 50 and got[0].total_rows == 70
    assert len(got[0].long) == 50 and got[0].n == "NULL" and got[49].id == "49"


def test_query_by_key_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("s", F.lit("a")).write.parquet(path)
    df = tables.query_by_key(spark.read.parquet(path), id=3, s="a").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan and df.count() == 1


def session(folder, master):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_scratch_folder_comes_from_the_session():
    assert scratch.scratch_dir(session("hdfs://x/cp/", "yarn"), "a").startswith("hdfs://x/cp/a-")
    with pytest.raises(RuntimeError):
        scratch.scratch_dir(session(None, "yarn"), "a")
    assert scratch.scratch_dir(session(None, "local[2]"), "a").startswith(tempfile.gettempdir())


def test_cut_lineage(spark):
    assert scratch.cut_lineage(spark.range(5), "y").count() == 5


def test_schema_listing_sets_partition_keys_apart(spark):
    rows = [("t", 2, "b", "string", True, "note", False), ("t", 1, "a", "int", False, None, False), ("t", 3, "p", "date", True, None, True)]
    rows = [("c", "d", *r) for r in rows]
    got = tables.schema_listing(spark.createDataFrame(rows, tables.COLUMN_SCHEMA)).first()
    assert got.columns == "  - `a` int NOT NULL\n  - `b` string — note" and got.partition_keys == "  - `p` date"


def test_databases_with_a_table_of_the_same_name(spark):
    for database in ("levels_a", "levels_b"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{scratch.scratch_dir(spark, database)}'")
    spark.sql("CREATE OR REPLACE VIEW levels_a.same AS SELECT 1 AS x")
    spark.sql("CREATE OR REPLACE VIEW levels_b.same AS SELECT 'a' AS x, 2 AS y")
    spark.range(1).createOrReplaceTempView("levels_here")
    try:
        levels = [tuple(r) for r in tables.catalog_levels(spark).collect()]
        assert [r for r in levels if r[2] == "same"] == [
            ("spark_catalog", "levels_a", "same", False), ("spark_catalog", "levels_b", "same", False),
        ]
        assert [r for r in levels if r[2] == "levels_here"] == [(None, None, "levels_here", True)]
        columns = tables.describe_levels(spark).where("table_name IN ('same', 'levels_here')").collect()
        got = {(r.database, r.table_name, r.position, r.column_name, r.type_text) for r in columns}
        assert got == {
            ("levels_a", "same", 1, "x", "int"), ("levels_b", "same", 1, "x", "string"), ("levels_b", "same", 2, "y", "int"),
            (None, "levels_here", 1, "id", "bigint"),
        }
        blocks = tables.schema_listing(tables.describe_levels(spark)).where("table_name = 'same'").count()
        assert blocks == 2
        named = tables.describe_tables(spark, ["levels_a.same", "levels_here"]).select("catalog", "database", "table_name")
        assert {tuple(r) for r in named.collect()} == {("spark_catalog", "levels_a", "same"), (None, None, "levels_here")}
    finally:
        spark.catalog.dropTempView("levels_here")
        for database in ("levels_a", "levels_b"):
            spark.sql(f"DROP DATABASE {database} CASCADE")


def test_generations(spark):
    root = scratch.scratch_dir(spark, "generations")
    assert generations.current_generation(spark, root) == generations.NOTHING
    first = generations.publish(spark, root, generations.write_files(spark.range(3), root), generations.NOTHING, 7)
    assert generations.current_generation(spark, root) == first and first.mark == 7
    # files that are written and not published, and a manifest whose write was cut off, are not read
    left = generations.write_files(spark.range(99), root)
    spark.createDataFrame([("x",)], "a string").write.parquet(f"{root}/manifest/generation=2/_temporary/0")
    assert generations.read_generation(spark, generations.current_generation(spark, root), "id long").count() == 3
    second = generations.publish(spark, root, generations.write_files(spark.range(5), root), first)
    assert generations.current_generation(spark, root) == second
    assert len(generations.drop_unlisted(spark, root)) == 2 and left
    assert generations.folders(spark, f"{root}/manifest") == ["generation=2"]
    assert generations.read_generation(spark, second, "id long").count() == 5
    empty = generations.publish(spark, root, [], second)
    assert generations.current_generation(spark, root) == empty
    assert generations.read_generation(spark, empty, "id long").count() == 0
