"""pytest configuration, fixtures and test structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.paths import dir_name
from winnow.functions.text import all_groups, trim_space
from winnow.operators.packs import extract, first_existing, matching, or_default

# Patterns and names.
CONFIG_NAMES = ["pytest.ini", "pyproject.toml", "setup.cfg", "tox.ini"]
REQUIREMENT_NAMES = ["requirements.txt", "requirements-dev.txt", "pyproject.toml"]
MARKERS = r"(?s)markers\s*=\s*([^\[]*?)(?=\n\[|\n\w|\s*$)"
PLUGIN = r"pytest-[\w-]+"
TEST_PATHS = r"testpaths\s*=\s*(.+)"
FIXTURE = r"@pytest\.fixture(?:\(([^)]*)\))?\s*\ndef\s+(\w+)\s*\("
SCOPE = r"""scope\s*=\s*['"](\w+)['"]"""
TEST_FILE = r"(?:^|/)(?:test_[^/]+|[^/]+_test)\.py$"
TEST_DEF = r"(?m)^def test_"
MAX_DIRS = 10


def pytest_config(files: DataFrame) -> DataFrame:
    """Per workspace: first existing config file, markers and test paths. ``files``: ws, path, content."""
    chosen = first_existing(files, CONFIG_NAMES)
    lines = F.split(F.regexp_extract("content", MARKERS, 1), "\n")
    # name before the first colon, then before the first blank
    names = F.transform(
        lines, lambda m: F.split(trim_space(F.split(trim_space(m), ":")[0]), " ")[0]
    )
    markers = F.filter(names, lambda m: F.rlike(m, F.lit(r"^\w+$")))
    paths = F.split(F.regexp_extract("content", TEST_PATHS, 1), r"[\s,]+")
    return chosen.select(
        "ws",
        F.col("path").alias("config_file"),
        markers.alias("markers"),
        F.filter(paths, lambda p: p != "").alias("test_paths"),
    )


def pytest_plugins(files: DataFrame) -> DataFrame:
    """Per workspace, the distinct plugins named in requirement files."""
    found = files.filter(F.col("path").isin(*REQUIREMENT_NAMES)).select(
        "ws", F.explode(all_groups("content", PLUGIN, 0)).alias("plugin")
    )
    return found.distinct()


def pytest_fixtures(files: DataFrame) -> DataFrame:
    """Fixtures of ``conftest.py`` files; the last definition's scope wins."""
    found = extract(matching(files, r"(?:^|/)conftest\.py$", "@pytest.fixture"), FIXTURE, {"args": 1, "name": 2})
    scope = or_default(F.regexp_extract("args", SCOPE, 1), "function")
    return found.groupBy("name").agg(F.max_by(scope, F.struct("path", "pos")).alias("scope"))


def pytest_structure(files: DataFrame) -> DataFrame:
    """Tests and test files per directory."""
    tests = matching(files, TEST_FILE).select(
        dir_name("path").alias("dir"), F.regexp_count("content", F.lit(TEST_DEF)).alias("n")
    )
    return tests.groupBy("dir").agg(F.sum("n").alias("n_tests"), F.count("*").alias("n_files"))


def top_test_dirs(structure: DataFrame, limit: int = MAX_DIRS) -> DataFrame:
    """The directories with most tests."""
    return structure.orderBy(F.desc("n_tests"), "dir").limit(limit)


def structure_totals(structure: DataFrame) -> DataFrame:
    return structure.agg(
        F.coalesce(F.sum("n_tests"), F.lit(0)).alias("n_tests"),
        F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"),
    )


