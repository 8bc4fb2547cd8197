"""Notebook files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnow.operators.packs.ml import parsed_notebooks
from winnow.sources.files import scan_files


def read_notebooks(spark: SparkSession, root: str) -> DataFrame:
    """Notebooks below ``root`` as (path, nb); bad JSON gives a null struct."""
    return parsed_notebooks(scan_files(spark, root, [".ipynb"]))
