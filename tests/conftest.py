from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


def make_spark() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[*]")
        .appName("winnow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    yield make_spark()
