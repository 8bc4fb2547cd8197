"""Working folders on storage that every executor can reach."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine, one
    per process and removed when it ends; on a cluster the setting is required,
    since executors share no local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _own_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="winnow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused path for one run."""
    return f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df, purpose: str):
    """Write a result to shared storage and read it back, so a lost executor cannot lose it."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.parquet(path)
