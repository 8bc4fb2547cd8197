"""Tables whose files are named by a manifest: a new state of the table appears at once or not at all."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generation(NamedTuple):
    """One state of a table: its number, its files, and how far the input that it holds reaches."""

    number: int
    files: list[str]
    mark: int


NOTHING = Generation(0, [], -1)


def current_generation(spark: SparkSession, root: str) -> Generation:
    """The newest published state; ``NOTHING`` before the first. One number per state and file is read."""
    try:
        listed = spark.read.schema("file string, mark long, generation int").parquet(f"{root}/manifest")
    except AnalysisException:
        return NOTHING
    newest = listed.agg(F.max("generation")).first()[0]
    if newest is None:
        return NOTHING
    rows = listed.where(F.col("generation") == newest).collect()
    return Generation(newest, sorted(r["file"] for r in rows if r["file"] is not None), rows[0]["mark"])


def publish(spark: SparkSession, root: str, files: list[str], after: Generation, mark: int = -1) -> Generation:
    """Make ``files`` the state that follows ``after``.

    The manifest of a state is one file, which the commit of its write moves into place; until then readers see the state
    before. A write that was cut off leaves nothing that is read, and is replaced by the next one. One writer at a time.
    """
    made = Generation(after.number + 1, sorted(files), mark)
    rows = [(f, mark) for f in made.files] or [(None, mark)]
    listed = spark.createDataFrame(rows, "file string, mark long").coalesce(1)
    listed.write.mode("overwrite").parquet(f"{root}/manifest/generation={made.number}")
    return made


def write_files(df: DataFrame, root: str) -> list[str]:
    """Write rows to a new folder of the table and name its files; nothing reads them until they are published."""
    spark, path = df.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return [f for f in spark.read.schema(df.schema).parquet(path).inputFiles()]


def read_generation(spark: SparkSession, generation: Generation, schema) -> DataFrame:
    if not generation.files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*generation.files)


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_path(spark: SparkSession, path: str) -> None:
    files, place = _filesystem(spark, path)
    files.delete(place, True)


def move_path(spark: SparkSession, path: str, target: str) -> None:
    files, place = _filesystem(spark, path)
    if not files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {path} to {target}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path."""
    files, place = _filesystem(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()) if files.exists(place) else []


def drop_unlisted(spark: SparkSession, root: str) -> list[str]:
    """Delete data folders without a file of the current state, and older manifests; the names of the deleted folders.

    Not while another writer is at work, or a reader of an older state.
    """
    now = current_generation(spark, root)
    gone = [f for f in folders(spark, f"{root}/data") if not any(f"/data/{f}/" in file for file in now.files)]
    for f in gone:
        delete_path(spark, f"{root}/data/{f}")
    for g in folders(spark, f"{root}/manifest"):
        if int(g.removeprefix("generation=")) < now.number:
            delete_path(spark, f"{root}/manifest/{g}")
    return gone
