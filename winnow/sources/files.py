"""Text files as rows: one row per file (path, content)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.paths import extension
from winnow.functions.text import as_col
from winnow.operators.joins import first_wins
from winnow.operators.load import overwrite_partitions
from winnow.operators.skew import broadcast_rows

# Folders that are never read.
SKIP_DIRS = [
    "node_modules", ".git", "__pycache__", "dist", "build", ".venv", "venv", ".databricks", "out",
]
N_BUCKETS = 64


def relative_path(uri, root: str):
    """Path below ``root`` from a file URI; percent escapes are decoded."""
    decoded = F.url_decode(F.replace(as_col(uri), F.lit("+"), F.lit("%2B")))
    base = F.lit(root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/")
    return F.substring(decoded, F.instr(decoded, base) + F.length(base), F.length(decoded))


def scan_files(
    spark: SparkSession,
    root: str,
    extensions: list[str],
    skip_dirs: list[str] = SKIP_DIRS,
    max_depth: int | None = None,
) -> DataFrame:
    """Files below ``root`` with one of the extensions as (path, content).

    The listing is filtered by name before any file is opened; skipped folders
    and the depth limit, if one is given, are tested on the path.
    """
    glob = "*{" + ",".join(extensions) + "}"
    read = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    found = read.select(relative_path("_metadata.file_path", root).alias("path"), F.col("value").alias("content"))
    segments = F.split("path", "/")
    return found.filter(
        extension("path").isin(*extensions)
        & (F.size(segments) <= max_depth if max_depth is not None else F.lit(True))
        & ~F.arrays_overlap(segments, F.array(*[F.lit(d) for d in skip_dirs]))
    )


def read_files(spark: SparkSession, store: str) -> DataFrame:
    """The (path, content) rows of a file store."""
    return spark.read.parquet(store).select("path", "content")


def write_files(files: DataFrame, store: str, buckets: int = N_BUCKETS, order: str | None = None) -> None:
    """Write (path, content) rows into a file store; an existing path is replaced.

    A store holds one file per path: of rows with the same path the last in
    ``order``, a column, is kept, and the greatest content among equals.

    The store is split into buckets by path, the unit that is rewritten: choose
    their number once, so that one holds some gigabytes. Only the buckets that
    receive rows are rewritten, and dynamic overwrite swaps them in when the job
    commits. Rebalancing gives a bucket as many files as its size asks for.
    """
    spark = files.sparkSession
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    latest = ([F.desc(order)] if order else []) + [F.desc("content")]
    new = first_wins(files, "path", latest).select("path", "content", bucket.alias("bucket"))
    try:
        stored = spark.read.parquet(store)
    except AnalysisException:
        stored = None
    if stored is not None:
        touched = broadcast_rows(new.select("bucket").distinct(), buckets)
        kept = stored.join(touched, "bucket", "left_semi").join(new.select("path"), "path", "left_anti")
        new = kept.select("path", "content", "bucket").unionByName(new)
    overwrite_partitions(new, store, "bucket")
