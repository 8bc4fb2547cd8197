"""Object listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: bytes per MB.
MB = 1024 * 1024


def list_objects(objects: DataFrame, prefix: str = "") -> DataFrame:
    """One level of a key listing: child folders, then files, each by name.

    ``objects``: key, size. A folder is the text up to the first slash after
    the prefix. Every key adds to one count and one sum per child, so a folder
    that holds most keys is reduced before the shuffle.
    """
    below = objects.filter(F.startswith("key", F.lit(prefix)) & (F.col("key") != prefix))
    rest = F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key"))
    is_dir = F.contains(rest, F.lit("/"))
    child = F.when(is_dir, F.substring_index(rest, "/", 1)).otherwise(rest)
    listed = below.groupBy(is_dir.alias("is_dir"), child.alias("name")).agg(
        F.count("*").alias("n_objects"), F.sum("size").alias("n_bytes")
    )
    return listed.withColumn("size_mb", F.round(F.col("n_bytes") / MB, 2)).orderBy(
        F.desc("is_dir"), "name"
    )
