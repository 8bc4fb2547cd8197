"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from winnow.sources.scratch import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``a, b`` edges (long), where root is the smallest node of the component.

    Each round links every node's larger neighbours to its smallest neighbour and then every node's
    smaller neighbours to the smallest of them, until nothing changes. Only minima are aggregated, so
    a node with any number of edges is never gathered. Every round is written to shared storage.
    Null ends and loops are left out; an empty table gives an empty result.
    """
    now = cut_lineage(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .distinct(),
        "edges",
    )
    state = _state(now)
    while True:
        now = cut_lineage(_small(_large(now)), "edges")
        after = _state(now)
        if after == state:
            return now.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(
                now.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
            )
        state = after


def _state(stars: DataFrame) -> tuple:
    """Changes whenever the set of edges does."""
    return tuple(
        stars.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    )


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node, linked to the smallest of the node and its neighbours."""
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
        edges.select(F.col("m").alias("u"), F.col("v").alias("w"))
    )
    low = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("w > u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, linked to the smallest of them."""
    low = edges.groupBy("v").agg(F.min("m").alias("low"))
    others = edges.join(low, "v").where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
    return others.unionByName(low.select("v", F.col("low").alias("m"))).distinct()
