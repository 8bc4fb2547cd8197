"""Chains of events that each open a fixed time after the one before, found by pointers that double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.sources.scratch import cut_lineage

#: Times that are merged in one window; a key has no more of them than there are microseconds in a bucket.
BUCKET_MICROS = 60_000_000

_KEY, _T, _NEXT = "_key", "_t", "_next"


def next_events(nodes: DataFrame, width: int, bucket: int = BUCKET_MICROS) -> DataFrame:
    """``_key, _t, _next``: for each event the first one of its key at or after ``_t + width``, where there is one.

    ``nodes``: distinct ``_key, _t``. Events and the times they ask for are merged in order, bucket by bucket; a
    bucket without a later event takes the first event of the next one that has any.
    """
    events = nodes.select(_KEY, F.col(_T).alias("at"), F.lit(None).cast("bigint").alias("own"))
    asked = nodes.select(_KEY, (F.col(_T) + width).alias("at"), F.col(_T).alias("own"))
    merged = events.unionByName(asked).withColumn("bucket", F.floor(F.col("at") / bucket))
    seen = F.when(F.col("own").isNull(), F.col("at"))
    # from the latest back; at the same time an event comes before what asks for it
    back = W.partitionBy(_KEY, "bucket").orderBy(F.desc("at"), F.asc_nulls_first("own")).rowsBetween(W.unboundedPreceding, 0)
    inside = merged.withColumn("found", F.last(seen, ignorenulls=True).over(back)).where("own IS NOT NULL")
    later = W.partitionBy(_KEY).orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        merged.groupBy(_KEY, "bucket")
        .agg(F.min(seen).alias("first"))
        .select(_KEY, "bucket", F.last("first", ignorenulls=True).over(later).alias("carried"))
    )
    return (
        inside.join(carried, [_KEY, "bucket"])
        .select(_KEY, F.col("own").alias(_T), F.coalesce("found", "carried").alias(_NEXT))
        .where(F.col(_NEXT).isNotNull())
    )


def _doubled(steps: DataFrame, firsts: DataFrame) -> DataFrame:
    """Two steps at once, from where a chain can be after an even number of them: a first event, or one that a step leads to."""
    starts = steps.select(_KEY, F.col(_NEXT).alias(_T)).unionByName(firsts).distinct()
    second = steps.select(_KEY, F.col(_T).alias(_NEXT), F.col(_NEXT).alias("_after"))
    return starts.join(steps, [_KEY, _T]).join(second, [_KEY, _NEXT]).select(_KEY, _T, F.col("_after").alias(_NEXT))


def chain_openings(
    events: DataFrame, keys: list[str], micros: str, width: int, bucket: int = BUCKET_MICROS
) -> DataFrame:
    """The keys and ``opened``: the first event of each key, then each first one at or after ``opened + width``.

    Every event points to the one that would follow it. Pointers are joined with themselves until none is left, each time
    only from events that a pointer leads to, which are fewer each time; then the chain of each key is read off from the
    longest pointers down. A row is a key and two times, however many events a key or a width holds, and all joins are on
    both, so a key's events lie in all tasks. Each table of pointers is written to the shared folder. Rows without a
    time open nothing; null keys are a key of their own; repeated times count once.
    """
    # the key as one struct, which is never null itself: rows with null keys join too
    nodes = events.where(F.col(micros).isNotNull()).select(F.struct(*keys).alias(_KEY), F.col(micros).cast("bigint").alias(_T))
    nodes = cut_lineage(nodes.distinct(), "chain-events")
    firsts = nodes.groupBy(_KEY).agg(F.min(_T).alias(_T))
    steps = cut_lineage(next_events(nodes, width, bucket), "chain-steps")
    tables = []
    while not steps.isEmpty():
        tables.append(steps)
        steps = cut_lineage(_doubled(steps, firsts), "chain-steps")
    opened = cut_lineage(firsts, "chain")
    for steps in reversed(tables):
        reached = opened.join(steps, [_KEY, _T]).select(_KEY, F.col(_NEXT).alias(_T))
        opened = cut_lineage(opened.unionByName(reached), "chain")
    return opened.select(f"{_KEY}.*", F.col(_T).alias("opened"))
