"""Ordered per-key computations that stay safe when one key holds most rows.

A plain window partitioned by key puts all rows of the key in one task. Here
every key is cut into blocks of its order (a time bucket, a range of sequence
numbers). Blocks are aggregated map-side, the short list of block totals is
scanned per key, and the rows are only windowed inside their own block.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.sources.scratch import cut_lineage

# A block is one struct column (key columns, then block). A struct is never null itself,
# so joining on it also matches rows whose key or order is null: no row is lost.
BLOCK = "_block"


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    block: Column,
    descending: bool = False,
    only_blocks: Column | None = None,
) -> DataFrame:
    """Inclusive running sum of each value per key in ``order``; null values count 0.

    ``block`` must never decrease along ``order``. With ``descending`` the sums
    run from the newest row back. ``only_blocks`` is a condition on the sums
    reached before a block, named ``before_<name>``; blocks that fail it are
    dropped before their rows are sorted.
    """
    direction = F.desc if descending else F.asc
    values = {n: F.coalesce(v, F.lit(0)) for n, v in values.items()}
    blocked = df.withColumn(BLOCK, F.struct(*keys, block.alias("_b")))
    key_fields = [F.col(f"{BLOCK}.{k}") for k in keys]
    earlier = (
        W.partitionBy(*key_fields)
        .orderBy(direction(f"{BLOCK}._b"))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    totals = blocked.groupBy(BLOCK).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    before = totals.select(
        BLOCK, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in values]
    )
    if only_blocks is not None:
        before = before.filter(only_blocks)
    inside = (
        W.partitionBy(BLOCK)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    sums = {n: F.sum(v).over(inside) + F.col(f"before_{n}") for n, v in values.items()}
    return (
        blocked.join(before, BLOCK)
        .withColumns(sums)
        .drop(BLOCK, *[f"before_{n}" for n in values])
    )


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, block: Column, out: str
) -> DataFrame:
    """Value of the previous row of the key in ``order``; null for the first row."""
    blocked = df.withColumn(BLOCK, F.struct(*keys, block.alias("_b")))
    key_fields = [F.col(f"{BLOCK}.{k}") for k in keys]
    # the value is wrapped, so that a null value is carried like any other
    last = blocked.groupBy(BLOCK).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")
    )
    carried = last.select(
        BLOCK, F.lag("_last").over(W.partitionBy(*key_fields).orderBy(f"{BLOCK}._b"))["v"].alias("_carried")
    )
    inside = W.partitionBy(BLOCK).orderBy(*order)
    return (
        blocked.join(carried, BLOCK)
        .withColumn("_rn", F.row_number().over(inside))
        .withColumn(
            out, F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.lag(value).over(inside))
        )
        .drop("_rn", "_carried", BLOCK)
    )


#: Spark trims the rows of a key before the shuffle only up to this rank.
GROUP_LIMIT = 1000
SALTS = 64


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark trims each map task to ``n`` rows per key before the shuffle.

    Beyond its limit the rows of a key are first cut to ``n`` in each of some
    parts, so that no task sorts all rows of a hot key.
    """
    if n > GROUP_LIMIT:
        part = W.partitionBy(*keys, "_part").orderBy(*order)
        parts = df.withColumn("_part", F.spark_partition_id() % SALTS)
        df = parts.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= n).drop("_part", "_n")
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


BROADCAST_ROWS = 10_000


def broadcast_rows(df: DataFrame, at_most: int) -> DataFrame:
    """Broadcast a frame of keys known to have few rows; leave larger ones to Spark."""
    return F.broadcast(df) if at_most <= BROADCAST_ROWS else df


def numbered(df: DataFrame, order: list[str], name: str, descending: tuple[str, ...] = ()) -> DataFrame:
    """All rows with their place, from 1, in the order of some columns, without sorting them in one task.

    Rows are dealt by ranges of the order and written once, so that ranges stay as they are; rows are numbered inside
    their range, behind the rows of the ranges before. The list of ranges is as long as there are partitions.
    """
    sorts = [F.desc(c) if c in descending else F.asc(c) for c in order]
    ranged = cut_lineage(df.repartitionByRange(*sorts).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*sorts)) + F.col("_before")
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, place).select(*df.columns, name)


#: More than any two ids are apart: a time and an id make one number in the order of both.
_IDS = Decimal(2 * 10**19)
_BEFORE = Decimal(-(10**37))


def order_number(df: DataFrame, ts: str, row_id: str) -> Column:
    """One exact number in the order of a time or number and then an id; fixed width, so maxima combine in hash tables."""
    kind, at = df.schema[ts].dataType, F.col(ts)
    if isinstance(kind, T.TimestampType):
        at = F.unix_micros(at)
    elif isinstance(kind, T.TimestampNTZType):  # by its own clock, whatever the zone of the session
        clock = (F.hour(at) * 60 + F.minute(at)).cast("long") * 60_000_000
        at = F.unix_date(F.to_date(at)).cast("long") * 86_400_000_000 + clock + F.floor(F.extract(F.lit("SECOND"), at) * 1_000_000)
    elif isinstance(kind, T.DateType):
        at = F.unix_date(at)
    return at.cast("decimal(18,0)") * F.lit(_IDS) + F.col(row_id).cast("decimal(20,0)")


def newest_rows(df: DataFrame, key: str, ts: str, row_id: str, value: str) -> DataFrame:
    """``key``, ``value`` of the newest row of each key by time, then id, and ``n``, the rows of the key.

    Places are aggregated in hash tables, without the value; then the few rows that have them are looked up. Nothing is
    sorted and no value moves but those that are returned. Rows without a time are older than all others.
    """
    place = F.coalesce(order_number(df, ts, row_id), F.lit(_BEFORE))
    # the key as a struct, which is never null itself, and a column: rows without a key are a key of their own
    placed = df.select(F.col(key), F.col(value), place.alias("_place"))
    best = placed.groupBy(key).agg(F.max("_place").alias("_best"), F.count("*").alias("n"))
    own = [F.col(f"r.{key}").eqNullSafe(F.col(f"b.{key}")), F.col("r._place") == F.col("b._best")]
    found = placed.alias("r").join(best.alias("b"), own[0] & own[1])
    # two rows of one place: one of them
    return found.groupBy(f"b.{key}").agg(F.max(f"r.{value}").alias(value), F.first("b.n").alias("n"))
