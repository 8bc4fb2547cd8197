"""Loads that rewrite only the files they touch, swapped in by a manifest."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.load import changed_open_rows, merge_upsert, scd2_snapshot
from winnow.sources.generations import Generation, current_generation, publish, read_generation, write_files

FILE = "_file"


class Load(NamedTuple):
    """What a load did: the new state, the files it read whole and replaced, and those it left as they were."""

    generation: Generation
    rewritten: list[str]
    kept: list[str]


def create_table(df: DataFrame, root: str) -> Generation:
    """A table of the rows of ``df``; one that is there already is replaced by them."""
    spark = df.sparkSession
    return publish(spark, root, write_files(df, root), current_generation(spark, root))


def read_table(spark: SparkSession, root: str, schema) -> DataFrame:
    """The current rows of a table."""
    return read_generation(spark, current_generation(spark, root), schema)


def _with_file(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias(FILE))


def _touched(now: Generation, rows: DataFrame) -> list[str]:
    """The files of a state that some rows come from; as many as it has at most, which the driver lists for any read."""
    names = {_plain(f): f for f in now.files}
    found = {_plain(r[0]) for r in rows.select(FILE).distinct().collect()}
    if found - names.keys():
        raise ValueError(f"files that the table does not name: {sorted(found - names.keys())[:3]}")
    return sorted(names[f] for f in found)


def _plain(file: str) -> str:
    """A file's name as it is compared: readers give ``file:/a`` and ``file:///a`` alike."""
    scheme, colon, path = file.partition(":")
    return f"{scheme}:{path.lstrip('/')}" if colon else file


def _replace(spark: SparkSession, root: str, now: Generation, touched: list[str], rows: DataFrame) -> Load:
    kept = [f for f in now.files if f not in set(touched)]
    return Load(publish(spark, root, [*kept, *write_files(rows, root)], now), touched, kept)


def merge_into(spark: SparkSession, root: str, source: DataFrame, keys: list[str]) -> Load:
    """``merge_upsert`` into a table of files, of which only those that hold a key of the source are rewritten.

    A first pass reads the keys alone and finds these files; their other rows are written anew beside the source rows.
    Keys without a row come in new files. Files without such a key stay in the table as they are. If the load is cut off,
    the table is as before. Rows with a null key match nothing and are inserted.
    """
    now = current_generation(spark, root)
    target = read_generation(spark, now, source.schema)
    touched = _touched(now, _with_file(target).join(source.select(*keys).distinct(), keys, "left_semi")) if now.files else []
    part = read_generation(spark, now._replace(files=touched), source.schema)
    return _replace(spark, root, now, touched, merge_upsert(part, source, keys))


def snapshot_into(
    spark: SparkSession, root: str, current: DataFrame, schema, key: str, updated_at: str, check_columns: list[str] | None = None
) -> Load:
    """``scd2_snapshot`` into a table of files: only files with an open row that changes are rewritten.

    ``schema`` is that of the history. Open rows are compared with the snapshot by key; rows of keys that neither change nor are new
    are not written again, wherever they lie.
    """
    now = current_generation(spark, root)
    history = read_generation(spark, now, schema)
    placed = _with_file(history) if now.files else history.withColumn(FILE, F.lit(None).cast("string"))
    compared = changed_open_rows(placed, current, key, updated_at, check_columns, FILE)
    touched = _touched(now, compared.where("changed")) if now.files else []
    same = compared.where("NOT changed").select(key).distinct()
    part = read_generation(spark, now._replace(files=touched), schema)
    moved = current.join(same, key, "left_anti").select(*current.columns)
    return _replace(spark, root, now, touched, scd2_snapshot(part, moved, key, updated_at, check_columns))
