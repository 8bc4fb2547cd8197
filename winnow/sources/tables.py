"""Tables, SQL previews and catalog listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.labels import schema_text

# Preview limits.
PREVIEW_ROWS = 50
PREVIEW_CELL = 50

COLUMN_SCHEMA = T.StructType(
    [
        T.StructField("catalog", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("type_text", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("comment", T.StringType()),
        T.StructField("is_partition", T.BooleanType()),
    ]
)


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def preview_cell(c: Column | str, n: int = PREVIEW_CELL) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.left(F.coalesce(c.cast("string"), F.lit("NULL")), F.lit(n))


def run_sql(
    spark: SparkSession,
    sql: str,
    args: dict | None = None,
    max_rows: int = PREVIEW_ROWS,
    max_cell: int = PREVIEW_CELL,
) -> DataFrame:
    """First rows of a statement as text cells, with the full row count beside them.

    The limit reaches the statement as top-k; the count is its own aggregate.
    """
    result = spark.sql(sql, args=args) if args else spark.sql(sql)
    total = result.agg(F.count("*")).scalar()
    cells = [preview_cell(F.col(f"`{c}`"), max_cell).alias(c) for c in result.columns]
    return result.limit(max_rows).select(*cells, total.alias("total_rows"))


def _columns_of(spark: SparkSession, name: str, place: tuple[str | None, str | None, str]) -> list[tuple]:
    """One row for each column of a table or view, in order."""
    listed = spark.catalog.listColumns(name)
    return [(*place, i, c.name, c.dataType, c.nullable, c.description, c.isPartition) for i, c in enumerate(listed, start=1)]


def describe_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """Columns of the named tables or views with catalog, database, position, type and nullability.

    Only metadata is listed, so the rows are as many as there are columns. Temporary views have no catalog and database.
    """
    rows = []
    for name in names:
        table = spark.catalog.getTable(name)
        own = (None, None) if table.isTemporary else (table.catalog, ".".join(table.namespace or []) or None)
        rows += _columns_of(spark, name, (*own, table.name))
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def describe_catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Columns of every table and view of a database."""
    listed = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    names = [
        t.name if t.isTemporary or not t.namespace else ".".join([*t.namespace, t.name]) for t in listed
    ]
    return describe_tables(spark, names)


def _quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def catalog_levels(spark: SparkSession, catalogs: list[str] | None = None) -> DataFrame:
    """``catalog, database, table_name, is_temporary`` of every table and view, level by level.

    Without ``catalogs`` all that the session knows are walked. Databases of databases are named with dots; a
    temporary view, which every database lists, comes once, without catalog and database.
    """
    rows = set()
    for catalog in catalogs or [c.name for c in spark.catalog.listCatalogs()]:
        waiting = [tuple(r) for r in spark.sql(f"SHOW NAMESPACES IN {_quoted(catalog)}").collect()]
        for (database,) in waiting:
            for t in spark.sql(f"SHOW TABLES IN {_quoted(catalog, *database.split('.'))}").collect():
                own = (None, None) if t.isTemporary else (catalog, database)
                rows.add((*own, t.tableName, t.isTemporary))
    ordered = sorted(rows, key=lambda r: tuple(x or "" for x in r[:3]))
    return spark.createDataFrame(ordered, "catalog string, database string, table_name string, is_temporary boolean")


def describe_levels(spark: SparkSession, catalogs: list[str] | None = None) -> DataFrame:
    """Columns of every table and view of every database of every catalog, temporary views included."""
    rows = []
    for t in catalog_levels(spark, catalogs).collect():
        name = _quoted(t.table_name) if t.is_temporary else _quoted(t.catalog, *t.database.split("."), t.table_name)
        rows += _columns_of(spark, name, (t.catalog, t.database, t.table_name))
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def schema_listing(columns: DataFrame) -> DataFrame:
    """Per table, its column lines and, apart from them, its partition keys.

    ``columns`` is a catalog listing; a table has as many rows as columns.
    """
    line = schema_text("column_name", "type_text", ~F.col("nullable"), "comment")
    placed = F.struct("position", line.alias("line"))

    def block(chosen: Column, nothing: str) -> Column:
        lines = F.array_sort(F.collect_list(F.when(chosen, placed)))
        joined = F.array_join(F.transform(lines, lambda p: p["line"]), "\n")
        return F.coalesce(F.nullif(joined, F.lit("")), F.lit(nothing))

    return columns.groupBy("catalog", "database", "table_name").agg(
        block(~F.col("is_partition"), "  (no column info)").alias("columns"),
        block(F.col("is_partition"), "  (none)").alias("partition_keys"),
    )


def sample_table(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows in key order, with the row count of the whole table."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).limit(n).withColumn("n_rows", total)


def query_by_key(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values; literals reach the scan as pushed filters."""
    for column, value in values.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df
