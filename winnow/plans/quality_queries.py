"""Data tests, load patterns, profiling and changelogs over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators import load, profiles, quality, versioned
from winnow.operators.quality import ColumnTest
from winnow.plans.registry import Source, query
from winnow.sources.scratch import scratch_dir


@query("SELECT name, log_id FROM <<logs>> WHERE text IS NULL")
def rows_without_text(src: Source) -> DataFrame:
    return quality.null_failures(src("logs"), "text").select("name", "log_id")


@query("SELECT o_custkey, o_orderdate, count(*) AS n_rows FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_orders(src: Source) -> DataFrame:
    return quality.duplicate_failures(src("orders"), ["o_custkey", "o_orderdate"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def unexpected_status(src: Source) -> DataFrame:
    failing = quality.value_failures(src("orders"), "o_orderstatus", ["F", "O"])
    return failing.select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def documents_without_label(src: Source) -> DataFrame:
    docs = src("documents").select("doc_id", "lang")
    return quality.orphan_failures(docs, src("labels"), "doc_id", "doc_id")


@query(
    """SELECT test, failures, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
         SELECT 'orders_key_not_null' AS test, count(*) FILTER (o_orderkey IS NULL) AS failures FROM orders
         UNION ALL SELECT 'orders_status_accepted', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
         UNION ALL SELECT 'orders_price_positive', count(*) FILTER (o_totalprice <= 0) FROM orders
         UNION ALL SELECT 'lineitem_discount_range', count(*) FILTER (l_discount < 0.01) FROM lineitem
         UNION ALL SELECT 'orders_key_unique', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) u
         UNION ALL SELECT 'lineitem_line_unique', count(*) FROM (
           SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) l
         UNION ALL SELECT 'lineitem_has_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
         UNION ALL SELECT 'documents_have_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) t"""
)
def tests_run(src: Source) -> DataFrame:
    orders, lineitem = src("orders"), src("lineitem")
    return quality.run_tests(
        [
            (
                orders,
                [
                    ColumnTest("orders_key_not_null", F.col("o_orderkey").isNull()),
                    ColumnTest("orders_status_accepted", ~F.col("o_orderstatus").isin("F", "O")),
                    ColumnTest("orders_price_positive", F.col("o_totalprice") <= 0),
                ],
            ),
            (lineitem, [ColumnTest("lineitem_discount_range", F.col("l_discount") < 0.01)]),
        ],
        {
            "orders_key_unique": quality.duplicate_failures(orders, ["o_orderkey"]),
            "lineitem_line_unique": quality.duplicate_failures(lineitem, ["l_orderkey", "l_linenumber"]),
            "lineitem_has_order": quality.orphan_failures(lineitem, orders, "l_orderkey", "o_orderkey"),
            "documents_have_label": quality.orphan_failures(
                src("documents"), src("labels"), "doc_id", "doc_id"
            ),
        },
    )


_CUT = "2024-01-20 00:00:00"


@query(
    f"""WITH target AS (SELECT event_id, ts, user_id FROM events WHERE ts < TIMESTAMP '{_CUT}' AND event_type <> 'view')
        SELECT event_id, user_id, 'old' AS origin FROM target
        UNION ALL SELECT event_id, user_id, 'new' FROM events WHERE ts > (SELECT max(ts) FROM target)"""
)
def appended_events(src: Source) -> DataFrame:
    events = src("events").select("event_id", "ts", "user_id")
    kinds = src("events").filter((F.col("ts") < F.lit(_CUT).cast("timestamp_ntz")) & (F.col("event_type") != "view"))
    target = kinds.select("event_id", "ts", "user_id", F.lit("old").alias("origin"))
    loaded = load.incremental_append(target, events.withColumn("origin", F.lit("new")), "ts")
    return loaded.select("event_id", "user_id", "origin")


_TARGET = "SELECT o_orderkey, o_custkey, o_totalprice, 'old' AS origin FROM orders WHERE o_orderstatus <> 'P'"
_SOURCE = "SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, 'new' AS origin FROM orders WHERE o_orderpriority = '1-URGENT'"


@query(
    f"""SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey,
               coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice, coalesce(s.origin, t.origin) AS origin
        FROM ({_TARGET}) t FULL JOIN ({_SOURCE}) s ON t.o_orderkey = s.o_orderkey"""
)
def upserted_orders(src: Source) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    orders = src("orders")
    target = orders.filter(F.col("o_orderstatus") != "P").select(*columns, F.lit("old").alias("origin"))
    source = (
        orders.filter(F.col("o_orderpriority") == "1-URGENT")
        .select(*columns, F.lit("new").alias("origin"))
        .withColumn("o_totalprice", F.col("o_totalprice") + 1)
    )
    return load.merge_upsert(target, source, ["o_orderkey"])


@query(
    f"""SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey,
               coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice, coalesce(s.origin, t.origin) AS origin
        FROM ({_TARGET}) t FULL JOIN ({_SOURCE} AND o_orderkey < 4000) s ON t.o_orderkey = s.o_orderkey"""
)
def upserted_order_files(src: Source) -> DataFrame:
    """The upsert into a table of files: only files with a key of the source are written anew."""
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    orders = src("orders")
    target = orders.filter(F.col("o_orderstatus") != "P").select(*columns, F.lit("old").alias("origin"))
    source = (
        orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") < 4000))
        .select(*columns, F.lit("new").alias("origin"))
        .withColumn("o_totalprice", F.col("o_totalprice") + 1)
    )
    root = scratch_dir(src.spark, "order-files")
    versioned.create_table(target.repartitionByRange(8, "o_orderkey"), root)
    versioned.merge_into(src.spark, root, source, ["o_orderkey"])
    return versioned.read_table(src.spark, root, target.schema)


_REPLACED = "SELECT c_custkey, c_mktsegment, 'new' AS origin FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 5000"


@query(
    f"""SELECT c_custkey, c_mktsegment, 'old' AS origin FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
        UNION ALL {_REPLACED}"""
)
def overwritten_segments(src: Source) -> DataFrame:
    target = src("customer").select("c_custkey", "c_mktsegment", F.lit("old").alias("origin"))
    some = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 5000)
    source = src("customer").filter(some).select("c_custkey", "c_mktsegment", F.lit("new").alias("origin"))
    return load.insert_overwrite(target, source, "c_mktsegment")


@query(
    f"""SELECT c_custkey, c_mktsegment, 'old' AS origin FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
        UNION ALL {_REPLACED}"""
)
def overwritten_partitions(src: Source) -> DataFrame:
    """The same replacement as a partitioned table on storage."""
    path = scratch_dir(src.spark, "segments")
    target = src("customer").select("c_custkey", "c_mktsegment", F.lit("old").alias("origin"))
    some = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 5000)
    source = src("customer").filter(some).select("c_custkey", "c_mktsegment", F.lit("new").alias("origin"))
    load.overwrite_partitions(target, path, "c_mktsegment")
    load.overwrite_partitions(source, path, "c_mktsegment")
    return src.spark.read.parquet(path).select("c_custkey", "c_mktsegment", "origin")


# per customer: the order history is the change log, one snapshot before and one after a date
_OLD = "SELECT o_custkey, o_orderstatus, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') x WHERE rn = 1"
_NEW = "SELECT o_custkey, o_orderstatus, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderpriority <> '5-LOW') x WHERE rn = 1"


def _scd2_sql(changed: str) -> str:
    return f"""WITH o AS ({_OLD}), n AS ({_NEW}), j AS (
          SELECT o.o_custkey AS ok, o.o_orderstatus AS os, o.o_orderdate AS od, n.o_custkey AS nk, n.o_orderstatus AS ns,
                 n.o_orderdate AS nd, coalesce({changed}, FALSE) AS changed
          FROM o FULL JOIN n ON o.o_custkey = n.o_custkey)
        SELECT ok AS o_custkey, os AS o_orderstatus, strftime(od, '%Y-%m-%d') AS valid_from,
               CASE WHEN changed THEN strftime(nd, '%Y-%m-%d') END AS valid_to FROM j WHERE ok IS NOT NULL
        UNION ALL SELECT nk, ns, strftime(nd, '%Y-%m-%d'), NULL FROM j WHERE nk IS NOT NULL AND (ok IS NULL OR changed)"""


def _snapshots(src: Source) -> tuple[DataFrame, DataFrame]:
    def newest(orders: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("o_orderstatus", "o_orderdate"), F.struct("o_orderdate", "o_orderkey"))
        return orders.groupBy("o_custkey").agg(last.alias("r")).select("o_custkey", "r.*")

    orders = src("orders")
    before = newest(orders.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    history = before.withColumn("valid_from", F.col("o_orderdate")).withColumn(
        "valid_to", F.lit(None).cast("timestamp_ntz")
    )
    return history, newest(orders.filter(F.col("o_orderpriority") != "5-LOW"))


def _dated(history: DataFrame) -> DataFrame:
    day = "yyyy-MM-dd"
    return history.select(
        "o_custkey",
        "o_orderstatus",
        F.date_format("valid_from", day).alias("valid_from"),
        F.date_format("valid_to", day).alias("valid_to"),
    )


@query(_scd2_sql("n.o_orderdate > o.o_orderdate"))
def history_by_timestamp(src: Source) -> DataFrame:
    history, current = _snapshots(src)
    return _dated(load.scd2_snapshot(history, current, "o_custkey", "o_orderdate"))


@query(_scd2_sql("n.o_orderstatus IS DISTINCT FROM o.o_orderstatus AND n.o_custkey IS NOT NULL AND o.o_custkey IS NOT NULL"))
def history_by_check(src: Source) -> DataFrame:
    history, current = _snapshots(src)
    return _dated(
        load.scd2_snapshot(history, current, "o_custkey", "o_orderdate", check_columns=["o_orderstatus"])
    )


@query(_scd2_sql("n.o_orderdate > o.o_orderdate"))
def history_files(src: Source) -> DataFrame:
    """The history as a table of files: only files with an open row that changes are written anew."""
    history, current = _snapshots(src)
    root = scratch_dir(src.spark, "history-files")
    versioned.create_table(history.repartitionByRange(8, "o_custkey"), root)
    versioned.snapshot_into(src.spark, root, current, history.schema, "o_custkey", "o_orderdate")
    return _dated(versioned.read_table(src.spark, root, history.schema))


@query(
    """SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest,
              CASE WHEN max(ts) < TIMESTAMP '2024-02-03' - INTERVAL 7 DAY THEN 'error'
                   WHEN max(ts) < TIMESTAMP '2024-02-03' - INTERVAL 2 DAY THEN 'warn' ELSE 'pass' END AS status
       FROM events"""
)
def events_freshness(src: Source) -> DataFrame:
    now = F.lit("2024-02-03 00:00:00").cast("timestamp_ntz")
    fresh = quality.source_freshness(src("events"), "ts", now, warn="2 DAYS", error="7 DAYS")
    return fresh.withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm:ss"))


def _rules():
    return {
        "price": F.col("l_extendedprice") > 1000,
        "discount": F.col("l_discount") <= 0.08,
        "flag": F.col("l_returnflag") != "R",
    }


@query(
    """SELECT 'price' AS expectation, count(*) FILTER (l_extendedprice > 1000) AS passed,
              count(*) FILTER (NOT l_extendedprice > 1000) AS failed FROM lineitem
       UNION ALL SELECT 'discount', count(*) FILTER (l_discount <= 0.08), count(*) FILTER (NOT l_discount <= 0.08) FROM lineitem
       UNION ALL SELECT 'flag', count(*) FILTER (l_returnflag <> 'R'), count(*) FILTER (l_returnflag = 'R') FROM lineitem"""
)
def expectation_counts(src: Source) -> DataFrame:
    return quality.expectation_counts(src("lineitem"), _rules())


@query(
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE l_extendedprice > 1000 AND l_discount <= 0.08 AND l_returnflag <> 'R'"""
)
def expectations_drop(src: Source) -> DataFrame:
    return quality.expectations(src("lineitem"), _rules(), "drop").select("l_orderkey", "l_linenumber")


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice > 1000 AS ok_price, l_discount <= 0.08 AS ok_discount,
              l_returnflag <> 'R' AS ok_flag FROM lineitem"""
)
def expectations_keep(src: Source) -> DataFrame:
    flagged = quality.expectations(src("lineitem"), _rules(), "keep")
    return flagged.select("l_orderkey", "l_linenumber", "ok_price", "ok_discount", "ok_flag")


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def expectations_fail(src: Source) -> DataFrame:
    """Expectations that hold for every row let all rows pass."""
    rules = {"quantity": F.col("l_quantity") >= 0, "key": F.col("l_orderkey").isNotNull()}
    return quality.expectations(src("lineitem"), rules, "fail").select("l_orderkey", "l_linenumber")


@query(
    """SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem) AS n_rows FROM lineitem"""
)
def expectations_written(src: Source) -> DataFrame:
    """Rows counted against their expectations while they are written; read back, as all hold."""
    rules = {"quantity": F.col("l_quantity") >= 0, "key": F.col("l_orderkey").isNotNull()}
    path = scratch_dir(src.spark, "expected")
    counts = quality.write_expected(src("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), path, rules)
    written = src.spark.read.parquet(path).select("l_orderkey", "l_linenumber")
    return written.withColumn("n_rows", F.lit(counts["n_rows"]).cast("bigint"))


@query(
    """SELECT log_id, md5(coalesce(name, '_dbt_utils_surrogate_key_null_') || '-' || CAST(log_id AS VARCHAR) || '-'
              || coalesce(text, '_dbt_utils_surrogate_key_null_')) AS sk FROM <<logs>>"""
)
def log_surrogate_keys(src: Source) -> DataFrame:
    return src("logs").select("log_id", load.surrogate_key("name", "log_id", "text").alias("sk"))


@query(
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
              count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup,
              count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id"""
)
def events_pivot(src: Source) -> DataFrame:
    return quality.pivot_counts(src("events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query(
    """SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n
       FROM generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) s(d)
       LEFT JOIN (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1) e ON s.d = e.day"""
)
def events_per_day(src: Source) -> DataFrame:
    spine = quality.date_spine(src("events"), "ts", "2023-12-28", "2024-02-05")
    return spine.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    " UNION ALL ".join(
        [
            f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null, 0.0::DOUBLE AS null_pct,
                       min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev
                FROM lineitem"""
            for c in _NUMERIC
        ]
        + [
            """SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), 0.0::DOUBLE, NULL, NULL, NULL, NULL FROM lineitem"""
        ]
    )
)
def lineitem_profile(src: Source) -> DataFrame:
    found = quality.profile_columns(src("lineitem"), _NUMERIC, ["l_returnflag"])
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


@query(
    " UNION ALL ".join(
        [
            f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null, CAST(min({c}) AS DOUBLE) AS min,
                       CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean FROM events"""
            for c in ("value", "user_id")
        ]
        + ["SELECT 'event_type', count(*), count(*) - count(event_type), NULL, NULL, NULL FROM events"]
    )
)
def events_profile_by_day(src: Source) -> DataFrame:
    """Profiles kept for each day, the last days added later, and merged: the exact columns of the whole table."""
    events, path = src("events"), scratch_dir(src.spark, "day-profiles")
    late = F.col("ts") >= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    for days in (events.where(~late), events.where(late)):
        profiles.part_profiles(days, F.to_date("ts"), ["value", "user_id"], ["event_type"]).write.mode("append").parquet(path)
    merged = profiles.merge_profiles(src.spark.read.parquet(path))
    return merged.select("column", "n_rows", "n_null", "min", "max", F.round("mean", 4).alias("mean"))


@query(
    """SELECT 0.25::DOUBLE AS q, quantile_disc(l_extendedprice, 0.25) AS value FROM lineitem
       UNION ALL SELECT 0.5::DOUBLE, quantile_disc(l_extendedprice, 0.5) FROM lineitem
       UNION ALL SELECT 0.75::DOUBLE, quantile_disc(l_extendedprice, 0.75) FROM lineitem
       UNION ALL SELECT 0.999::DOUBLE, quantile_disc(l_extendedprice, 0.999) FROM lineitem"""
)
def lineitem_quantiles(src: Source) -> DataFrame:
    return quality.exact_quantiles(src("lineitem"), "l_extendedprice", [0.25, 0.5, 0.75, 0.999])


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 3")
def common_part_types(src: Source) -> DataFrame:
    return quality.category_counts(src("part"), "p_type", 3)


@query(
    """SELECT 'l_quantity' AS left_column, 'l_extendedprice' AS right_column, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem
       UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem
       UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem"""
)
def lineitem_correlations(src: Source) -> DataFrame:
    return quality.correlations(src("lineitem"), _NUMERIC)


@query(
    """WITH c AS (
         SELECT regexp_extract(subject, '^(\\w+)(\\(([^)]*)\\))?(!)?:', 1) AS type,
                nullif(regexp_extract(subject, '^\\w+\\(([^)]*)\\)!?:', 1), '') AS scope,
                regexp_matches(subject, '^\\w+(?:\\([^)]*\\))?!:') AS breaking
         FROM <<commits>> WHERE subject NOT LIKE 'Merge %')
       SELECT CASE type WHEN 'feat' THEN 'Features' WHEN 'fix' THEN 'Bug Fixes' WHEN 'chore' THEN 'Chores' ELSE 'Other' END AS section,
              scope, count(*) AS n_commits, count(*) FILTER (breaking) AS n_breaking
       FROM c GROUP BY 1, 2"""
)
def changelog_sections(src: Source) -> DataFrame:
    return load.changelog_groups(src("commits"))
