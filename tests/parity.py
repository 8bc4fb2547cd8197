"""Compare a registered query with its SQL on the same tables.

Run ``python -m tests.parity [folder] [name ...]`` for a table of results.
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

from winnow.plans.views import TABLES

_DUCK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _type(t: str) -> str:
    if t.endswith("[]"):
        return f"array<{_type(t[:-2])}>"
    return _DUCK_TYPES.get(t, t)


def _cell(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_cell, v)) + "]"
    return str(v)


def compare(con, df, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty when they agree."""
    rel = con.execute(sql)
    duck_cols = {d[0]: _type(str(d[1])) for d in rel.description}
    duck_names = [d[0] for d in rel.description]
    duck_rows = rel.fetchall()
    spark_cols = {f.name: f.dataType.simpleString() for f in df.schema}
    if set(spark_cols) != set(duck_cols):
        return [f"columns {sorted(spark_cols)} <> {sorted(duck_cols)}"]
    problems = [
        f"type of {c}: {spark_cols[c]} <> {duck_cols[c]}" for c in spark_cols if spark_cols[c] != duck_cols[c]
    ]
    names = sorted(spark_cols)
    pos = [duck_names.index(n) for n in names]
    left = sorted(tuple(_cell(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect())
    right = sorted(tuple(_cell(r[i]) for i in pos) for r in duck_rows)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} <> {len(right)}")
    if left != right:
        only_left, only_right = set(left) - set(right), set(right) - set(left)
        problems.append(f"spark only {sorted(only_left)[:3]}")
        problems.append(f"sql only {sorted(only_right)[:3]}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_spark

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = make_spark()
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if argv[1:] and not any(a in name for a in argv[1:]):
            continue
        started = time.time()
        try:
            df = build(spark, folder)
            if name in sqls:
                problems = compare(con, df, sqls[name])
                note = f"ok {con.execute('SELECT count(*) FROM (' + sqls[name] + ')').fetchone()[0]} rows"
            else:
                problems, note = [], f"rows only: {df.count()}"
        except Exception as e:  # report and go on with the next query
            problems, note = [f"{type(e).__name__}: {str(e)[:600]}"], ""
        bad += bool(problems)
        print(f"{name:40s} {time.time() - started:6.2f}s {'FAIL' if problems else note}", flush=True)
        for p in problems:
            print("    ", p[:900], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
