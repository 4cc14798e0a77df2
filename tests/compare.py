"""Run a registered query and its SQL in DuckDB over the same files, and compare."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
}


def difference(spark, fn, sql: str, sf_dir: str) -> str | None:
    """None if both give the same columns, types and rows."""
    df = fn(spark, sf_dir)
    cursor = connect(sf_dir).execute(sql)
    theirs = {d[0]: str(d[1]) for d in cursor.description}
    ours = {f.name: _KINDS.get(f.dataType.simpleString(), "?") for f in df.schema}
    if ours != theirs:
        return f"schema: {ours} against {theirs}"
    names = sorted(ours)
    positions = [list(theirs).index(n) for n in names]
    order = lambda row: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)
    expected = sorted((tuple(r[p] for p in positions) for r in cursor.fetchall()), key=order)
    found = sorted((tuple(r) for r in df.select(*names).collect()), key=order)
    if len(found) != len(expected):
        return f"rows: {len(found)} against {len(expected)}"
    for one, other in zip(found, expected):
        if one != other:
            return f"first difference: {one} against {other}"
    return None if found else "both are empty"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    where, wanted = sys.argv[1], sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            problem = difference(session, fn, entry.oracle_sql()[name], where)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {time.time() - started:6.1f}s  {problem or 'ok'}", flush=True)
