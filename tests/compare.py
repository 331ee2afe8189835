"""Run queries against DuckDB on the same tables: ``python tests/compare.py [sf] [query ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in VIEWS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def cell(value):
    """A sortable form: text and truth by value, numbers as floats."""
    if value is None or isinstance(value, (bool, str)):
        return repr(value)
    return repr(float(value))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """What differs between a Spark result and a statement, ``None`` if nothing does."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    theirs = {d[0]: str(d[1]) for d in found.description}
    for name, kind in spark_df.dtypes:
        if KINDS.get(kind) != theirs[name] and theirs[name] != '"NULL"':
            return f"type of {name}: {kind} / {theirs[name]}"
    want = normal(names, found.fetchall())
    got = normal(spark_df.columns, spark_df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(wrong)} of {len(got)} rows, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from titlelake.testing.oracle import ORACLE
    from titlelake.testing.queries import QUERIES

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for key in sys.argv[2:] or QUERIES:
        began = time.time()
        try:
            df = QUERIES[key](session, sf_dir)
            rows = df.count() if key not in ORACLE else None
            said = f"no oracle, {rows} rows" if rows is not None else difference(df, duck(sf_dir), ORACLE[key])
            empty = "" if df.take(1) else " EMPTY"
        except Exception as error:
            said, empty = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += said is not None and not said.startswith("no oracle")
        print(f"{'ok' if said is None else 'BAD'} {key} {time.time() - began:.1f}s{empty} {said or ''}"[:900], flush=True)
    print(f"{bad} bad")
