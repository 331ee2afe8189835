"""Integrity kept by version: counts per key value and totals per rule, moved on by the rows that changed.

A full check aggregates every key of every table. Here the counts of :func:`checks.key_counts` are stored, and a change
adds a small table of differences. Only values in the differences are looked up, before and
after: a parent that goes, or comes back, is such a value as well as a child that does, so references are
checked both ways. Totals per rule move by what changed.

A state is a folder with ``counts/`` (the stored counts, then one folder a change), ``totals/`` and ``state/``, numbered
small files that name them. After ``DELTAS`` changes the counts are added up into one folder.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlelake.catalog import Catalog
from titlelake.operators import checks
from titlelake.operators.joins import NAMED_KEYS, TOGETHER
from titlelake.schemas import TABLES
from titlelake.sources.shared import Files, stored

DELTAS = 8
COUNTS = "key string, value string, " + ", ".join(f"{m} bigint" for m in checks.MEASURES)
TOTALS = "table_name string, rule string, violations bigint, rows bigint"

Rows = dict[str, DataFrame]


def _state(spark: SparkSession, path: str) -> dict:
    files = Files(spark, path)
    numbers = [int(n) for n in files.names("state") if n.isdigit()]
    if not numbers:
        raise FileNotFoundError(f"no integrity state in {path}")
    return json.loads(files.read(f"state/{max(numbers):08d}")) | {"number": max(numbers)}


def _write(spark: SparkSession, path: str, number: int, counts: DataFrame, kept: list[str], totals: DataFrame) -> int:
    name = uuid.uuid4().hex[:12]
    counts.repartitionByRange("key", "value").sortWithinPartitions("key", "value").write.parquet(f"{path}/counts/{name}")
    totals.coalesce(1).write.parquet(f"{path}/totals/{name}")
    Files(spark, path).create(f"state/{number:08d}", json.dumps({"counts": [*kept, name], "totals": name}))
    return number


def start(cat: Catalog, path: str, tables: list[str] | None = None) -> int:
    """Check all tables and store the counts; returns the number of the state, 1."""
    own = {name: cat[name] for name in tables or TABLES}
    spark = next(iter(own.values())).sparkSession
    counts = stored(checks.key_counts(own), "counts")
    totals = checks.row_violations(own).unionByName(checks.key_violations(counts, list(own)))
    return _write(spark, path, 1, counts, [], totals)


def _counts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.schema(COUNTS).parquet(*[f"{path}/counts/{n}" for n in names])


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key", "value").agg(*[F.sum(m).alias(m) for m in checks.MEASURES])


def _scaled(df: DataFrame, columns: list[str], sign: int) -> DataFrame:
    return df.withColumns({c: F.col(c) * sign for c in columns})


def _of(state: DataFrame, changed: DataFrame) -> DataFrame:
    """The stored counts of the changed values; few are named in the scan, which skips the rest."""
    few = [r[0] for r in changed.select("value").distinct().limit(NAMED_KEYS + 1).collect()]
    if len(few) <= NAMED_KEYS:
        named = sorted(v for v in few if v is not None)
        parts = [F.col("value").isin(named[i : i + TOGETHER]) for i in range(0, len(named), TOGETHER)]
        state = state.filter(reduce(lambda a, b: a | b, parts, F.col("value").isNull()))
    keys = changed.select(F.col("key").alias("k"), F.col("value").alias("v"))
    return state.join(keys, (F.col("key") == F.col("k")) & F.col("value").eqNullSafe(F.col("v")), "left_semi")


def advance(spark: SparkSession, path: str, removed: Rows, added: Rows) -> int:
    """Move the state on by rows that went and rows that came, by table; returns its new number.

    A row in both counts as unchanged, so whole files may be given where few of their rows differ.
    Of two that move the same state on, one raises ``Taken``.
    """
    now = _state(spark, path)
    tables = [r["table_name"] for r in _totals(spark, path, now).select("table_name").distinct().collect()]
    signed = [(rows, sign) for rows, sign in ((removed, -1), (added, 1)) if rows]
    if not signed:
        return now["number"]
    parts = [_scaled(checks.key_counts(rows), checks.MEASURES, sign) for rows, sign in signed]
    moved = " or ".join(f"{m} <> 0" for m in checks.MEASURES)
    delta = stored(_added(reduce(DataFrame.unionByName, parts)).filter(moved), "delta")
    before = stored(_added(_of(_counts(spark, path, now["counts"]), delta)), "before")
    after = _added(before.unionByName(delta))
    changes = [_scaled(checks.row_violations(rows), ["violations", "rows"], sign) for rows, sign in signed]
    changes += [_scaled(checks.key_violations(before, tables), ["violations", "rows"], -1), checks.key_violations(after, tables)]
    every = reduce(DataFrame.unionByName, changes, _totals(spark, path, now))
    totals = every.groupBy("table_name", "rule").agg(F.sum("violations").alias("violations"), F.sum("rows").alias("rows"))
    kept = now["counts"]
    if len(kept) >= DELTAS:
        whole = _added(_counts(spark, path, kept).unionByName(delta)).filter(moved)
        return _write(spark, path, now["number"] + 1, whole, [], totals)
    return _write(spark, path, now["number"] + 1, delta, kept, totals)


def _totals(spark: SparkSession, path: str, state: dict) -> DataFrame:
    return spark.read.schema(TOTALS).parquet(f"{path}/totals/{state['totals']}")


def report(spark: SparkSession, path: str) -> DataFrame:
    """The broken rules by the last state, as :func:`checks.violations` has them."""
    return _totals(spark, path, _state(spark, path))
