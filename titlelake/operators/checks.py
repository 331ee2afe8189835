"""Integrity checks: the table constraints as jobs that report violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.catalog import Catalog
from titlelake.operators.joins import fits_broadcast
from titlelake.schemas import PRIMARY_KEYS, REFERENCES, REQUIRED, TEXT_LIMITS, UNIQUE

# Range of decimal(3,1).
RATING_LIMIT = 100


def check_pk(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def check_unique(df: DataFrame, column: str) -> DataFrame:
    """Values of a column that occur more than once; nulls may repeat."""
    return check_pk(df.filter(F.col(column).isNotNull()), [column])


def check_fk(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child values without a parent row, with the number of child rows holding them.

    The child is counted per value first, so a frequent value is one row in the join.
    """
    used = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def count_where(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over a table: rows ``rule, violations`` counting where each rule is broken."""
    broken = [
        F.struct(
            F.lit(name).alias("rule"),
            F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("long").alias("violations"),
        )
        for name, bad in rules.items()
    ]
    return df.agg(F.array(*broken).alias("found")).select(F.inline("found"))


def not_null_rules(columns: list[str]) -> dict[str, Column]:
    return {f"{c} is null": F.col(c).isNull() for c in columns}


def length_rules(limits: dict[str, int]) -> dict[str, Column]:
    return {f"{c} longer than {n}": F.length(c) > n for c, n in limits.items()}


def rating_rules(column: str = "average_rating") -> dict[str, Column]:
    """A value fits decimal(3,1) if it stays below 100 after rounding to one decimal."""
    rounded = F.abs(F.round(F.col(column).cast("decimal(20,10)"), 1))
    return {f"{column} out of range": rounded >= RATING_LIMIT}


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return count_where(df, not_null_rules(columns))


def check_domain(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return count_where(df, rules)


def row_rules(name: str) -> dict[str, Column]:
    """The rules of a table that one row can break."""
    rules = not_null_rules(REQUIRED[name]) | length_rules(TEXT_LIMITS[name])
    return rules | rating_rules() if name == "rating" else rules


def key_text(columns: list[str]) -> Column:
    """A key as one text, null where a single column is null."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _key_rules(tables: list[str]) -> list[tuple[str, str, str]]:
    """(table, rule, key) of the key rules; ``key`` names what is unique."""
    return [
        (name, f"{', '.join(keys)} repeated", f"{name}.{','.join(keys)}")
        for name in tables
        for keys in [PRIMARY_KEYS[name]] + [[c] for c in UNIQUE.get(name, [])]
    ]


def _uses(name: str) -> list[tuple[str, Column, str]]:
    """(key, value, measure) that each row of a table counts for: its own keys, and the parent keys it refers to."""
    own = [(f"{name}.{','.join(PRIMARY_KEYS[name])}", key_text(PRIMARY_KEYS[name]), "own")]
    own += [(f"{name}.{c}", key_text([c]), "own") for c in UNIQUE.get(name, [])]
    refers = [(f"{parent}.{key}", key_text([column]), f"ref{i}") for i, (child, column, parent, key) in enumerate(REFERENCES) if child == name]
    return own + refers


#: What is counted per key value: rows that have it, and rows of each reference that use it.
MEASURES = ["own", *(f"ref{i}" for i in range(len(REFERENCES)))]


def dealt(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, of a large table in even shares of all shuffle partitions.

    What Spark puts in one task by the size of compressed rows may be millions of them, whose distinct values a task holds in memory.
    """
    return df if fits_broadcast(df) else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def key_counts(rows: dict[str, DataFrame]) -> DataFrame:
    """Per key value ``key, value`` the rows that have it and, by reference, that use it.

    Each table is read once for all its keys and references. A parent key and its uses meet in one row, so neither
    needs a join, and a frequent value is one row per task before anything moves. A unique column that is null may repeat
    and is not counted, nor is a null reference.
    """
    parts = []
    for name, df in rows.items():
        # A key of several columns is a text even if some are null; of one column it may be null.
        uses = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit(m).alias("measure")) for k, v, m in _uses(name)])
        entry = df.select(F.inline(uses))
        optional = [f"{name}.{c}" for c in UNIQUE.get(name, [])]
        parts.append(entry.filter(F.col("value").isNotNull() | ((F.col("measure") == "own") & ~F.col("key").isin(optional))))
    measures = [F.count(F.when(F.col("measure") == m, 1)).alias(m) for m in MEASURES]
    return reduce(DataFrame.unionByName, parts).groupBy("key", "value").agg(*measures)


def key_violations(counts: DataFrame, tables: list[str]) -> DataFrame:
    """Broken key and reference rules by the counts per key value: ``table_name, rule, violations`` (values) and ``rows``."""
    found = []
    for name, rule, key in _key_rules(tables):
        found.append((name, rule, (F.col("key") == key) & (F.col("own") > 1), F.col("own")))
    for i, (child, column, parent, key) in enumerate(REFERENCES):
        if child in tables:
            rows = F.col(f"ref{i}")
            found.append((child, f"{column} not in {parent}", (F.col("key") == f"{parent}.{key}") & (F.col("own") < 1) & (rows > 0), rows))
    rules = [
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(rule).alias("rule"),
            F.count(F.when(bad, 1)).alias("violations"),
            F.coalesce(F.sum(F.when(bad, rows)), F.lit(0)).alias("rows"),
        )
        for name, rule, bad, rows in found
    ]
    return counts.agg(F.array(*rules).alias("found")).select(F.inline("found"))


def row_violations(rows: dict[str, DataFrame]) -> DataFrame:
    """Broken rules of single rows, a pass per table: ``table_name, rule, violations`` and ``rows``, which are the same."""
    parts = [count_where(df, row_rules(name)).select(F.lit(name).alias("table_name"), "rule", "violations") for name, df in rows.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("rows", F.col("violations"))


def violations(cat: Catalog, tables: list[str]) -> DataFrame:
    """One row per constraint of the given tables: ``table_name, rule, violations, rows``.

    ``violations`` counts rows for null and domain rules, and distinct keys for key and reference rules;
    ``rows`` counts the rows concerned for all. Null and domain rules of a table share a pass; all keys and references
    of all tables share one aggregation.
    """
    own = {name: cat[name] for name in tables}
    parents = {parent: cat[parent] for child, _, parent, _ in REFERENCES if child in tables}
    counts = key_counts({name: dealt(df, df.columns) for name, df in (own | parents).items()})
    return row_violations(own).unionByName(key_violations(counts, tables))
