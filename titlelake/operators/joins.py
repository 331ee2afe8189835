"""Joins from a large table with a hot key to a table with one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a stored table take about so many times the size that Spark estimates for it, which is that of its compressed files.
STORED_FACTOR = 16

# Any key holding more than 1/HOT_KEYS of the rows is among the HOT_KEYS most frequent.
HOT_KEYS = 256

# A derived table of so many rows is broadcast once it is counted.
FEW_ROWS = 10_000


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the rows, by Spark's own size estimate times ``STORED_FACTOR``, are within its broadcast limit.

    A client that cannot see the estimate counts as not fitting.
    """
    if getattr(df, "_jdf", None) is None:
        return False
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) * STORED_FACTOR <= limit


def moved(df: DataFrame) -> DataFrame:
    """The right side of a join by key, broadcast by Spark only if its rows are small, not just its files."""
    return df if fits_broadcast(df) else df.hint("merge")


def few_rows(dim: DataFrame) -> bool:
    """Whether a table has at most ``FEW_ROWS`` rows, by a count of no more than these, whatever Spark estimates for it."""
    return len(dim.select(F.lit(1)).limit(FEW_ROWS + 1).collect()) <= FEW_ROWS


def attach_few(facts: DataFrame, dim: DataFrame, key: str, spread: str | list[str], how: str = "inner") -> DataFrame:
    """:func:`attach` for a ``dim`` that is derived and has few rows as a rule, such as the genres.

    Spark estimates far more rows than such a table has. It is counted, and up to ``FEW_ROWS`` rows are broadcast, so no facts move.
    """
    if fits_broadcast(dim) or not few_rows(dim):
        return attach(facts, dim, key, spread, how)
    return facts.join(F.broadcast(dim), key, how)


def attach(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread: str | list[str],
    how: str = "inner",
    count_on: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` to ``dim`` on ``key`` without gathering a hot key in one task.

    A ``dim`` within the broadcast limit is left to Spark, which then broadcasts it and
    moves no facts. Otherwise the most frequent keys of the facts (at most ``HOT_KEYS``,
    whatever the data size) are salted: their rows are spread by a hash of the ``spread``
    columns and the matching rows of ``dim`` are repeated once per salt. All other keys
    take salt 0. The result is that of the plain join; ``how`` may be inner, left,
    left_semi or left_anti.

    Keys are counted on the facts, or on ``count_on`` where that is cheaper to compute.
    Which keys are salted changes the balance of the tasks, never the result.
    """
    if fits_broadcast(dim):
        return facts.join(dim, key, how)
    spread = [spread] if isinstance(spread, str) else spread
    # One salt per shuffle partition: a key with a third of all rows fills a third of them.
    salts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = (
        (facts if count_on is None else count_on)
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .orderBy(F.desc("_rows"), key)
        .limit(HOT_KEYS)
        .select(key, F.lit(True).alias("_hot"))
    )
    own_salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    salted = (
        facts.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), own_salt).otherwise(0))
        .drop("_hot")
    )
    repeated = (
        dim.join(F.broadcast(hot), key, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_hot")
    )
    # The dim is too large to broadcast, whatever Spark estimates for it.
    return salted.join(repeated.hint("merge"), [key, "_salt"], how).drop("_salt")


# Keys that are named in a filter, and how many together: Spark passes so many on to the files one by one.
NAMED_KEYS, TOGETHER = 1000, 10


def by_few_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` is in a table of unique keys that is expected to be small.

    Up to ``NAMED_KEYS`` keys become a filter that skips row groups of a table sorted by the key; more are joined.
    """
    few = [r[0] for r in keys.limit(NAMED_KEYS + 1).collect()]
    if len(few) > NAMED_KEYS:
        return by_keys(df, key, keys)
    few.sort()
    named = [F.col(key).isin(few[i : i + TOGETHER]) for i in range(0, len(few), TOGETHER)]
    return df.filter(reduce(lambda a, b: a | b, named, F.lit(False)))


def by_keys(df: DataFrame, key: str, keys: None | str | list[str] | DataFrame) -> DataFrame:
    """Rows of one key, of several keys, or of a table of keys; ``None`` keeps all rows.

    Literal keys become a filter that reaches the scan, a key table a semi join that
    spreads the rows of a very frequent key.
    """
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
        return attach(df, wanted, key, [c for c in df.columns if c != key], "left_semi").select(*df.columns)
    return df.filter(F.col(key).isin([keys] if isinstance(keys, str) else list(keys)))
