"""First-per-key, per-group caps, dense numbering and paging."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from titlelake.sources.shared import Files, stored

DISCOVER_PAGE_CAP = 500


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group in a total ``order``.

    Spark prunes each map partition to ``n`` rows per group before the shuffle, so a
    group holding a large share of all rows reaches its task as a few rows only.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return cap_per_group(df, keys, order, 1)


def placed(df: DataFrame, order: list[Column], place: str, start: int = 0, kind: str = "bigint") -> DataFrame:
    """The rows with their place ``start + 1, start + 2, ...`` in a total order.

    Rows are range-partitioned by the whole order and sorted inside each partition, and stored with
    their partition and place there. A place is that plus the rows of all partitions before; only these
    counts, one per partition, are put in one order. Rows that begin alike are still
    divided, so no task gets more than its share.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        kept.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(place, (F.lit(start + 1) + F.col("_before") + inside).cast(kind))
        .drop("_part", "_before", "_at")
    )


def number_by(df: DataFrame, column: str, number: str, start: int = 0, kind: str = "int") -> DataFrame:
    """Dense numbers ``start + 1, start + 2, ...`` in the order of a unique column, see :func:`placed`."""
    return placed(df, [F.asc(column)], number, start, kind)


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """One page of ``size`` rows in a total ``order``, with ``place``, ``has_more`` and ``total_pages``.

    ``place`` counts from 1 over all pages. A deep page makes every task keep all rows
    before it; :func:`page_after` goes on from a known row instead.

    One row past the page is read to learn whether another page follows, which avoids a
    count of the whole result; ``total_pages`` is the number of pages known by then. The
    windows run over at most ``size + 1`` rows.
    """
    number = page_number(number)
    probe = df.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    return (
        probe.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
        .withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size)
        .withColumn("total_pages", F.lit(number) + F.col("has_more").cast("int"))
        .filter(F.col("_place") <= size)
        .withColumn("place", F.lit((number - 1) * size).cast("bigint") + F.col("_place"))
        .drop("_place")
    )


def is_after(order: list[tuple[str, bool]], last: list) -> Column:
    """Whether a row stands after the values ``last`` in an order of (column, descending), nulls last."""
    later, same = F.lit(False), F.lit(True)
    for (name, descending), value in zip(order, last, strict=True):
        column = F.col(name)
        if value is not None:
            beyond = column < value if descending else column > value
            later = later | (same & (column.isNull() | beyond))
        same = same & column.eqNullSafe(F.lit(value))
    return F.coalesce(later, F.lit(False))


def page_after(df: DataFrame, order: list[tuple[str, bool]], size: int, last: list | None = None) -> DataFrame:
    """The ``size`` rows after the row with the values ``last``, from the start without one.

    The order is total: (column, descending) pairs, nulls last. However deep the page,
    a task keeps ``size`` rows.
    """
    rows = df if last is None else df.filter(is_after(order, last))
    return rows.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]).limit(size)


def page_info(df: DataFrame, size: int, cap: int = DISCOVER_PAGE_CAP) -> DataFrame:
    """Number of results and of pages, the latter capped."""
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("total_results"),
        F.least(F.ceil(rows / size).cast("int"), F.lit(cap)).alias("total_pages"),
    )


def save_listing(df: DataFrame, order: list[Column], path: str) -> None:
    """Store a listing in a total order, each row with its ``place``, for :func:`page_jump`.

    Files are sorted by place, so their statistics are a directory of ranks; beside them a small file keeps the number of rows.
    """
    spark = df.sparkSession
    ranked = placed(df, order, "place")
    ranked.repartitionByRange("place").sortWithinPartitions("place").write.parquet(f"{path}/rows")
    schema = spark.read.parquet(f"{path}/rows").schema
    rows = spark.read.schema(schema).parquet(f"{path}/rows").count()
    Files(spark, path).create("listing", json.dumps({"rows": rows, "schema": schema.json()}))


def page_jump(spark: SparkSession, path: str, size: int, number: int) -> DataFrame:
    """Any page of a saved listing, with the columns of :func:`page`; only blocks that hold its places are read."""
    number = page_number(number)
    listing = json.loads(Files(spark, path).read("listing"))
    first, last = (number - 1) * size + 1, number * size
    rows = spark.read.schema(StructType.fromJson(json.loads(listing["schema"]))).parquet(f"{path}/rows")
    more = listing["rows"] > last
    return (
        rows.filter(F.col("place").between(first, last))
        .withColumns({"has_more": F.lit(more), "total_pages": F.lit(number + int(more))})
        .orderBy("place")
    )


def page_number(number: int) -> int:
    """Pages count from 1; lower numbers mean the first page."""
    return max(1, number)
