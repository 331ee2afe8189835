"""Shards that all hold the mixture of sources: proportional stratified interleaving.

The rows of a source are ranked in a seeded shuffle. Row r of n stands at (r - 1/2) / n;
sorted by this fraction, any stretch of rows holds every source in its share. Cutting the
order at even counts gives the shards, whose counts are at most one apart.

No rank is taken in one task. The shuffle key is a uniform hash, so its leading bits part a
source into even buckets: a row's rank is the number of rows in earlier buckets plus its
place in its own. The fractions are parted in the same way for the final order.

Defined cases: a null source is a source of its own; null and repeated ids and equal rows
are told apart by their hash, and fully equal rows may change places; with fewer rows than
shards the later shards stay empty; an empty table gives an empty result; extra columns are
left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlelake.llm.common import written

SEED = 20
#: Rows that are ordered in one task, about.
ROWS_PER_BUCKET = 100_000


def interleaved(rows: DataFrame, stratum: Column, identity: list[Column], shards: int, seed: int = SEED) -> DataFrame:
    """The rows as ``row`` (a struct of all columns), with ``shard`` and ``slot``."""
    own = rows.select(
        F.struct("*").alias("row"),
        F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit("null")).alias("stratum"),
        F.xxhash64(F.lit(seed), *identity).alias("shuffled"),
    )
    own = written(own, "shard-rows")
    total = own.count()
    bits = max(1, (total // ROWS_PER_BUCKET).bit_length())
    own = own.withColumn("bucket", F.shiftrightunsigned("shuffled", 64 - bits))
    earlier = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (
        own.groupBy("stratum", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "stratum",
            "bucket",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
            F.sum("n").over(Window.partitionBy("stratum")).alias("size"),
        )
    )
    place = F.row_number().over(
        # Unsigned order within a bucket is the signed order of the bits that follow.
        Window.partitionBy("stratum", "bucket").orderBy(F.shiftleft("shuffled", bits), "row")
    )
    ranked = own.join(per_bucket, ["stratum", "bucket"]).select(
        "row", "stratum", "shuffled", ((F.col("before") + place - 0.5) / F.col("size")).alias("at")
    )
    ranked = written(ranked.withColumn("part", F.floor(F.col("at") * (1 << bits)).cast("int")), "shard-ranks")
    # One row for each part: as many as the buckets.
    all_earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = (
        ranked.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(all_earlier), F.lit(0)).alias("before"))
    )
    order = F.row_number().over(Window.partitionBy("part").orderBy("at", F.xxhash64("stratum"), "stratum", "shuffled", "row"))
    ordered = ranked.join(per_part, "part").select("row", (F.col("before") + order - 1).alias("position"))
    small, longer = divmod(total, shards)
    edge = longer * (small + 1)
    position = F.col("position")
    in_long = position < edge
    shard = F.when(in_long, F.floor(position / (small + 1))).otherwise(longer + F.floor((position - edge) / max(small, 1)))
    slot = F.when(in_long, position % (small + 1)).otherwise((position - edge) % max(small, 1))
    return ordered.select("row", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
