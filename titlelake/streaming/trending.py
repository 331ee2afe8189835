"""Views per title and time window as a stream.

Each micro-batch writes the windows that it changed, with their counts so far, to its own
``batch=<id>`` folder and overwrites it on a retry. Counts only grow, so the largest of a
window is the current one. The watermark bounds the state: events later than it are left
out, and windows behind it leave the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNT = "tconst string, start timestamp, views bigint"


def stream_counts(
    events: DataFrame, store: str, checkpoint: str, width: str = "7 days", late: str = "7 days"
) -> StreamingQuery:
    """Count a stream of events ``tconst, ts`` into a store; takes what is available and stops."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/counts/batch={number}")

    counts = (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("span"), "tconst")
        .agg(F.count(F.lit(1)).alias("views"))
        .select("tconst", F.col("span.start").alias("start"), "views")
    )
    return (
        counts.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_counts(spark: SparkSession, store: str) -> DataFrame:
    """``tconst, start, views``: the views of each title in the window that starts then."""
    counts = spark.read.schema(COUNT).parquet(f"{store}/counts")
    return counts.groupBy("tconst", "start").agg(F.max("views").alias("views"))
