"""What several operators share: stored intermediate tables, row keys, model samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.sources.shared import shared_folder

#: Rows of a batch that are turned into Python values at once.
SLICE = 256


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, stored in the shared folder and read back: lineage ends here.

    Executors lost later cost a read of these files, not the work behind them.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One number for a row by its id and whole text; nulls are allowed in both."""
    return F.xxhash64(F.col(doc_id), F.lit("|"), F.col(text))


def bucket(of: Column, buckets: int) -> Column:
    """``crc32(id as text) mod buckets``; null for a null id."""
    return F.crc32(of.cast("string")) % buckets


def each(array: pa.Array) -> Iterator:
    """Python values of an Arrow array, a slice at a time."""
    for start in range(0, len(array), SLICE):
        yield from array.slice(start, SLICE).to_pylist()


def hash_share(of: Column, part: Column) -> Column:
    """Whether a row is in a sample that holds the share ``part`` of the rows, by hash."""
    return F.pmod(F.xxhash64(of, F.lit(17)), F.lit(1 << 30)) < part * (1 << 30)
