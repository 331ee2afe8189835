"""Tab-separated dumps with a header, no quoting and ``\\N`` for a missing value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlelake.schemas import DUMPS

NULL = "\\N"


def read_dump(spark: SparkSession, path: str, dump: str) -> DataFrame:
    """A dump as text columns. Quotes and backslashes are read literally.

    The header is checked against the known column names, and an empty field or a field
    missing at the end of a short row is null.
    """
    return (
        spark.read.schema(", ".join(f"{c} string" for c in DUMPS[dump]))
        .option("sep", "\t")
        .option("header", True)
        .option("enforceSchema", False)
        .option("quote", "")
        .option("encoding", "UTF-8")
        .option("nullValue", NULL)
        .csv(path)
    )


def write_dump(df: DataFrame, path: str, dump: str) -> None:
    """Write text columns as a dump. Tabs and line breaks in a text become spaces, so nothing is quoted."""
    columns = DUMPS[dump]
    cells = [F.coalesce(F.translate(F.col(c).cast("string"), "\t\n\r", "   "), F.lit(NULL)).alias(c) for c in columns]
    (
        df.select(cells)
        .write.mode("overwrite")
        .option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
