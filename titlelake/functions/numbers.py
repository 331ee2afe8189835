"""Numeric expressions: decades, exact two-decimal means, display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decade(year: Column) -> Column:
    """First year of the decade, by integer division."""
    return (F.floor(year / 10) * 10).cast("int")


def tenths(value: Column) -> Column:
    """A one-decimal number as a whole number of tenths."""
    return (value.cast("decimal(10,1)") * 10).cast("long")


def mean_2dp(total_tenths: Column, rows: Column) -> Column:
    """Mean from a sum of tenths and a row count, rounded once, half away from zero.

    Spark's ``avg(decimal(3,1))`` carries few digits, so rounding it to two decimals
    rounds twice. Sums and counts in whole numbers are exact, and they add up across
    pre-aggregated groups. The result is null where there are no rows.
    """
    hundredths = F.call_function("div", F.abs(total_tenths) * 20 + rows, rows * 2)
    signed = hundredths * F.signum(total_tenths).cast("long")
    return F.when(rows > 0, (signed.cast("decimal(12,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)"))


def avg2(value: Column) -> Column:
    """Aggregate: exact mean of a one-decimal column at two decimals, nulls ignored."""
    return mean_2dp(F.sum(tenths(value)), F.count(value))


def rating_text(value: Column) -> Column:
    """One decimal, as shown next to the star."""
    return value.cast("decimal(10,1)").cast("string")


def votes_text(value: Column) -> Column:
    """Whole number with grouped thousands."""
    return F.format_number(value, 0)
