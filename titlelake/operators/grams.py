"""Substring search by a trigram index: posting lists are read and intersected, few names are compared.

Names are numbered in the order of their ids and divided in blocks of ``BLOCK``. The index has one row per
trigram of the lower-cased names and block, with the sorted places of the names that hold it; no list is longer than a
block, however frequent the trigram. Two end marks after each name give a trigram to every position, so one or two
characters of a query are looked up as the beginning of trigrams. What the lists leave is compared with the query by the
same expression as a search without index, so both give the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titlelake.functions.text import contains_ci, like
from titlelake.operators.ranking import number_by
from titlelake.sources.shared import stored

BLOCK = 1 << 16
GRAM = 3
#: So many trigrams of a query are looked up at most; the comparison does the rest.
LOOKED_UP = 12
#: Blocks with candidates up to which they are named in the scan of the names.
NAMED_BLOCKS = 500
END = "\0" * (GRAM - 1)


@dataclass(frozen=True)
class NameIndex:
    """``postings`` (gram, block, places) and ``names`` (block, place, id, name)."""

    postings: DataFrame
    names: DataFrame


def grams_of(name: Column) -> Column:
    """The distinct trigrams of a lower-cased name, one from each position."""
    low = F.lower(name)
    padded = F.concat(low, F.lit(END))
    starts = F.when(F.length(low) > 0, F.sequence(F.lit(1), F.length(low))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(GRAM))))


def build(names: DataFrame) -> NameIndex:
    """The index of names (id, name) with unique ids; a null name is not found by any query."""
    numbered = number_by(names.filter("name is not null").select("id", "name"), "id", "number", -1, "bigint")
    placed = numbered.select(
        F.floor(F.col("number") / BLOCK).cast("int").alias("block"), (F.col("number") % BLOCK).cast("int").alias("place"), "id", "name"
    )
    holds = placed.select("block", "place", F.explode(grams_of(F.col("name"))).alias("gram"))
    postings = holds.groupBy("gram", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return NameIndex(postings, placed)


def save(index: NameIndex, path: str) -> None:
    postings = index.postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")
    postings.write.parquet(f"{path}/postings")
    index.names.repartitionByRange("block", "place").sortWithinPartitions("block", "place").write.parquet(f"{path}/names")


def load(spark: SparkSession, path: str) -> NameIndex:
    postings = spark.read.schema("gram string, block int, places array<int>").parquet(f"{path}/postings")
    return NameIndex(postings, spark.read.schema("block int, place int, id string, name string").parquet(f"{path}/names"))


def pieces(pattern: str) -> list[str]:
    """The stretches of a pattern between its wildcards, escapes undone."""
    found, at = [""], 0
    while at < len(pattern):
        if pattern[at] == "\\" and at + 1 < len(pattern):
            at += 1
            found[-1] += pattern[at]
        elif pattern[at] in "%_":
            found.append("")
        else:
            found[-1] += pattern[at]
        at += 1
    return [piece for piece in found if piece]


def wanted(spark: SparkSession, query: str, literal: bool) -> tuple[list[str], list[str]]:
    """Trigrams that a match holds, and beginnings of trigrams where there is none."""
    if literal:
        parts = [query.lower()]
    else:
        # Spark lowers the pattern of a search, so it lowers this one.
        parts = pieces(spark.sql("SELECT lower(:pattern) AS low", {"pattern": like(f"%{query}%")}).first()["low"])
    whole = sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})
    return whole[:: -(-len(whole) // LOOKED_UP) or 1], sorted({p for p in parts if p and len(p) < GRAM}) if not whole else []


def candidates(index: NameIndex, query: str, literal: bool = False) -> DataFrame | None:
    """Places (block, place) of the names that hold all looked-up trigrams; None if the query has no character to look up."""
    whole, begins = wanted(index.postings.sparkSession, query, literal)
    if whole:
        lists = index.postings.filter(F.col("gram").isin(whole)).select("block", "places")
        n = len(whole)
    elif begins:
        holds = reduce(lambda a, b: a | b, [F.col("gram").startswith(b) for b in begins])
        piece = F.explode(F.filter(F.array(*map(F.lit, begins)), lambda b: F.startswith("gram", b)))
        one = index.postings.filter(holds).select("block", piece.alias("piece"), "places").groupBy("block", "piece")
        lists = one.agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
        n = len(begins)
    else:
        return None
    # Shortest first: what is left shrinks from the start.
    by_size = F.sort_array(F.collect_list(F.struct(F.size("places").alias("n"), "places")))
    both = F.aggregate(F.slice("lists", 2, n), F.col("lists")[0]["places"], lambda held, own: F.array_intersect(held, own["places"]))
    together = lists.groupBy("block").agg(by_size.alias("lists")).filter(F.size("lists") == n)
    return together.select("block", F.explode(both).alias("place"))


def matches(index: NameIndex, query: str, literal: bool = False) -> DataFrame:
    """``id, name`` of the names that contain the query, as :func:`contains_ci` has it."""
    match = contains_ci(F.col("name"), query, literal)
    found = candidates(index, query, literal)
    if found is None:
        return index.names.filter(match).select("id", "name")
    found = stored(found, "candidates")
    names = index.names
    spans = found.groupBy("block").agg(F.min("place").alias("low"), F.max("place").alias("high")).limit(NAMED_BLOCKS + 1).collect()
    if not spans:
        return names.filter("false").select("id", "name")
    if len(spans) <= NAMED_BLOCKS:
        place = F.col("place")
        names = names.filter(reduce(lambda a, b: a | b, [(F.col("block") == r["block"]) & place.between(r["low"], r["high"]) for r in spans]))
    return names.join(found, ["block", "place"], "left_semi").filter(match).select("id", "name")
