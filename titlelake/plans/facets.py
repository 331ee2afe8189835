"""Discover by bitmaps: filters are and-ed and or-ed before any join, and all facets are counted in one pass.

Titles are numbered; for each value of a facet the index holds, in blocks of 32,768 numbers, a bitmap of the titles that have it,
so no row is larger than four kilobytes, however frequent the value. A filter is the union of the bitmaps of
its values, the filters together are their intersection, and the count of a facet value is the size of its intersection with that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.catalog import Catalog
from titlelake.functions.numbers import decade, tenths
from titlelake.operators.ranking import placed
from titlelake.plans.browse import DISCOVER_MIN_VOTES, KIND_TYPES

#: Facets whose values are counted; the others are filters only.
SHOWN = ["kind", "genre", "decade", "adult"]

Filter = tuple[str, Column]


def build(cat: Catalog, min_votes: int = DISCOVER_MIN_VOTES) -> DataFrame:
    """The index ``facet, value, block, bits`` of all titles; ``voted`` says whether a title has enough votes to be shown."""
    numbered = placed(cat.title.select("tconst", "title_type", "start_year", "is_adult"), [F.asc("tconst")], "number")
    kind = F.array(*[F.when(F.col("title_type").isin(types), F.lit(name)) for name, types in KIND_TYPES.items()])
    text = lambda c: c.cast("string")
    own = F.array(
        F.struct(F.lit("adult").alias("facet"), text(F.col("is_adult")).alias("value")),
        F.struct(F.lit("year").alias("facet"), text(F.col("start_year")).alias("value")),
        F.struct(F.lit("decade").alias("facet"), text(decade(F.col("start_year"))).alias("value")),
    )
    rated = F.array(
        F.struct(F.lit("rating").alias("facet"), text(tenths(F.col("average_rating"))).alias("value")),
        F.struct(F.lit("voted").alias("facet"), text(F.col("num_votes") >= min_votes).alias("value")),
    )
    numbers = numbered.select("tconst", "number")
    named = cat.title_genre.join(cat.genre, "genre_id").select("tconst", "name").distinct()
    rows = [
        numbered.select("number", F.inline(own)),
        numbered.select("number", F.lit("kind").alias("facet"), F.explode(kind).alias("value")),
        cat.rating.join(numbers, "tconst").select("number", F.inline(rated)),
        named.join(numbers, "tconst").select("number", F.lit("genre").alias("facet"), F.col("name").alias("value")),
    ]
    marked = reduce(DataFrame.unionByName, rows).filter("value is not null")
    return marked.groupBy("facet", "value", F.bitmap_bucket_number("number").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def filters(
    kind: str = "movie", genre: str | None = None, year: int | None = None, min_rating: float | None = None, include_adult: bool = False
) -> list[Filter]:
    """The filters of :func:`browse.discover_rows` as (facet, condition on its value)."""
    value = F.col("value")
    found: list[Filter] = [("kind", value == (kind if kind in KIND_TYPES else "movie")), ("voted", value == "true")]
    if not include_adult:
        found.append(("adult", value == "false"))
    if genre is not None:
        found.append(("genre", value == genre))
    if year is not None:
        found.append(("year", value == str(year)))
    if min_rating is not None:
        found.append(("rating", value.cast("int") >= F.ceil(F.lit(min_rating).cast("decimal(6,3)") * 10)))
    return found


def selected(index: DataFrame, wanted: list[Filter]) -> DataFrame:
    """``block, bits`` of the titles that pass all filters."""
    holds = [(F.col("facet") == facet) & condition for facet, condition in wanted]
    number = reduce(lambda rest, i: F.when(holds[i], i).otherwise(rest), range(len(holds)), F.lit(-1))
    either = index.withColumn("filter", number).filter(F.col("filter") >= 0)
    each = either.groupBy("filter", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = each.groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("met"))
    return both.filter(F.col("met") == len(holds)).select("block", "bits")


def count_titles(index: DataFrame, wanted: list[Filter]) -> DataFrame:
    return selected(index, wanted).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("titles"))


def discover_facets(index: DataFrame, **wanted) -> DataFrame:
    """``facet, value, titles``: how many of the titles that pass the filters have each value, values without one left out."""
    found = selected(index, filters(**wanted)).withColumnRenamed("bits", "passing")
    shown = index.filter(F.col("facet").isin(SHOWN))
    pair = shown.join(found, "block").select("facet", "value", "block", F.explode(F.array("bits", "passing")).alias("bits"))
    both = pair.groupBy("facet", "value", "block").agg(F.bitmap_and_agg("bits").alias("bits"))
    return both.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("titles")).filter("titles > 0")
