"""Nested documents per title and per person, built for all keys at once.

Lists per title are bounded by the key (tconst, ordering): ``ordering`` is a smallint,
so a title has at most 65,536 credits however large the catalogue is. Lists per person
have no such bound and are capped before anything is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlelake.catalog import Catalog
from titlelake.functions.media import NO_POSTER
from titlelake.functions.roles import CAST, CREW
from titlelake.functions.text import filled
from titlelake.operators.joins import by_keys
from titlelake.plans.browse import Keys, filmography_top, genre_lists, named_credits, with_rating

CAST_SIZE = 15
ROLE_SIZE = 50


def nest_crew(rows: Column, category: str) -> Column:
    """Crew entries of one category, in the order of ``rows``."""
    return F.transform(
        F.filter(rows, lambda r: r["category"] == category),
        lambda r: F.struct(r["nconst"].alias("id"), r["name"].alias("name"), r["category"].alias("category")),
    )


def nest_by_role(rows: Column) -> Column:
    """Rows grouped into ``array<struct<category, credits>>``, categories in first-seen order."""
    seen = F.array_distinct(F.transform(rows, lambda r: r["category"]))
    return F.transform(
        seen,
        lambda c: F.struct(
            c.alias("category"), F.filter(rows, lambda r: r["category"] == c).alias("credits")
        ),
    )


def title_documents(cat: Catalog, ids: Keys = None, placeholder: str = NO_POSTER) -> DataFrame:
    """Title info with genres, directors, writers and the first cast members.

    One shuffle by title serves the cast cap, the nesting and the joins.
    """
    is_cast = F.col("category").isin(CAST)
    wanted = by_keys(cat.principal, "tconst", ids).filter(F.col("category").isin(CAST + CREW))
    # Cast first, so that the place of a cast row is its place among the cast.
    place = F.row_number().over(
        Window.partitionBy("tconst").orderBy(F.when(is_cast, 0).otherwise(1), "ordering")
    )
    kept = named_credits(cat, wanted).withColumn("_place", place).filter(~is_cast | (F.col("_place") <= CAST_SIZE))
    credits = kept.groupBy("tconst").agg(
        F.array_sort(F.collect_list(F.struct("ordering", "nconst", "name", "category", "characters"))).alias("rows")
    )
    empty_crew = F.array().cast("array<struct<id:string,name:string,category:string>>")
    empty_cast = F.array().cast("array<struct<id:string,name:string,character:string>>")
    cast = F.transform(
        F.filter("rows", lambda r: r["category"].isin(CAST)),
        lambda r: F.struct(r["nconst"].alias("id"), r["name"].alias("name"), r["characters"].alias("character")),
    )
    return (
        with_rating(by_keys(cat.title, "tconst", ids), cat.rating, "left")
        .join(genre_lists(by_keys(cat.title_genre, "tconst", ids), cat.genre), "tconst", "left")
        .join(credits, "tconst", "left")
        .select(
            F.col("tconst").alias("id"),
            F.col("primary_title").alias("title"),
            "original_title",
            F.col("title_type").alias("media_type"),
            F.col("start_year").alias("year"),
            "end_year",
            F.col("runtime_minutes").alias("runtime"),
            F.col("is_adult").alias("adult"),
            F.coalesce(filled(F.col("poster_url")), F.lit(placeholder)).alias("poster"),
            F.col("average_rating").alias("rating"),
            F.col("num_votes").alias("votes"),
            F.coalesce("genre_names", F.array().cast("array<string>")).alias("genres"),
            F.coalesce(nest_crew(F.col("rows"), "director"), empty_crew).alias("directors"),
            F.coalesce(nest_crew(F.col("rows"), "writer"), empty_crew).alias("writers"),
            F.coalesce(cast, empty_cast).alias("cast"),
        )
    )


def credits_by_category(cat: Catalog, ids: Keys = None) -> DataFrame:
    """Each title with all its credits by category, categories and credits in billing order."""
    entry = F.struct("ordering", "category", F.col("nconst").alias("id"), "name", "job", "characters")
    credits = (
        named_credits(cat, by_keys(cat.principal, "tconst", ids))
        .groupBy("tconst")
        .agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    )
    return (
        by_keys(cat.title, "tconst", ids)
        .join(credits, "tconst", "left")
        .select(
            F.col("tconst").alias("id"),
            F.col("primary_title").alias("title"),
            nest_by_role(F.coalesce("rows", F.array())).alias("credits"),
        )
    )


def series_documents(cat: Catalog, parents: Keys = None) -> DataFrame:
    """One row per title and season, with all seasons of the title and the season's episodes.

    Episodes of no season form a row of their own with a null season; a title without
    episodes has one row with empty lists. A row is as long as its season; the list of
    seasons is bounded, as a season is a smallint.
    """
    own = by_keys(cat.episode, "parent_tconst", parents)
    title = cat.title.select("tconst", "primary_title", "start_year", "runtime_minutes")
    entry = F.struct(
        F.col("episode_number").isNull().alias("_unnumbered"),
        F.col("episode_number").alias("episode_number"),
        F.col("tconst").alias("id"),
        F.col("primary_title").alias("title"),
        F.col("start_year").alias("year"),
        F.col("runtime_minutes").alias("runtime"),
        F.col("average_rating").alias("rating"),
        F.col("num_votes").alias("votes"),
    )
    season_rows = (
        with_rating(own.join(title, "tconst"), cat.rating, "left")
        .groupBy("parent_tconst", F.col("season_number").alias("season"))
        .agg(F.array_sort(F.collect_list(entry)).alias("rows"))
        .select(
            F.col("parent_tconst").alias("tconst"), "season",
            F.transform("rows", lambda r: r.dropFields("_unnumbered")).alias("episodes"),
        )
    )
    seasons = own.groupBy(F.col("parent_tconst").alias("tconst")).agg(
        F.array_sort(F.collect_set("season_number")).alias("seasons")
    )
    empty = F.array().cast(
        "array<struct<episode_number:smallint,id:string,title:string,year:smallint,runtime:int,rating:decimal(3,1),votes:int>>"
    )
    return (
        by_keys(cat.title, "tconst", parents)
        .select("tconst", "primary_title")
        .join(seasons, "tconst", "left")
        .join(season_rows, "tconst", "left")
        .select(
            F.col("tconst").alias("id"),
            F.col("primary_title").alias("title"),
            F.coalesce("seasons", F.array().cast("array<smallint>")).alias("seasons"),
            "season",
            F.coalesce("episodes", empty).alias("episodes"),
        )
    )


def person_documents(cat: Catalog, ids: Keys = None, n: int = ROLE_SIZE) -> DataFrame:
    """Person info with the latest ``n`` credits per category.

    Categories come in the order in which a list of all credits, latest first, meets them.
    """
    entry = F.struct(
        # These three fields sort the list: latest year first, no year last, then id.
        F.col("start_year").isNull().alias("_undated"),
        (-F.col("start_year").cast("int")).alias("_back"),
        F.col("tconst").alias("id"),
        "ordering",
        F.col("primary_title").alias("title"),
        F.col("title_type").alias("media_type"),
        F.col("start_year").alias("year"),
        F.col("average_rating").alias("rating"),
        F.col("characters").alias("character"),
    )
    groups = (
        filmography_top(cat, ids, n)
        .groupBy("nconst", "category")
        .agg(F.array_sort(F.collect_list(entry)).alias("titles"))
        .select("nconst", F.struct(F.get("titles", F.lit(0)).alias("first"), "category", "titles").alias("group"))
        .groupBy("nconst")
        .agg(F.array_sort(F.collect_list("group")).alias("groups"))
    )
    shown = F.transform(
        "groups",
        lambda g: F.struct(
            g["category"].alias("category"),
            F.transform(g["titles"], lambda t: t.dropFields("_undated", "_back", "ordering")).alias("titles"),
        ),
    )
    empty = F.array().cast(
        "array<struct<category:string,titles:array<struct<id:string,title:string,media_type:string,"
        "year:smallint,rating:decimal(3,1),character:string>>>>"
    )
    return (
        by_keys(cat.person, "nconst", ids)
        .join(groups, "nconst", "left")
        .select(
            F.col("nconst").alias("id"),
            F.col("primary_name").alias("name"),
            "birth_year",
            "death_year",
            F.coalesce(shown, empty).alias("filmography"),
        )
    )
