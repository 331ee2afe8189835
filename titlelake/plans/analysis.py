"""Trend tables: ratings by decade, directors, genres, actors.

All are pre-aggregated before the join that brings in names, so a very frequent person
or genre is one row by then. Means come from whole-number sums, which add up exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.catalog import Catalog
from titlelake.functions.numbers import decade, mean_2dp, tenths
from titlelake.functions.roles import CAST
from titlelake.operators.joins import attach

CHART_TYPES = ["movie", "tvSeries", "tvMovie"]


def chart_titles(cat: Catalog, first_year: int) -> DataFrame:
    """Titles of the charts with their decade."""
    return cat.title.filter(
        (F.col("start_year") >= first_year) & F.col("title_type").isin(CHART_TYPES)
    ).select("tconst", decade(F.col("start_year")).alias("decade"))


def ratings_by_decade(cat: Catalog, first_year: int = 1890) -> DataFrame:
    rated = chart_titles(cat, first_year).join(
        cat.rating.select("tconst", tenths(F.col("average_rating")).alias("tenths")), "tconst"
    )
    rows = F.count(F.lit(1))
    return (
        rated.groupBy("decade")
        .agg(mean_2dp(F.sum("tenths"), rows).alias("avg_rating"), rows.alias("titles_count"))
        .orderBy("decade")
    )


def decade_counts(cat: Catalog) -> DataFrame:
    """Titles of any type per decade."""
    return (
        cat.title.filter(F.col("start_year").isNotNull())
        .groupBy(decade(F.col("start_year")).alias("decade"))
        .agg(F.count(F.lit(1)).alias("titles_count"))
        .orderBy("decade")
    )


def _group_columns(by: str) -> list[str]:
    if by not in ("primary_name", "nconst"):
        raise ValueError("people are grouped by primary_name or nconst")
    return ["primary_name"] if by == "primary_name" else ["nconst", "primary_name"]


def top_directors(cat: Catalog, min_count: int = 5, k: int = 20, by: str = "primary_name") -> DataFrame:
    """Best mean rating among directors with enough rated credits. Namesakes count as one."""
    group = _group_columns(by)
    directed = cat.principal.filter("category = 'director'").select("tconst", "nconst")
    rated = directed.join(cat.rating.select("tconst", tenths(F.col("average_rating")).alias("tenths")), "tconst")
    per_person = rated.groupBy("nconst").agg(
        F.sum("tenths").alias("tenths"), F.count(F.lit(1)).alias("movie_count")
    )
    return (
        per_person.join(cat.person.select("nconst", "primary_name"), "nconst")
        .groupBy(*group)
        .agg(F.sum("tenths").alias("tenths"), F.sum("movie_count").alias("movie_count"))
        .filter(F.col("movie_count") >= min_count)
        .select(*group, mean_2dp(F.col("tenths"), F.col("movie_count")).alias("avg_director_rating"), "movie_count")
        .orderBy(F.desc("avg_director_rating"), *group)
        .limit(k)
    )


def large_genres(cat: Catalog, min_links: int) -> DataFrame:
    """Names of the genres with enough links to titles of any type."""
    per_id = cat.title_genre.groupBy("genre_id").agg(F.count(F.lit(1)).alias("links"))
    return (
        per_id.join(cat.genre, "genre_id")
        .groupBy("name")
        .agg(F.sum("links").alias("links"))
        .filter(F.col("links") >= min_links)
        .select("name")
    )


def genre_popularity(cat: Catalog, min_links: int = 1000, first_year: int = 1950) -> DataFrame:
    """Titles per genre and decade, for the large genres."""
    per_id = (
        chart_titles(cat, first_year)
        .join(cat.title_genre, "tconst")
        .groupBy("genre_id", "decade")
        .agg(F.count(F.lit(1)).alias("titles"))
    )
    return (
        per_id.join(cat.genre, "genre_id")
        .join(large_genres(cat, min_links), "name", "left_semi")
        .groupBy(F.col("name").alias("genre"), "decade")
        .agg(F.sum("titles").alias("titles_count"))
        .orderBy("genre", "decade")
    )


def prolific_actors(cat: Catalog, min_titles: int = 20, k: int = 20, by: str = "primary_name") -> DataFrame:
    """Actors with the most distinct titles. Namesakes count as one.

    A title credited twice to one name counts once in ``roles_count`` and each time in
    the mean. Credits are first summed per person and title, then per name and title,
    and only those sums per name: no step gathers the credits of one name.
    """
    group = _group_columns(by)
    acted = cat.principal.filter(F.col("category").isin(CAST)).select("tconst", "nconst")
    rated = acted.join(
        cat.rating.select("tconst", tenths(F.col("average_rating")).alias("tenths")), "tconst", "left"
    )
    per_person = rated.groupBy("tconst", "nconst").agg(
        F.sum("tenths").alias("tenths"), F.count("tenths").alias("rated")
    )
    people = cat.person.select("nconst", "primary_name")
    named = attach(per_person, people, "nconst", "tconst", count_on=acted)
    per_title = named.groupBy("tconst", *group).agg(
        F.sum("tenths").alias("tenths"), F.sum("rated").alias("rated")
    )
    return (
        per_title.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("roles_count"),
            F.sum("tenths").alias("tenths"),
            F.sum("rated").alias("rated"),
        )
        .filter(F.col("roles_count") >= min_titles)
        .select(*group, "roles_count", mean_2dp(F.col("tenths"), F.col("rated")).alias("avg_rating"))
        .orderBy(F.desc("roles_count"), *group)
        .limit(k)
    )
