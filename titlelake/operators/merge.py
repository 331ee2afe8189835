"""Upserts, enrichment and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.catalog import Catalog
from titlelake.functions.media import NO_POSTER
from titlelake.functions.text import filled
from titlelake.operators.joins import attach
from titlelake.operators.ranking import first_per_key
from titlelake.schemas import REFERENCES


def upsert_latest(base: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Update wins: the first change per key in ``order`` replaces or joins the base rows.

    Changes are cut to one row per key before they meet the base, so their volume per
    key does not matter.
    """
    latest = first_per_key(changes, keys, order).select(*base.columns)
    return base.join(latest, keys, "left_anti").unionByName(latest)


def insert_missing(base: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing wins: the first change per key in ``order`` is added where the key is new."""
    first = first_per_key(changes, keys, order).select(*base.columns)
    return base.unionByName(first.join(base, keys, "left_anti"))


def link_is_valid() -> Column:
    """A watch link needs a platform and a url."""
    return F.coalesce((F.col("platform") != "") & (F.col("url") != ""), F.lit(False))


def split_valid(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected watch-link changes."""
    return changes.filter(link_is_valid()), changes.filter(~link_is_valid())


def one_poster(found: DataFrame) -> DataFrame:
    return found.groupBy("tconst").agg(F.min(filled(F.col("found_url"))).alias("found_url"))


def resolve_poster(title: DataFrame, found: DataFrame, placeholder: str = NO_POSTER) -> DataFrame:
    """Poster per title: the stored one, else the looked-up one, else a placeholder.

    ``found`` holds ``tconst, found_url``; of several for a title the smallest counts.
    """
    return title.join(one_poster(found), "tconst", "left").select(
        "tconst",
        F.coalesce(filled(F.col("poster_url")), filled(F.col("found_url")), F.lit(placeholder)).alias(
            "poster_url"
        ),
    )


def store_posters(title: DataFrame, found: DataFrame) -> DataFrame:
    """The title table with looked-up posters stored where none was."""
    stored = F.coalesce(filled(F.col("poster_url")), filled(F.col("found_url")))
    columns = title.columns
    return (
        title.join(one_poster(found), "tconst", "left")
        .withColumn("poster_url", stored)
        .select(*columns)
    )


def cascade_delete(
    cat: Catalog,
    titles: DataFrame | None = None,
    people: DataFrame | None = None,
    genres: DataFrame | None = None,
) -> Catalog:
    """The catalogue without the given titles, people and genres and without all rows that refer to them.

    ``titles`` has a ``tconst`` column, ``people`` an ``nconst`` and ``genres`` a ``genre_id`` column.
    """
    gone = {"title": titles, "person": people, "genre": genres}

    def kept(name: str) -> DataFrame:
        df = cat[name]
        if gone.get(name) is not None:
            key = gone[name].columns[0]
            df = df.join(gone[name].select(key).distinct(), key, "left_anti")
        for child, column, parent, key in REFERENCES:
            if child == name and gone.get(parent) is not None:
                keys = gone[parent].select(F.col(key).alias(column)).distinct()
                own = [c for c in df.columns if c != column]
                df = attach(df, keys, column, own, "left_anti", count_on=cat[name]).select(*cat[name].columns)
        return df

    return Catalog(kept)
