"""Trend tables kept up to date: additive states, moved on by the titles that changed.

What a title adds to the trend tables depends on the title alone: its decade and rating, its directors, its genres, and each name among
its actors once. So a state holds sums per decade, name and genre, and a change takes away what the changed titles added
before and adds what they add now. Counts, sums of tenths and distinct titles per name are all sums over titles; nothing
that did not change is read again.

A state is a folder with ``sums/`` (first all titles, then one folder a change) and numbered small files in ``state/``;
after ``DELTAS`` changes the sums are added up into one folder.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titlelake.catalog import Catalog
from titlelake.functions.numbers import decade, mean_2dp, tenths
from titlelake.functions.roles import CAST
from titlelake.operators.joins import attach, by_few_keys, moved
from titlelake.plans.analysis import CHART_TYPES
from titlelake.sources.shared import Files, stored

DELTAS = 8
# First years of the charts.
RATED_FROM, GENRES_FROM = 1890, 1950

SUMS = "kind string, name string, decade int, n bigint, tenths bigint, rated bigint"
MEASURES = ["n", "tenths", "rated"]
BY_TITLE = ["title", "rating", "principal", "title_genre"]


def _row(df: DataFrame, kind: str, name=None, dec=None, n=None, total=None, rated=None) -> DataFrame:
    null = F.lit(None)
    return df.select(
        F.lit(kind).alias("kind"), (null.cast("string") if name is None else F.col(name)).alias("name"),
        (null.cast("int") if dec is None else F.col(dec)).alias("decade"), (F.lit(1) if n is None else F.col(n)).cast("bigint").alias("n"),
        (F.lit(0) if total is None else F.coalesce(F.col(total), F.lit(0))).cast("bigint").alias("tenths"),
        (F.lit(0) if total is None else F.col(total).isNotNull() if rated is None else F.col(rated)).cast("bigint").alias("rated"),
    )


def added_by(cat: Catalog, titles: DataFrame | None = None) -> DataFrame:
    """What all titles, or those in ``titles`` (tconst), add to the states."""

    def of(name: str) -> DataFrame:
        return cat[name] if titles is None else by_few_keys(cat[name], "tconst", titles)

    rating = moved(of("rating").select("tconst", tenths(F.col("average_rating")).alias("tenths")))
    dated = of("title").filter("start_year is not null").select("tconst", "start_year", "title_type", decade(F.col("start_year")).alias("decade"))
    chart = dated.filter(F.col("title_type").isin(CHART_TYPES))
    credits = of("principal").select("tconst", "nconst", "category")
    named_links = attach(of("title_genre"), cat.genre, "genre_id", "tconst").select("tconst", "name")
    people = cat.person.select("nconst", "primary_name")

    directed = credits.filter("category = 'director'").join(rating, "tconst")
    per_person = directed.groupBy("nconst").agg(
        F.sum("tenths").alias("tenths"), F.count("tenths").alias("rated"), F.count(F.lit(1)).alias("n")
    )
    directors = per_person.join(moved(people), "nconst")

    acted = credits.filter(F.col("category").isin(CAST))
    per_credit = acted.join(rating, "tconst", "left").groupBy("tconst", "nconst")
    per_credit = per_credit.agg(F.sum("tenths").alias("tenths"), F.count("tenths").alias("rated"))
    actors = attach(per_credit, people, "nconst", "tconst", count_on=acted).groupBy("tconst", "primary_name")
    actors = actors.agg(F.sum("tenths").alias("tenths"), F.sum("rated").alias("rated"))

    rated_chart = chart.filter(F.col("start_year") >= RATED_FROM).join(rating, "tconst")
    parts = [
        _row(rated_chart, "rated", dec="decade", total="tenths"),
        _row(dated, "dated", dec="decade"),
        _row(directors, "director", "primary_name", n="n", total="tenths", rated="rated"),
        _row(named_links, "links", "name"),
        _row(chart.filter(F.col("start_year") >= GENRES_FROM).join(moved(named_links), "tconst"), "genre", "name", "decade"),
        _row(actors, "actor", "primary_name", total="tenths", rated="rated"),
    ]
    return _summed(reduce(DataFrame.unionByName, parts))


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("kind", "name", "decade").agg(*[F.sum(m).alias(m) for m in MEASURES])
    return sums.filter(" or ".join(f"{m} <> 0" for m in MEASURES))


def _state(spark: SparkSession, path: str) -> dict:
    files = Files(spark, path)
    numbers = [int(n) for n in files.names("state") if n.isdigit()]
    if not numbers:
        raise FileNotFoundError(f"no trend states in {path}")
    return json.loads(files.read(f"state/{max(numbers):08d}")) | {"number": max(numbers)}


def _write(spark: SparkSession, path: str, number: int, sums: DataFrame, kept: list[str]) -> int:
    name = uuid.uuid4().hex[:12]
    sums.write.parquet(f"{path}/sums/{name}")
    Files(spark, path).create(f"state/{number:08d}", json.dumps({"sums": [*kept, name]}))
    return number


def start(cat: Catalog, path: str) -> int:
    """Sum up all titles; returns the number of the state, 1."""
    return _write(cat.title.sparkSession, path, 1, added_by(cat), [])


def sums(spark: SparkSession, path: str) -> DataFrame:
    """The sums of the last state."""
    return _summed(spark.read.schema(SUMS).parquet(*[f"{path}/sums/{n}" for n in _state(spark, path)["sums"]]))


def changed_titles(before: Catalog, after: Catalog, rows: dict[str, DataFrame]) -> DataFrame:
    """Titles that differ, by the rows of each table that went or came: their own, and those of people and genres that changed."""
    found = [rows[name].select("tconst") for name in BY_TITLE if name in rows]
    for name, key, table in (("person", "nconst", "principal"), ("genre", "genre_id", "title_genre")):
        if name in rows:
            keys = stored(rows[name].select(key).distinct(), "keys")
            found += [by_few_keys(cat[table], key, keys).select("tconst") for cat in (before, after)]
    return reduce(DataFrame.unionByName, found).distinct()


def differing(removed: DataFrame, added: DataFrame) -> DataFrame:
    """The rows that went or came; one that is on both sides, as often, is neither."""
    columns = removed.columns
    both = removed.withColumn("_n", F.lit(-1)).unionByName(added.withColumn("_n", F.lit(1)))
    return both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").drop("_n")


def advance(before: Catalog, after: Catalog, path: str, rows: dict[str, DataFrame]) -> int:
    """Move the state on from one version of a catalogue to the next, given the differing rows by table; returns its number."""
    spark = before.title.sparkSession
    now = _state(spark, path)
    known = {name: df for name, df in rows.items() if name in (*BY_TITLE, "person", "genre")}
    if not known:
        return now["number"]
    titles = stored(changed_titles(before, after, known), "titles")
    gone, come = added_by(before, titles), added_by(after, titles)
    delta = _summed(come.unionByName(gone.withColumns({m: -F.col(m) for m in MEASURES})))
    if len(now["sums"]) >= DELTAS:
        return _write(spark, path, now["number"] + 1, _summed(sums(spark, path).unionByName(delta)), [])
    return _write(spark, path, now["number"] + 1, delta, now["sums"])


# The tables of :mod:`titlelake.plans.analysis`, from the sums alone.


def _total() -> Column:
    """The sum of tenths, null where nothing that has a value is in it."""
    return F.when(F.col("rated") > 0, F.col("tenths"))


def _of(state: DataFrame, kind: str) -> DataFrame:
    return state.filter(F.col("kind") == kind)


def ratings_by_decade(state: DataFrame) -> DataFrame:
    mean = mean_2dp(_total(), F.col("n")).alias("avg_rating")
    return _of(state, "rated").select("decade", mean, F.col("n").alias("titles_count")).orderBy("decade")


def decade_counts(state: DataFrame) -> DataFrame:
    return _of(state, "dated").select("decade", F.col("n").alias("titles_count")).orderBy("decade")


def top_directors(state: DataFrame, min_count: int = 5, k: int = 20) -> DataFrame:
    mean = mean_2dp(_total(), F.col("n")).alias("avg_director_rating")
    found = _of(state, "director").filter(F.col("n") >= min_count).select(F.col("name").alias("primary_name"), mean, F.col("n").alias("movie_count"))
    return found.orderBy(F.desc("avg_director_rating"), "primary_name").limit(k)


def genre_popularity(state: DataFrame, min_links: int = 1000) -> DataFrame:
    large = _of(state, "links").filter(F.col("n") >= min_links).select("name")
    found = _of(state, "genre").join(large, "name", "left_semi")
    return found.select(F.col("name").alias("genre"), "decade", F.col("n").alias("titles_count")).orderBy("genre", "decade")


def prolific_actors(state: DataFrame, min_titles: int = 20, k: int = 20) -> DataFrame:
    mean = mean_2dp(_total(), F.col("rated")).alias("avg_rating")
    found = _of(state, "actor").filter(F.col("n") >= min_titles).select(F.col("name").alias("primary_name"), F.col("n").alias("roles_count"), mean)
    return found.orderBy(F.desc("roles_count"), "primary_name").limit(k)
