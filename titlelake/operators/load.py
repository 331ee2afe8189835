"""Load jobs: raw dump rows (all text) to typed catalogue tables.

``lenient=False`` casts strictly, so a malformed number fails the load;
``lenient=True`` turns it into null and :func:`quarantine` lists the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.catalog import Catalog
from titlelake.functions.text import clean, scrub
from titlelake.operators.joins import attach, attach_few, moved
from titlelake.operators.merge import upsert_latest
from titlelake.operators.ranking import first_per_key, number_by

NUMBERS = {
    "title.basics": {"startYear": "smallint", "endYear": "smallint", "runtimeMinutes": "int"},
    "title.ratings": {"averageRating": "decimal(3,1)", "numVotes": "int"},
    "name.basics": {"birthYear": "smallint", "deathYear": "smallint"},
    "title.principals": {"ordering": "smallint"},
    "title.episode": {"seasonNumber": "smallint", "episodeNumber": "smallint"},
}


def clean_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: clean(F.col(c)) for c in columns})


def scrub_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: scrub(F.col(c)) for c in columns})


def flag(raw: Column) -> Column:
    """``"1"`` is true, anything else false."""
    return F.coalesce(raw == "1", F.lit(False))


def number(raw: str, kind: str, lenient: bool = False) -> Column:
    value = clean(F.col(raw))
    return value.try_cast(kind) if lenient else value.cast(kind)


def quarantine(raw: DataFrame, dump: str) -> DataFrame:
    """Raw rows with a number that does not parse."""
    bad = [
        clean(F.col(c)).isNotNull() & number(c, kind, lenient=True).isNull()
        for c, kind in NUMBERS[dump].items()
    ]
    return raw.filter(reduce(Column.__or__, bad))


def load_titles(raw: DataFrame, lenient: bool = False) -> DataFrame:
    kinds = NUMBERS["title.basics"]
    return raw.select(
        "tconst",
        clean(F.col("titleType")).alias("title_type"),
        scrub(clean(F.col("primaryTitle"))).alias("primary_title"),
        scrub(clean(F.col("originalTitle"))).alias("original_title"),
        flag(F.col("isAdult")).alias("is_adult"),
        number("startYear", kinds["startYear"], lenient).alias("start_year"),
        number("endYear", kinds["endYear"], lenient).alias("end_year"),
        number("runtimeMinutes", kinds["runtimeMinutes"], lenient).alias("runtime_minutes"),
        F.lit(None).cast("string").alias("poster_url"),
    )


def explode_genres(raw: DataFrame) -> DataFrame:
    """One row ``tconst, name`` per non-blank entry of the comma list, repeats included."""
    names = F.transform(F.split(clean(F.col("genres")), ","), lambda name: F.trim(name))
    return raw.select("tconst", F.explode(names).alias("name")).filter("name <> ''")


def build_genre_dim(links: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Genre ids in the order of the names; known names keep their ids, new ones follow."""
    names = links.select("name").distinct()
    if existing is None:
        return number_by(names, "name", "genre_id").select("genre_id", "name")
    fresh = number_by(names.join(existing, "name", "left_anti"), "name", "genre_id")
    highest = existing.select(F.coalesce(F.max("genre_id"), F.lit(0))).scalar()
    return existing.unionByName(
        fresh.select((F.col("genre_id") + highest).cast("int").alias("genre_id"), "name")
    )


def build_title_genre(links: DataFrame, genre: DataFrame) -> DataFrame:
    """Distinct title–genre pairs; names without an id are dropped."""
    return attach_few(links, genre, "name", "tconst").select("tconst", "genre_id").distinct()


def mark_known(raw: DataFrame, references: dict[str, DataFrame], mark: str) -> DataFrame:
    """Add whether the values of some columns are all among given keys, a table of unique keys by column.

    The rows move once per column, and Spark splits the partitions of a very frequent value.
    """
    marked, flags = raw, []
    for column, keys in references.items():
        flags.append(f"_known_{column}")
        known = keys.select(F.col(keys.columns[0]).alias(column), F.lit(True).alias(flags[-1]))
        marked = marked.join(moved(known), column, "left")
    return marked.select(*raw.columns, reduce(Column.__and__, [F.col(f).isNotNull() for f in flags]).alias(mark))


def rating_order() -> list[Column]:
    """More votes first, then the higher mean."""
    return [F.desc("num_votes"), F.desc("average_rating")]


def load_ratings(
    raw: DataFrame,
    title: DataFrame | None,
    existing: DataFrame | None = None,
    lenient: bool = False,
    order: list[Column] | None = None,
    repeated: bool = False,
) -> DataFrame:
    """Ratings with both values, of known titles, one per title.

    If a dump rates a title twice, the first in ``order`` counts, by default the one with
    more votes. Without ``title`` all rows are of known titles; ``repeated`` keeps all ratings of a title, for a merge to choose from.
    """
    kinds = NUMBERS["title.ratings"]
    rated = raw.select(
        "tconst",
        number("averageRating", kinds["averageRating"], lenient).alias("average_rating"),
        number("numVotes", kinds["numVotes"], lenient).alias("num_votes"),
    ).dropna()
    known = rated
    if title is not None:
        known = attach(rated, title.select("tconst"), "tconst", ["average_rating", "num_votes"], "left_semi")
    if repeated:
        return known
    order = order or rating_order()
    if existing is None:
        return first_per_key(known, ["tconst"], order)
    return upsert_latest(existing, known, ["tconst"], order)


def load_people(raw: DataFrame, lenient: bool = False) -> DataFrame:
    kinds = NUMBERS["name.basics"]
    return raw.select(
        "nconst",
        scrub(F.coalesce(clean(F.col("primaryName")), F.lit("Unknown"))).alias("primary_name"),
        number("birthYear", kinds["birthYear"], lenient).alias("birth_year"),
        number("deathYear", kinds["deathYear"], lenient).alias("death_year"),
    )


def load_principals(
    raw: DataFrame,
    title: DataFrame | None,
    person: DataFrame | None,
    order: list[Column],
    lenient: bool = False,
    repeated: bool = False,
) -> DataFrame:
    """Credits whose title and person exist; the first row in ``order`` per (tconst, ordering).

    ``order`` may use any raw column, for example a line number. Without ``title`` and ``person`` those of all rows are known;
    ``repeated`` keeps all rows of a key, for a merge to choose from.
    """
    kinds = NUMBERS["title.principals"]
    typed = raw.withColumns(
        {
            "ordering": number("ordering", kinds["ordering"], lenient),
            "category": F.coalesce(clean(F.col("category")), F.lit("unknown")),
            "job": scrub(clean(F.col("job"))),
            "characters": scrub(clean(F.col("characters"))),
        }
    )
    if lenient:
        typed = typed.filter("ordering is not null")
    known = typed
    if title is not None:
        known = attach(known, title.select("tconst"), "tconst", ["nconst", "ordering"], "left_semi", count_on=raw)
    if person is not None:
        known = attach(known, person.select("nconst"), "nconst", ["tconst", "ordering"], "left_semi", count_on=raw)
    if not repeated:
        known = first_per_key(known, ["tconst", "ordering"], order)
    return known.select("tconst", "ordering", "nconst", "category", "job", "characters")


def load_episodes(raw: DataFrame, title: DataFrame | None, lenient: bool = False) -> DataFrame:
    """Episodes whose own title and parent title exist; without ``title`` those of all rows do."""
    kinds = NUMBERS["title.episode"]
    typed = raw.select(
        "tconst",
        clean(F.col("parentTconst")).alias("parent_tconst"),
        number("seasonNumber", kinds["seasonNumber"], lenient).alias("season_number"),
        number("episodeNumber", kinds["episodeNumber"], lenient).alias("episode_number"),
    )
    if title is None:
        return typed
    own = typed.join(title.select("tconst"), "tconst", "left_semi")
    parents = title.select(F.col("tconst").alias("parent_tconst"))
    return attach(own, parents, "parent_tconst", "tconst", "left_semi", count_on=typed).select(*typed.columns)


def table_counts(cat: Catalog, names: list[str]) -> DataFrame:
    """Row count per table."""
    counts = [
        cat[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in names
    ]
    return reduce(DataFrame.unionByName, counts)


def load_all(
    dumps: dict[str, DataFrame], order: list[Column], lenient: bool = False, existing: Catalog | None = None
) -> Catalog:
    """The catalogue of a full set of dumps, without watch links.

    Keys of ``dumps`` are the dump names; ``order`` ranks repeated credits. With an
    ``existing`` catalogue its genres keep their ids and its ratings stay where the dumps
    have none.
    """
    title = load_titles(dumps["title.basics"], lenient)
    links = explode_genres(dumps["title.basics"])
    genre = build_genre_dim(links, existing.genre if existing else None)
    person = load_people(dumps["name.basics"], lenient)
    known = existing.rating.join(title.select("tconst"), "tconst", "left_semi") if existing else None
    return Catalog.of(
        {
            "title": title,
            "genre": genre,
            "title_genre": build_title_genre(links, genre),
            "person": person,
            "rating": load_ratings(dumps["title.ratings"], title, known, lenient),
            "principal": load_principals(dumps["title.principals"], title, person, order, lenient),
            "episode": load_episodes(dumps["title.episode"], title, lenient),
        }
    )
