"""Browse queries: home lists, titles, credits, series, people, search, discover, links.

Queries about one title or person take ``None`` (all keys), a key, a list of keys or a
table of keys. Listings for many keys are sorted by key first; the sort columns end in
a unique key, so Spark's range partitioning also splits a single very frequent key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.catalog import Catalog
from titlelake.functions.media import NO_POSTER, platform_field
from titlelake.functions.roles import CAST, CREDIT_ROLES, CREW, FILMOGRAPHY_ROLES, role_rank
from titlelake.functions.text import contains_ci, prefix_ci
from titlelake.operators import merge
from titlelake.operators.grams import NameIndex, matches
from titlelake.operators.joins import attach, attach_few, by_few_keys, by_keys, moved
from titlelake.operators.ranking import cap_per_group, page, page_after, page_number
from titlelake.sources.shared import stored

Keys = None | str | list[str] | DataFrame

# Limits and defaults of the lists.
HOME_SIZE = 50
HOME_MIN_VOTES = 25000
PAGE_SIZE = 20
TOP_CAST = 5
DISCOVER_MIN_VOTES = 50

# A page or top list up to this many rows may be broadcast.
FEW_ROWS = 10_000

NOT_STANDALONE = ["tvEpisode", "videoGame"]
KIND_TYPES = {"movie": ["movie", "tvMovie"], "tv": ["tvSeries", "tvMiniSeries"]}

CARD = ["id", "title", "year", "runtime", "type", "poster", "rating", "votes"]
HOME = ["id", "title", "year", "runtime", "type", "rating", "votes", "genres"]


def with_rating(title: DataFrame, rating: DataFrame, how: str = "inner") -> DataFrame:
    return title.join(moved(rating), "tconst", how)


def adult_filter(title: DataFrame, include_adult: bool) -> DataFrame:
    return title if include_adult else title.filter(~F.col("is_adult"))


def cards(rated: DataFrame) -> DataFrame:
    """Card columns of titles joined to their ratings."""
    return rated.select(
        F.col("tconst").alias("id"),
        F.col("primary_title").alias("title"),
        F.col("start_year").alias("year"),
        F.col("runtime_minutes").alias("runtime"),
        F.col("title_type").alias("type"),
        F.col("poster_url").alias("poster"),
        F.col("average_rating").alias("rating"),
        F.col("num_votes").alias("votes"),
    )


def join_names(names: Column) -> Column:
    return F.coalesce(F.array_join(F.array_sort(names), ", "), F.lit(""))


def genre_lists(title_genre: DataFrame, genre: DataFrame) -> DataFrame:
    """Sorted genre names per title: ``tconst, genre_names``.

    A title has at most one link per genre, which bounds the list.
    """
    named = attach_few(title_genre, genre, "genre_id", "tconst")
    return named.groupBy("tconst").agg(F.array_sort(F.collect_set("name")).alias("genre_names"))


def title_genres_string(cat: Catalog, ids: Keys = None) -> DataFrame:
    """Every title with its genre names as one sorted text, empty without genres."""
    lists = genre_lists(by_keys(cat.title_genre, "tconst", ids), cat.genre)
    return (
        by_keys(cat.title, "tconst", ids)
        .select("tconst")
        .join(lists, "tconst", "left")
        .select("tconst", join_names(F.col("genre_names")).alias("genres"))
    )


def with_genres(few: DataFrame, cat: Catalog, limit: int) -> DataFrame:
    """Add genre text to a page or top list of at most ``limit`` rows.

    The rows are broadcast over the title ids and the genre links, which therefore stay
    where they are; the title ids keep rows without any genre. A list with a larger
    limit is joined without the hint.
    """
    if limit <= FEW_ROWS:
        few = F.broadcast(few)
    links = cat.title_genre.select("tconst", "genre_id")
    marks = cat.title.select("tconst", F.lit(None).cast("int").alias("genre_id")).unionByName(links)
    found = marks.join(few, marks["tconst"] == few["id"]).drop("tconst")
    named = found.join(cat.genre, "genre_id", "left")
    return named.groupBy(*few.columns).agg(join_names(F.collect_set("name")).alias("genres"))


# Home -------------------------------------------------------------------------------


def _home(cat: Catalog, include_adult: bool, min_votes: int | None, order: list[Column], k: int) -> DataFrame:
    shown = adult_filter(cat.title, include_adult).filter(~F.col("title_type").isin(NOT_STANDALONE))
    rating = cat.rating if min_votes is None else cat.rating.filter(F.col("num_votes") >= min_votes)
    best = cards(with_rating(shown, rating)).orderBy(*order).limit(k)
    return with_genres(best, cat, k).orderBy(*order).select(HOME)


def home_top_rated(
    cat: Catalog, include_adult: bool = False, k: int = HOME_SIZE, min_votes: int = HOME_MIN_VOTES
) -> DataFrame:
    order = [F.desc("rating"), F.desc("votes"), F.asc("id")]
    return _home(cat, include_adult, min_votes, order, k)


def home_most_voted(cat: Catalog, include_adult: bool = False, k: int = HOME_SIZE) -> DataFrame:
    """Also the trending list of a catalogue."""
    return _home(cat, include_adult, None, [F.desc("votes"), F.asc("id")], k)


def hero_list(trending: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """The first ``n`` of a trending list, of which those with an image are kept."""
    has_image = F.lit(False)
    for image in ("backdrop", "poster"):
        if image in trending.columns:
            has_image = has_image | (F.coalesce(F.col(image), F.lit("")) != "")
    return trending.orderBy(*order).limit(n).filter(has_image)


def trending_cards(cat: Catalog, include_adult: bool = False, k: int = PAGE_SIZE) -> DataFrame:
    """The most voted titles with their poster."""
    shown = adult_filter(cat.title, include_adult).filter(~F.col("title_type").isin(NOT_STANDALONE))
    return cards(with_rating(shown, cat.rating)).orderBy(F.desc("votes"), F.asc("id")).limit(k)


# Titles and credits -----------------------------------------------------------------


def title_summary(cat: Catalog, ids: Keys = None) -> DataFrame:
    return with_rating(by_keys(cat.title, "tconst", ids), cat.rating, "left").select(
        "tconst", "primary_title", "original_title", "title_type", "start_year", "end_year",
        "runtime_minutes", "is_adult", "average_rating", "num_votes",
    )


def named_credits(cat: Catalog, principal: DataFrame) -> DataFrame:
    """Credits with the person's name; a person with very many credits is spread by title."""
    people = cat.person.select("nconst", F.col("primary_name").alias("name"))
    return attach(principal, people, "nconst", ["tconst", "ordering"], count_on=cat.to_count("principal"))


def title_crew(cat: Catalog, ids: Keys = None) -> DataFrame:
    """Directors and writers by billing."""
    crew = by_keys(cat.principal, "tconst", ids).filter(F.col("category").isin(CREW))
    return (
        named_credits(cat, crew)
        .select("tconst", "nconst", "name", "category", "ordering")
        .orderBy("tconst", "ordering")
    )


def top_cast(cat: Catalog, ids: Keys = None, n: int = TOP_CAST) -> DataFrame:
    """The first ``n`` billed actors and actresses of each title."""
    cast = by_keys(cat.principal, "tconst", ids).filter(F.col("category").isin(CAST))
    named = named_credits(cat, cast).select("tconst", "nconst", "name", "characters", "ordering")
    return cap_per_group(named, ["tconst"], [F.asc("ordering")], n)


def full_credits(cat: Catalog, ids: Keys = None, by_role: bool = True) -> DataFrame:
    """All credits of a title by role priority and billing, or by billing alone."""
    named = named_credits(cat, by_keys(cat.principal, "tconst", ids)).select(
        "tconst", "category", "nconst", "name", "job", "characters", "ordering"
    )
    rank = [role_rank(F.col("category"), CREDIT_ROLES)] if by_role else []
    return named.orderBy("tconst", *rank, "ordering")


# Series -----------------------------------------------------------------------------


def series_seasons(cat: Catalog, parents: Keys = None) -> DataFrame:
    return (
        by_keys(cat.episode, "parent_tconst", parents)
        .filter(F.col("season_number").isNotNull())
        .select("parent_tconst", "season_number")
        .distinct()
        .orderBy("parent_tconst", "season_number")
    )


def series_episodes(cat: Catalog, parents: Keys = None, season: int | None = None) -> DataFrame:
    """Episodes of one season, or of all seasons when none is given (0 is a season)."""
    wanted = by_keys(cat.episode, "parent_tconst", parents)
    if season is not None:
        wanted = wanted.filter(F.col("season_number") == season)
    title = cat.title.select("tconst", "primary_title", "start_year", "runtime_minutes")
    return (
        with_rating(wanted.join(title, "tconst"), cat.rating, "left")
        .select(
            "parent_tconst", "tconst", "primary_title", "season_number", "episode_number",
            "start_year", "runtime_minutes", "average_rating", "num_votes",
        )
        .orderBy(
            "parent_tconst", F.asc_nulls_last("season_number"), F.asc_nulls_last("episode_number"), "tconst"
        )
    )


# People -----------------------------------------------------------------------------


def person_info(cat: Catalog, ids: Keys = None) -> DataFrame:
    return by_keys(cat.person, "nconst", ids).select("nconst", "primary_name", "birth_year", "death_year")


def person_credits(cat: Catalog, ids: Keys = None) -> DataFrame:
    """Credits with their title and rating. Joined by title, so no person is gathered.

    Of people given by key the credits come from a copy sorted by person, if the catalogue has one, and then only their titles are read.
    """
    title = cat.title.select("tconst", "primary_title", "title_type", "start_year")
    copy = cat.clustered("principal", "nconst")
    if isinstance(ids, (str, list)) and copy is not cat.principal:
        credits = by_keys(copy, "nconst", ids)
        wanted = credits.select("tconst").distinct()
        found = credits.join(by_few_keys(title, "tconst", wanted), "tconst")
        return with_rating(found, by_few_keys(cat.rating, "tconst", wanted), "left")
    return with_rating(by_keys(cat.principal, "nconst", ids).join(title, "tconst"), cat.rating, "left")


FILMOGRAPHY = [
    "nconst", "category", "tconst", "primary_title", "title_type", "start_year",
    "average_rating", "num_votes", "characters", "job", "ordering",
]


def filmography(cat: Catalog, ids: Keys = None) -> DataFrame:
    """All credits of a person by role priority, then latest year first."""
    rank = role_rank(F.col("category"), FILMOGRAPHY_ROLES)
    return (
        person_credits(cat, ids)
        .select(FILMOGRAPHY)
        .orderBy("nconst", rank, F.desc_nulls_last("start_year"), "tconst", "ordering")
    )


def filmography_top(cat: Catalog, ids: Keys = None, n: int = 50) -> DataFrame:
    """The latest ``n`` credits of each person in each category."""
    order = [F.desc_nulls_last("start_year"), F.asc("tconst"), F.asc("ordering")]
    return cap_per_group(person_credits(cat, ids).select(FILMOGRAPHY), ["nconst", "category"], order, n)


# Search and discover ----------------------------------------------------------------


def check_query(query: str) -> str:
    query = query.strip()
    if len(query) < 2:
        raise ValueError("a search needs at least 2 characters")
    return query


def search_titles(
    cat: Catalog,
    query: str,
    number: int = 1,
    include_adult: bool = False,
    prefix_first: bool = True,
    literal: bool = False,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """Titles whose name contains the query, most voted first.

    ``prefix_first`` puts names that start with the query before all others.
    """
    query = check_query(query)
    found = cat.title.filter(contains_ci(F.col("primary_title"), query, literal))
    return _title_page(found, cat.rating, query, number, include_adult, prefix_first, literal, size)


def search_titles_indexed(
    cat: Catalog,
    index: NameIndex,
    query: str,
    number: int = 1,
    include_adult: bool = False,
    prefix_first: bool = True,
    literal: bool = False,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """As :func:`search_titles`, by an index of the titles' names: reads posting lists, and the titles found."""
    query = check_query(query)
    ids = stored(matches(index, query, literal).select("id"), "found")
    title, rating = by_few_keys(cat.title, "tconst", ids), by_few_keys(cat.rating, "tconst", ids)
    return _title_page(title, rating, query, number, include_adult, prefix_first, literal, size)


def _title_page(
    matching: DataFrame, rating: DataFrame, query: str, number: int, include_adult: bool, prefix_first: bool, literal: bool, size: int
) -> DataFrame:
    found = adult_filter(matching, include_adult).filter(F.col("title_type") != "tvEpisode")
    rows = cards(with_rating(found, rating, "left")).withColumn("result_type", F.lit("title"))
    order = [F.desc_nulls_last("votes"), F.asc("id")]
    if prefix_first:
        order.insert(0, F.when(prefix_ci(F.col("title"), query, literal), 0).otherwise(1))
    return page(rows, order, size, number)


def search_people(
    cat: Catalog,
    query: str,
    number: int = 1,
    prefix_first: bool = True,
    literal: bool = False,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """People whose name contains the query, by name."""
    query = check_query(query)
    found = cat.person.filter(contains_ci(F.col("primary_name"), query, literal))
    return _person_page(found, query, number, prefix_first, literal, size)


def search_people_indexed(
    cat: Catalog,
    index: NameIndex,
    query: str,
    number: int = 1,
    prefix_first: bool = True,
    literal: bool = False,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """As :func:`search_people`, by an index of the people's names."""
    query = check_query(query)
    ids = stored(matches(index, query, literal).select("id"), "found")
    return _person_page(by_few_keys(cat.person, "nconst", ids), query, number, prefix_first, literal, size)


def _person_page(matching: DataFrame, query: str, number: int, prefix_first: bool, literal: bool, size: int) -> DataFrame:
    found = matching.select(
        F.col("nconst").alias("id"),
        F.col("primary_name").alias("name"),
        "birth_year",
        "death_year",
        F.lit("person").alias("result_type"),
    )
    order = [F.asc("name"), F.asc("id")]
    if prefix_first:
        order.insert(0, F.when(prefix_ci(F.col("name"), query, literal), 0).otherwise(1))
    return page(found, order, size, number)


def search_all(titles: DataFrame, people: DataFrame) -> DataFrame:
    """Title and person results in one list; columns the other kind lacks are null."""
    return titles.unionByName(people, allowMissingColumns=True)


SORTS = {
    "popularity": [F.desc_nulls_last, "votes"],
    "rating": [F.desc_nulls_last, "rating"],
    "release_date": [F.desc_nulls_last, "year"],
    "votes": [F.desc_nulls_last, "votes"],
}


def sort_key(name: str) -> list[Column]:
    """Order of a known sort name; an unknown one sorts by popularity. Ties go by id."""
    direction, column = SORTS.get(name, SORTS["popularity"])
    return [direction(column), F.asc("id")]


def discover_rows(
    cat: Catalog,
    kind: str = "movie",
    genre: str | None = None,
    year: int | None = None,
    min_rating: float | None = None,
    include_adult: bool = False,
    min_votes: int = DISCOVER_MIN_VOTES,
) -> DataFrame:
    """All titles that pass the filters; a filter left out does not apply."""
    wanted = KIND_TYPES.get(kind, KIND_TYPES["movie"])
    title = adult_filter(cat.title, include_adult).filter(F.col("title_type").isin(wanted))
    rating = cat.rating.filter(F.col("num_votes") >= min_votes)
    if year is not None:
        title = title.filter(F.col("start_year") == year)
    if min_rating is not None:
        rating = rating.filter(F.col("average_rating") >= min_rating)
    if genre is not None:
        wanted_genre = cat.genre.filter(F.col("name") == genre).select("genre_id")
        links = cat.title_genre.join(wanted_genre, "genre_id", "left_semi")
        title = title.join(links, "tconst", "left_semi")
    return cards(with_rating(title, rating))


def discover(
    cat: Catalog, sort: str = "popularity", number: int = 1, size: int = PAGE_SIZE, **filters
) -> DataFrame:
    """One page of :func:`discover_rows` with genres."""
    order = sort_key(sort)
    before = (page_number(number) - 1) * size
    best = discover_rows(cat, **filters).orderBy(*order).offset(before).limit(size)
    return with_genres(best, cat, size).orderBy(*order).select(HOME)


def discover_after(
    cat: Catalog, last: list | None = None, sort: str = "popularity", size: int = PAGE_SIZE, **filters
) -> DataFrame:
    """The rows of :func:`discover_rows` after the one whose sort value and id are ``last``."""
    column = SORTS.get(sort, SORTS["popularity"])[1]
    return page_after(discover_rows(cat, **filters), [(column, True), ("id", False)], size, last)


def genre_list(cat: Catalog) -> DataFrame:
    return cat.genre.select(F.col("genre_id").alias("id"), "name").orderBy("name")


# Links and posters ------------------------------------------------------------------


def link_display(cat: Catalog, ids: Keys = None) -> DataFrame:
    """Watch links with icon and colour; an unknown platform gets the neutral pair."""
    return (
        by_keys(cat.streaming_link, "tconst", ids)
        .select(
            "tconst",
            "platform",
            "url",
            platform_field(F.col("platform"), 0).alias("icon"),
            platform_field(F.col("platform"), 1).alias("color"),
        )
        .orderBy("tconst", "platform")
    )


def title_poster(cat: Catalog, found: DataFrame, ids: Keys = None, placeholder: str = NO_POSTER) -> DataFrame:
    return merge.resolve_poster(by_keys(cat.title, "tconst", ids), found, placeholder)
