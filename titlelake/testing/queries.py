"""Every query by name, as a function of a session and a folder of test tables.

The functions only choose parameters and flatten: decimals become doubles, small
integers bigints and lists texts, so that results of both engines compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, ShortType

from titlelake.catalog import Catalog
from titlelake.functions import media, numbers, text
from titlelake.functions.roles import CREDIT_ROLES, FILMOGRAPHY_ROLES, role_rank
from titlelake.operators import checks, integrity, load, merge, ranking
from titlelake.plans import analysis, browse, documents, facets, payloads, trends
from titlelake.schemas import DUMPS, REQUIRED, TABLES
from titlelake.sources import dumps, testbed
from titlelake.sources.shared import shared_folder, stored, together
from titlelake.sources.tables import differences, load_catalog, load_search, merge_catalog, save_catalog, save_copies, save_search
from titlelake.streaming import dumps as stream_dumps
from titlelake.streaming import links, trending

Query = Callable[[SparkSession, str], DataFrame]

# Parameters under which no result is empty at the scale of the check.
DIRECTOR_MIN = 45
GENRE_MIN_LINKS = 2200
ACTOR_MIN_TITLES = 20
SEARCH = "ring"
PEOPLE_SEARCH = "000000"
AFTER = [200000, "tt0000500"]
GENRES_GONE = "Brand#1"
DISCOVER = {"kind": "movie", "genre": "Brand#2", "year": 1990, "min_rating": 5}

# Provider names of the link query: exact, longer, shorter, empty and unknown names.
PROVIDER_NAMES = [
    "Netflix", "Amazon Prime Video", "Disney Plus HD", "Apple TV", "YouTube Premium", " HULU ", "Max",
    "HBO Max Amazon Channel", "Peacock", "star", "", "Corner Store & Co", "Mubi", "Vudu (4K)!",
]


def comparable(df: DataFrame) -> DataFrame:
    """Numbers in the types both engines return alike."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    casts = {n: "double" for n, k in kinds.items() if isinstance(k, DecimalType)}
    casts |= {n: "bigint" for n, k in kinds.items() if isinstance(k, (ShortType, IntegerType))}
    return df.withColumns({n: F.col(f"`{n}`").cast(k) for n, k in casts.items()}) if casts else df


def listed(rows: Column, *fields: str) -> Column:
    """A list of structs as text, fields joined by ``:`` and entries by ``|``."""
    return F.array_join(
        F.transform(rows, lambda r: F.concat_ws(":", *[F.coalesce(r[f].cast("string"), F.lit("")) for f in fields])),
        "|",
    )


def _cat(spark: SparkSession, sf_dir: str) -> Catalog:
    return testbed.catalogue(spark, sf_dir)


def on_catalogue(query: Callable[[Catalog], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(query(testbed.catalogue(spark, sf_dir)))


# Loading ----------------------------------------------------------------------------


def dump_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "dump")
    dumps.write_dump(testbed.raw_titles(_cat(spark, sf_dir)), path, "title.basics")
    back = dumps.read_dump(spark, path, "title.basics")
    loaded = load.load_titles(back).drop("poster_url")
    return comparable(loaded.join(back.select("tconst", "genres"), "tconst"))


def load_clean_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["startYear", "endYear", "runtimeMinutes"]
    return load.clean_nulls(testbed.raw_titles(_cat(spark, sf_dir)), columns).select("tconst", *columns)


def load_scrub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.scrub_text(testbed.table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


def load_flag_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = testbed.raw_titles(_cat(spark, sf_dir))
    return raw.select("tconst", load.flag(F.col("isAdult")).alias("is_adult"))


def load_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = testbed.raw_titles(_cat(spark, sf_dir))
    return comparable(load.load_titles(raw.withColumn("primaryTitle", F.translate("primaryTitle", " ", "\t"))))


def load_genre_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.explode_genres(testbed.raw_titles(_cat(spark, sf_dir)))


def load_genre_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    links_ = load.explode_genres(testbed.raw_titles(_cat(spark, sf_dir)))
    return comparable(load.build_genre_dim(links_))


def load_title_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _cat(spark, sf_dir)
    return comparable(load.build_title_genre(load.explode_genres(testbed.raw_titles(cat)), cat.genre))


def load_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _cat(spark, sf_dir).title.filter("title_type <> 'videoGame'")
    return comparable(load.load_ratings(testbed.raw_ratings(spark, sf_dir), known))


def load_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(load.load_people(testbed.raw_people(spark, sf_dir)))


def load_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _cat(spark, sf_dir).title.filter("title_type <> 'videoGame'")
    order = [F.col(c) for c in testbed.CREDIT_ORDER]
    return comparable(
        load.load_principals(
            testbed.raw_principals(spark, sf_dir), known, testbed.solvent_people(spark, sf_dir), order
        )
    )


def load_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _cat(spark, sf_dir)
    return comparable(load.load_episodes(testbed.raw_episodes(cat), cat.title.filter("not is_adult")))


# Merging and checking ---------------------------------------------------------------


def old_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that exist before the changes: per user one that changes and one that stays."""
    users = testbed.table(spark, sf_dir, "events").select("user_id").distinct()
    platform = F.explode(F.array(F.lit("view"), F.lit("archive")))
    return users.select(testbed.ident("tt", F.col("user_id")).alias("tconst"), platform.alias("platform")).withColumn(
        "url", F.concat(F.lit("https://old.example/"), "tconst")
    )


def upsert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = merge.split_valid(testbed.link_changes(testbed.table(spark, sf_dir, "events")))
    return merge.upsert_latest(old_links(spark, sf_dir), valid, links.KEYS, links.newest())


def stream_upsert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared_folder(spark, "links")
    links.start_store(old_links(spark, sf_dir), store)
    schema = testbed.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    query = links.stream_upsert(testbed.link_changes(events), store, f"{store}/checkpoint")
    query.awaitTermination()
    return links.current_links(spark, store)


def stream_fold_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the changes, a fold, then the other half, older and newer ones mixed."""
    store, folded = shared_folder(spark, "links"), shared_folder(spark, "folded")
    links.start_store(old_links(spark, sf_dir), store)
    schema = testbed.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    for part, path in enumerate((store, folded)):
        changes = testbed.link_changes(events.filter(F.col("event_id") % 2 == part))
        links.stream_upsert(changes, path, f"{path}/checkpoint").awaitTermination()
        if path == store:
            links.fold(spark, store, folded)
    return links.current_links(spark, folded)


def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dumps in three batches: a third of each, by different rules, so that most rows wait for others."""
    store, incoming = shared_folder(spark, "load"), shared_folder(spark, "incoming")
    cat = _cat(spark, sf_dir)
    raw = {
        "title.basics": testbed.raw_titles(cat), "title.ratings": testbed.raw_ratings(spark, sf_dir), "name.basics": testbed.raw_people(spark, sf_dir),
        "title.principals": testbed.raw_principals(spark, sf_dir), "title.episode": testbed.raw_episodes(cat),
    }
    kept = together(spark, [partial(stored, rows.select(*DUMPS[dump]), "raw") for dump, rows in raw.items()])
    raw = dict(zip(raw, kept, strict=True))
    stream_dumps.start_load(spark, store)
    for part in range(3):
        parts = [(dump, rows.filter((F.crc32(rows.columns[0]) + shift) % 3 == part)) for shift, (dump, rows) in enumerate(raw.items())]
        together(spark, [partial(dumps.write_dump, rows, f"{incoming}/{dump}/part-{part}", dump) for dump, rows in parts])
        stream_dumps.stream_load(spark, incoming, store, f"{store}/checkpoint", [F.asc("nconst")]).awaitTermination()
    after = load_catalog(spark, f"{store}/catalogue")
    named = after.title_genre.join(after.genre, "genre_id")
    rows = [
        after.rating.select("tconst", F.lit("rating").alias("kind"), F.lit(None).cast("string").alias("other"), F.col("num_votes").alias("n")),
        after.principal.select("tconst", F.lit("credit").alias("kind"), F.col("nconst").alias("other"), F.col("ordering").cast("int").alias("n")),
        after.episode.select("tconst", F.lit("episode").alias("kind"), F.col("parent_tconst").alias("other"), F.col("episode_number").cast("int").alias("n")),
        named.select("tconst", F.lit("genre").alias("kind"), F.col("name").alias("other"), F.lit(None).cast("int").alias("n")),
        after.title.select("tconst", F.lit("title").alias("kind"), F.col("primary_title").alias("other"), F.col("start_year").cast("int").alias("n")),
    ]
    return comparable(reduce(DataFrame.unionByName, rows))


def trending_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per title and week, counted as a stream."""
    store = shared_folder(spark, "trending")
    schema = testbed.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    seen = events.select(testbed.ident("tt", F.col("user_id")).alias("tconst"), F.col("ts").cast("timestamp").alias("ts"))
    trending.stream_counts(seen, store, f"{store}/checkpoint").awaitTermination()
    week = F.floor(F.unix_seconds("start") / (7 * 86400))
    return trending.current_counts(spark, store).select("tconst", week.alias("week"), "views")


def link_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = merge.split_valid(testbed.link_changes(testbed.table(spark, sf_dir, "events")))
    return rejected.select("event_id", "tconst", "platform", "url")


def insert_missing_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _cat(spark, sf_dir)
    films = cat.title.filter("title_type = 'movie'").select("tconst")
    base = cat.principal.join(films, "tconst", "left_semi").withColumn("job", F.lit("kept"))
    order = [F.col(c) for c in testbed.CREDIT_ORDER]
    return comparable(
        merge.insert_missing(base, testbed.credit_rows(spark, sf_dir), ["tconst", "ordering"], order)
    )


def resolve_poster(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = testbed.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        testbed.ident("tt", F.col("o_orderkey")).alias("tconst"),
        F.concat(F.lit("https://found.example/"), F.col("o_orderkey").cast("string")).alias("found_url"),
    )
    return browse.title_poster(_cat(spark, sf_dir), found, placeholder="none")


def check_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(checks.check_pk(testbed.credit_rows(spark, sf_dir), ["tconst", "ordering"]))


def check_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = testbed.solvent_people(spark, sf_dir)
    return checks.check_fk(_cat(spark, sf_dir).principal, "nconst", people, "nconst")


def check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_unique(testbed.table(spark, sf_dir, "part").select("p_name"), "p_name")


def check_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = REQUIRED["title"] + ["start_year", "end_year", "runtime_minutes", "poster_url"]
    return checks.check_not_null(_cat(spark, sf_dir).title, columns)


def check_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = testbed.table(spark, sf_dir, "part").select(
        "p_name", "p_type", (F.col("p_retailprice").cast("decimal(12,2)") / 10).alias("average_rating")
    )
    return checks.check_domain(part, checks.length_rules({"p_name": 10, "p_type": 5}) | checks.rating_rules())


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _cat(spark, sf_dir).replace(person=testbed.solvent_people(spark, sf_dir))
    return checks.violations(cat, list(TABLES))


def _deleted(spark: SparkSession, sf_dir: str, cat: Catalog | None = None) -> Catalog:
    cat = cat or _cat(spark, sf_dir)
    debtors = cat.person.join(testbed.solvent_people(spark, sf_dir), "nconst", "left_anti").select("nconst")
    return merge.cascade_delete(cat, cat.title.filter("title_type = 'videoGame'").select("tconst"), debtors)


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_deleted(spark, sf_dir).principal.select("tconst", "ordering", "nconst"))


def cascade_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.table_counts(_deleted(spark, sf_dir), list(TABLES))


def cascade_genres(cat: Catalog) -> DataFrame:
    gone = cat.genre.filter(F.col("name").startswith(GENRES_GONE)).select("genre_id")
    return merge.cascade_delete(cat, genres=gone).title_genre


def reload_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save, delete with all that refers to it, save to the same store, load again."""
    store = shared_folder(spark, "catalogue")
    save_catalog(_cat(spark, sf_dir), store, list(TABLES))
    save_catalog(_deleted(spark, sf_dir, load_catalog(spark, store)), store, list(TABLES))
    return load.table_counts(load_catalog(spark, store), list(TABLES))


def _merged(spark: SparkSession, sf_dir: str, store: str, part: int, parts: int = 1) -> int:
    """Apply a part of the changes of :func:`merge_catalogue` to a saved catalogue.

    Even ratings of the part fall by one vote and to 5.0, every eleventh goes; every sixth number of an episode moves it
    to the first title, every fifth goes; every tenth person is renamed; video games of the part go, and their ratings stay.
    """
    cat = load_catalog(spark, store)

    def own(df: DataFrame, key: str) -> DataFrame:
        return df.filter(F.substring(key, 3, 20).cast("bigint") % parts == part)

    rating, episode, person = own(cat.rating, "tconst"), own(cat.episode, "tconst"), own(cat.person, "nconst")
    changes = {
        "rating": rating.filter("num_votes % 2 = 0").select(
            "tconst", F.lit(5).cast("decimal(3,1)").alias("average_rating"), (F.col("num_votes") - 1).alias("num_votes")
        ),
        "episode": episode.filter("episode_number % 6 = 0").withColumn("parent_tconst", F.lit("tt0000001")),
        "person": person.filter(F.col("nconst").endswith("0")).withColumn("primary_name", F.lit("Renamed")),
    }
    deletes = {
        "rating": rating.filter("num_votes % 11 = 0").select("tconst"),
        "episode": episode.filter("episode_number % 5 = 0").select("tconst"),
        "title": own(cat.title, "tconst").filter("title_type = 'videoGame'").select("tconst"),
    }
    return merge_catalog(spark, store, changes, deletes)


def merge_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings, episodes, titles and people after two merges into a saved catalogue."""
    store = shared_folder(spark, "catalogue")
    save_catalog(_cat(spark, sf_dir), store, ["title", "rating", "episode", "person"])
    for part in range(2):
        _merged(spark, sf_dir, store, part, 2)
    cat = load_catalog(spark, store)
    text = F.lit(None).cast("string")
    rows = [
        cat.rating.select("tconst", F.lit("rating").alias("kind"), text.alias("other"), F.col("num_votes").cast("bigint").alias("n"), F.col("average_rating").cast("double").alias("mean")),
        cat.episode.select("tconst", F.lit("episode").alias("kind"), F.col("parent_tconst").alias("other"), F.col("episode_number").cast("bigint").alias("n"), F.lit(None).cast("double").alias("mean")),
        cat.title.select("tconst", F.lit("title").alias("kind"), F.col("title_type").alias("other"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("double").alias("mean")),
        cat.person.select(F.col("nconst").alias("tconst"), F.lit("person").alias("kind"), F.col("primary_name").alias("other"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("double").alias("mean")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def violations_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of :func:`merge_catalogue`'s result by a state that the two merges have moved on."""
    store, state = shared_folder(spark, "catalogue"), shared_folder(spark, "integrity")
    save_catalog(_cat(spark, sf_dir), store, list(TABLES))
    integrity.start(load_catalog(spark, store), state)
    for part in range(2):
        number = _merged(spark, sf_dir, store, part, 2)
        integrity.advance(spark, state, *differences(spark, store, number - 1, number))
    return integrity.report(spark, state)


def trend_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trend tables of :func:`merge_catalogue`'s result by states that the two merges have moved on."""
    store, state = shared_folder(spark, "catalogue"), shared_folder(spark, "trends")
    save_catalog(_cat(spark, sf_dir), store, list(TABLES))
    trends.start(load_catalog(spark, store), state)
    for part in range(2):
        number = _merged(spark, sf_dir, store, part, 2)
        removed, added = differences(spark, store, number - 1, number)
        rows = {name: trends.differing(removed[name], added[name]) for name in removed}
        trends.advance(load_catalog(spark, store, number - 1), load_catalog(spark, store), state, rows)
    now = trends.sums(spark, state)
    tables = {
        "rated": trends.ratings_by_decade(now).select(F.lit(None).cast("string").alias("name"), "decade", F.col("titles_count").alias("n"), F.col("avg_rating").alias("mean")),
        "dated": trends.decade_counts(now).select(F.lit(None).cast("string").alias("name"), "decade", F.col("titles_count").alias("n"), F.lit(None).alias("mean")),
        "director": trends.top_directors(now, DIRECTOR_MIN).select(F.col("primary_name").alias("name"), F.lit(None).alias("decade"), F.col("movie_count").alias("n"), F.col("avg_director_rating").alias("mean")),
        "genre": trends.genre_popularity(now, GENRE_MIN_LINKS).select(F.col("genre").alias("name"), "decade", F.col("titles_count").alias("n"), F.lit(None).alias("mean")),
        "actor": trends.prolific_actors(now, ACTOR_MIN_TITLES).select(F.col("primary_name").alias("name"), F.lit(None).alias("decade"), F.col("roles_count").alias("n"), F.col("avg_rating").alias("mean")),
    }
    rows = [
        df.select(F.lit(kind).alias("kind"), "name", F.col("decade").cast("bigint").alias("decade"), F.col("n").cast("bigint").alias("n"), F.col("mean").cast("double").alias("mean"))
        for kind, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


# Texts that are searched by the index: usual, short, with wildcards, escaped, without a letter, not there.
INDEXED = [SEARCH, "re", "D_r%1", "D_\\r%1", "  e r ", "%%", "nowhere", "RING 1"]


def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of several searches by the index of a saved catalogue, and of one for people."""
    store = shared_folder(spark, "catalogue")
    save_catalog(_cat(spark, sf_dir), store, ["title", "rating", "person"])
    save_search(spark, store)
    cat, index = load_catalog(spark, store), load_search(spark, store)
    pages = [
        browse.search_titles_indexed(cat, index["title"], q, include_adult=True).select(
            F.lit(q).alias("query"), "place", "id", "title", "year", "rating", "votes", "has_more"
        )
        for q in INDEXED
    ]
    people = browse.search_people_indexed(cat, index["person"], PEOPLE_SEARCH).select(
        F.lit(PEOPLE_SEARCH).alias("query"), "place", "id", F.col("name").alias("title"), F.col("birth_year").alias("year"),
        F.lit(None).cast("decimal(3,1)").alias("rating"), F.lit(None).cast("int").alias("votes"), "has_more",
    )
    return comparable(reduce(DataFrame.unionByName, [*pages, people]))


# Filters of the facet query: none, each, and some together.
FACETS = [
    {}, {"genre": DISCOVER["genre"]}, {"year": DISCOVER["year"]}, {"min_rating": 7.5}, {"include_adult": True, "kind": "tv"},
    {"genre": DISCOVER["genre"], "year": DISCOVER["year"], "min_rating": 5, "include_adult": True},
]


def discover_facets(cat: Catalog) -> DataFrame:
    """Counts of all facets under several filters, by one index."""
    index = stored(facets.build(cat), "facets")
    return reduce(
        DataFrame.unionByName,
        [facets.discover_facets(index, **wanted).select(F.lit(str(i)).alias("filters"), "facet", "value", "titles") for i, wanted in enumerate(FACETS)],
    )


def page_jumps(cat: Catalog) -> DataFrame:
    """Pages of a stored listing of all films by votes: the first, some in the middle, the last, and one beyond."""
    spark, listing = cat.title.sparkSession, shared_folder(cat.title.sparkSession, "listing")
    rows = browse.discover_rows(cat).select("id", "title", "votes")
    ranking.save_listing(rows, [F.desc("votes"), F.asc("id")], listing)
    last = -(-rows.count() // browse.PAGE_SIZE)
    pages = [ranking.page_jump(spark, listing, browse.PAGE_SIZE, n).withColumn("page", F.lit(n).cast("bigint")) for n in (1, 2, last // 2, last, last + 1)]
    return reduce(DataFrame.unionByName, pages).dropDuplicates(["page", "place"])


def filmography_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credits of two people by a copy of the credits that is sorted by person."""
    store = shared_folder(spark, "catalogue")
    save_catalog(_cat(spark, sf_dir), store, ["title", "rating", "principal", "title_genre", "episode", "person"])
    save_copies(spark, store)
    cat = load_catalog(spark, store)
    return comparable(browse.filmography(cat, ["nm0000001", "nm0000007"]))


def stream_compacted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes in six batches, merged into runs after every second, and once more at the end."""
    store, source = shared_folder(spark, "links"), shared_folder(spark, "events")
    links.start_store(old_links(spark, sf_dir), store)
    events = testbed.table(spark, sf_dir, "events")
    events.repartition(6, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    links.stream_upsert(testbed.link_changes(stream), store, f"{store}/checkpoint", compact_every=2).awaitTermination()
    links.compact(spark, store)
    links.vacuum(spark, store)
    return links.current_links(spark, store)


# Documents, texts and payloads ------------------------------------------------------


def title_documents(cat: Catalog) -> DataFrame:
    return documents.title_documents(cat, placeholder="none").select(
        "id", "title", "original_title", "media_type", "year", "end_year", "runtime", "adult", "poster",
        "rating", "votes",
        F.array_join("genres", "|").alias("genres"),
        listed(F.col("directors"), "id", "name", "category").alias("directors"),
        listed(F.col("writers"), "id", "name", "category").alias("writers"),
        listed(F.col("cast"), "id", "name", "character").alias("cast_list"),
    )


def credits_by_category(cat: Catalog) -> DataFrame:
    group = F.posexplode_outer("credits").alias("place", "g")
    return documents.credits_by_category(cat).select("id", "title", group).select(
        "id", "title", "place", "g.category",
        listed(F.col("g.credits"), "ordering", "id", "name", "job", "characters").alias("credits"),
    )


def person_documents(cat: Catalog) -> DataFrame:
    group = F.posexplode_outer("filmography").alias("place", "g")
    return (
        documents.person_documents(cat)
        .select("id", "name", "birth_year", "death_year", group)
        .select(
            "id", "name", "birth_year", "death_year", "place", "g.category",
            listed(F.col("g.titles"), "id", "title", "media_type", "year", "rating", "character").alias("titles"),
        )
    )


def scalar_display(cat: Catalog) -> DataFrame:
    return browse.with_rating(cat.title, cat.rating, "left").select(
        "tconst",
        numbers.rating_text(F.col("average_rating")).alias("rating_text"),
        numbers.votes_text(F.col("num_votes")).alias("votes_text"),
        text.norm(F.concat(F.lit("  "), F.upper("primary_title"))).alias("normal"),
        text.is_local(F.col("tconst"), "tt").alias("is_title"),
        text.is_local(F.col("tconst"), "nm").alias("is_person"),
        text.year_of(F.concat(F.col("start_year").cast("string"), F.lit("-01-01"))).alias("year"),
        text.url_component(F.concat("primary_title", F.lit(" (a&b)!*'~/é"))).alias("encoded"),
    )


def short_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = testbed.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.shorten(F.col("text")).alias("overview"))


def character_first(cat: Catalog) -> DataFrame:
    return cat.principal.select(
        "tconst", "ordering", text.first_of_json(F.col("characters")).alias("character")
    )


def image_urls(cat: Catalog) -> DataFrame:
    path = F.col("poster_url")
    return cat.title.select(
        "tconst",
        media.image_url(path).alias("poster"),
        media.image_url(path, "w1280").alias("backdrop"),
        media.image_url(F.concat(F.lit("http://images.example"), path)).alias("absolute"),
    )


def provider_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, PROVIDER_NAMES))
    events = testbed.table(spark, sf_dir, "events").select(
        "event_id",
        testbed.ident("tt", F.col("user_id")).alias("tconst"),
        F.get(names, (F.col("event_id") % len(PROVIDER_NAMES)).cast("int")).alias("provider"),
    )
    title = _cat(spark, sf_dir).title.select("tconst", "primary_title")
    return events.join(title, "tconst").select(
        "event_id", "provider", media.provider_url(F.col("provider"), F.col("primary_title")).alias("link")
    )


TITLE_ITEM = [
    "title", "original_title", "media_type", "year", "runtime", "poster", "backdrop", "rating", "votes",
    "overview", "adult",
]


def payload_parsed(cat: Catalog) -> DataFrame:
    """Titles from payloads that were parsed and stored once."""
    spark = cat.title.sparkSession
    path = shared_folder(spark, "parsed")
    payloads.save_parsed(testbed.title_payloads(cat), path, payloads.TITLE_FIELDS)
    return _payload_titles(payloads.load_parsed(spark, path))


def payload_titles(cat: Catalog) -> DataFrame:
    return _payload_titles(testbed.title_payloads(cat))


def _payload_titles(table: DataFrame) -> DataFrame:
    return payloads.payload_titles(table).select(
        "key", "id", *TITLE_ITEM,
        F.size("genre_ids").alias("genre_ids"), F.array_join("genres", "|").alias("genres"),
    )


def payload_people(cat: Catalog) -> DataFrame:
    return payloads.payload_people(testbed.person_payloads(cat)).select(
        "key", "id", "name", "profile", "media_type", "known_for_department",
        listed(F.col("known_for"), "id", "title", "media_type", "year").alias("known_for"),
    )


def payload_crew(cat: Catalog) -> DataFrame:
    return payloads.payload_crew(testbed.title_payloads(cat)).select(
        "key",
        listed(F.col("directors"), "id", "name").alias("directors"),
        listed(F.col("writers"), "id", "name").alias("writers"),
    )


def payload_departments(cat: Catalog) -> DataFrame:
    return payloads.payload_departments(testbed.title_payloads(cat)).select(
        "key", "place", "department", listed(F.col("crew"), "id", "name", "job").alias("crew")
    )


def payload_providers(cat: Catalog) -> DataFrame:
    return payloads.payload_providers(testbed.title_payloads(cat)).select(
        "key", "watch_link", listed(F.col("providers"), "name", "logo").alias("providers")
    )


def payload_similar(cat: Catalog) -> DataFrame:
    similar = payloads.payload_similar(testbed.title_payloads(cat))
    return similar.select("key", "place", "id", "title", "media_type", "year", "adult")


def payload_documents(cat: Catalog) -> DataFrame:
    return payloads.payload_documents(testbed.title_payloads(cat)).select(
        "key", "id", "title", "media_type",
        listed(F.col("cast"), "id", "name", "character").alias("cast_list"),
        listed(F.col("directors"), "id", "name").alias("directors"),
        listed(F.col("writers"), "id", "name").alias("writers"),
        listed(F.col("providers"), "name", "logo").alias("providers"),
        listed(F.col("similar"), "id", "title").alias("similar_list"),
        "watch_link", "tagline", "status",
    )


def payload_credits(cat: Catalog) -> DataFrame:
    found = payloads.payload_credits(testbed.title_payloads(cat))
    groups = F.transform("crew", lambda g: F.concat(g["department"], F.lit("="), listed(g["crew"], "id", "name", "job")))
    return found.select(
        "key", "id", "title",
        listed(F.col("cast"), "id", "name", "character").alias("cast_list"),
        F.array_join(groups, ";").alias("departments"),
    )


def payload_person_documents(cat: Catalog) -> DataFrame:
    found = payloads.payload_person_documents(testbed.person_payloads(cat))
    return found.select(
        "key", "id", "name", "profile", "biography", "birthday", "deathday", "place_of_birth",
        "known_for_department", listed(F.col("filmography"), "id", "title", "year").alias("filmography"),
    )


def search_payloads(cat: Catalog) -> DataFrame:
    """Title and person payloads, some of an unknown kind, as one mixed result list."""
    titles = testbed.title_payloads(cat)
    named = F.concat(F.lit('{"media_type":"'), "media_type", F.lit('",'), F.substr("payload", F.lit(2)))
    episodes = cat.title.select(F.col("tconst").alias("key"), "title_type")
    kinds = titles.join(episodes, "key").withColumn(
        "media_type", F.when(F.col("title_type") == "videoGame", "game").otherwise(F.col("media_type"))
    )
    people = payloads.heads(testbed.person_payloads(cat)).drop("part")
    mixed = kinds.select("key", "media_type", named.alias("payload")).unionByName(people)
    return payloads.multi_results(mixed).select("key", "media_type", "id", "title", "name", "profile", "year")


def payload_results(cat: Catalog) -> DataFrame:
    found = payloads.payload_results(testbed.response_payloads(cat))
    return found.select("key", "place", "id", "media_type", "title", "name", "profile")


def payload_listing(cat: Catalog) -> DataFrame:
    """The first entries of each list, all taken as series."""
    found = payloads.payload_results(testbed.response_payloads(cat), "tv", 5)
    return found.select("key", "place", "id", "media_type", "title")


def payload_rejects(cat: Catalog) -> DataFrame:
    return payloads.rejects(testbed.lookup_payloads(cat)).select("key")


def poster_lookup(cat: Catalog) -> DataFrame:
    """Stored poster, else the one of the lookup response."""
    return browse.title_poster(cat, payloads.found_posters(testbed.lookup_payloads(cat)), placeholder="none")


def debtor_filmography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credits of a table of people."""
    cat = _cat(spark, sf_dir)
    debtors = cat.person.join(testbed.solvent_people(spark, sf_dir), "nconst", "left_anti").select("nconst")
    return comparable(browse.filmography(cat, debtors))


def series_documents(cat: Catalog) -> DataFrame:
    return documents.series_documents(cat).select(
        "id", "title", F.array_join(F.col("seasons").cast("array<string>"), "|").alias("seasons"), "season",
        listed(F.col("episodes"), "episode_number", "id", "title", "year", "runtime", "rating", "votes").alias("episodes"),
    )


def search_multi(cat: Catalog) -> DataFrame:
    return browse.search_all(
        browse.search_titles(cat, SEARCH).drop("has_more", "total_pages"),
        browse.search_people(cat, PEOPLE_SEARCH).drop("has_more", "total_pages"),
    )


def hero_list(cat: Catalog) -> DataFrame:
    order = [F.desc("votes"), F.asc("id")]
    return browse.hero_list(browse.trending_cards(cat), order)


# Queries of a catalogue, whatever tables it holds.
CATALOGUE_QUERIES: dict[str, Callable[[Catalog], DataFrame]] = {
    "table_counts": lambda cat: load.table_counts(cat, list(TABLES)),
    "home_top_rated": browse.home_top_rated,
    "home_most_voted": browse.home_most_voted,
    "home_with_adult": lambda cat: browse.home_top_rated(cat, include_adult=True, k=20),
    "hero_list": hero_list,
    "title_genres_string": browse.title_genres_string,
    "title_summary": browse.title_summary,
    "title_crew": browse.title_crew,
    "top_cast": browse.top_cast,
    "full_credits": lambda cat: browse.full_credits(cat).withColumn("rank", role_rank(F.col("category"), CREDIT_ROLES)),
    "series_seasons": browse.series_seasons,
    "series_episodes": lambda cat: browse.series_episodes(cat, season=3),
    "episodes_all_seasons": browse.series_episodes,
    "person_info": browse.person_info,
    "filmography": lambda cat: browse.filmography(cat).withColumn("rank", role_rank(F.col("category"), FILMOGRAPHY_ROLES)),
    "filmography_top50": browse.filmography_top,
    "filmography_top20": lambda cat: browse.filmography_top(cat, n=20),
    "search_titles": lambda cat: browse.search_titles(cat, SEARCH),
    "search_prefix_rank": lambda cat: browse.search_titles(cat, "re"),
    "search_titles_route": lambda cat: browse.search_titles(cat, SEARCH, prefix_first=False),
    "search_literal": lambda cat: browse.search_titles(cat, "D W", literal=True, include_adult=True),
    "search_backslash": lambda cat: browse.search_titles(cat, "D_\\r%1"),
    "search_wildcard": lambda cat: browse.search_titles(cat, "D_r%1"),
    "search_page2": lambda cat: browse.search_titles(cat, SEARCH, number=2),
    "search_people": lambda cat: browse.search_people(cat, PEOPLE_SEARCH, number=2),
    "search_multi": search_multi,
    "discover": lambda cat: browse.discover(cat, **DISCOVER),
    "discover_by_rating": lambda cat: browse.discover(cat, sort="rating", number=3, kind="tv"),
    "discover_after": lambda cat: browse.discover_after(cat, AFTER),
    "page_info": lambda cat: ranking.page_info(browse.discover_rows(cat), browse.PAGE_SIZE),
    "genre_list": browse.genre_list,
    "link_display": browse.link_display,
    "title_documents": title_documents,
    "person_documents": person_documents,
    "credits_by_category": credits_by_category,
    "ratings_by_decade": analysis.ratings_by_decade,
    "decade_counts": analysis.decade_counts,
    "top_directors": lambda cat: analysis.top_directors(cat, DIRECTOR_MIN),
    "genre_popularity": lambda cat: analysis.genre_popularity(cat, GENRE_MIN_LINKS),
    "prolific_actors": lambda cat: analysis.prolific_actors(cat, ACTOR_MIN_TITLES),
    "scalar_display": scalar_display,
    "character_first": character_first,
    "image_urls": image_urls,
    "payload_titles": payload_titles,
    "payload_parsed": payload_parsed,
    "payload_people": payload_people,
    "payload_cast": lambda cat: payloads.payload_cast(testbed.title_payloads(cat)),
    "payload_crew": payload_crew,
    "payload_departments": payload_departments,
    "payload_providers": payload_providers,
    "payload_filmography": lambda cat: payloads.payload_filmography(testbed.person_payloads(cat)),
    "payload_similar": payload_similar,
    "payload_documents": payload_documents,
    "payload_credits": payload_credits,
    "payload_person_documents": payload_person_documents,
    "search_payloads": search_payloads,
    "payload_results": payload_results,
    "payload_pages": lambda cat: payloads.response_pages(testbed.response_payloads(cat)),
    "payload_listing": payload_listing,
    "payload_rejects": payload_rejects,
    "poster_lookup": poster_lookup,
    "series_documents": series_documents,
    "cascade_genres": cascade_genres,
    "discover_facets": discover_facets,
    "page_jumps": page_jumps,
}

QUERIES: dict[str, Query] = {name: on_catalogue(query) for name, query in CATALOGUE_QUERIES.items()} | {
    "dump_roundtrip": dump_roundtrip,
    "load_clean_nulls": load_clean_nulls,
    "load_scrub_text": load_scrub_text,
    "load_flag_decode": load_flag_decode,
    "load_titles": load_titles,
    "load_genre_explode": load_genre_explode,
    "load_genre_dim": load_genre_dim,
    "load_title_genre": load_title_genre,
    "load_ratings": load_ratings,
    "load_people": load_people,
    "load_principals": load_principals,
    "load_episodes": load_episodes,
    "upsert_links": upsert_links,
    "stream_upsert_links": stream_upsert_links,
    "stream_fold_links": stream_fold_links,
    "insert_missing_principals": insert_missing_principals,
    "link_rejects": link_rejects,
    "trending_window": trending_window,
    "debtor_filmography": debtor_filmography,
    "resolve_poster": resolve_poster,
    "check_pk": check_pk,
    "check_fk": check_fk,
    "check_not_null": check_not_null,
    "check_unique": check_unique,
    "check_domain": check_domain,
    "violations": violations,
    "cascade_delete": cascade_delete,
    "cascade_delete_counts": cascade_delete_counts,
    "reload_catalogue": reload_catalogue,
    "merge_catalogue": merge_catalogue,
    "violations_delta": violations_delta,
    "trend_states": trend_states,
    "search_indexed": search_indexed,
    "stream_compacted_links": stream_compacted_links,
    "filmography_copy": filmography_copy,
    "stream_load": stream_load,
    "short_overviews": short_overviews,
    "provider_links": provider_links,
}
