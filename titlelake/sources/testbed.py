"""Adapter: the order and supplier test tables stand in for catalogue tables.

Orders play titles, suppliers people, line items credits, part brands genres and events
watch links. `titlelake.testing.oracle` holds the same definitions as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from titlelake.catalog import Catalog
from titlelake.operators.joins import attach, attach_few
from titlelake.operators.ranking import cap_per_group, first_per_key
from titlelake.plans.browse import genre_lists, named_credits, person_credits, with_rating

TYPES = ["movie", "tvSeries", "tvMovie", "tvEpisode", "videoGame"]
CATEGORIES = {
    "AF": "director", "AO": "writer", "RF": "actor", "RO": "actress", "NF": "producer", "NO": "composer",
}


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def ident(prefix: str, number: Column) -> Column:
    """An id of at least seven digits; longer numbers are kept whole."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(7), F.length(digits)), F.lit("0")))


def catalogue(spark: SparkSession, sf_dir: str) -> Catalog:
    ranged = {name: lambda make=make: make(spark, sf_dir) for name, make in _RANGED.items()}
    # Repeats of a credit are in the line items too; they are not taken out just to count people.
    counted = {"principal": lambda: credit_rows(spark, sf_dir)}
    return Catalog(lambda name: _TABLES[name](spark, sf_dir), ranged=ranged, counted=counted)


def _title(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    parts = part.select(F.count(F.lit(1))).scalar()
    key = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, TYPES)), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    year = F.year("o_orderdate") - 10 * (key % 12)
    numbered = orders.withColumn("p_partkey", key % parts)
    joined = attach(numbered, part.select("p_partkey", "p_name"), "p_partkey", "o_orderkey")
    return joined.select(
        ident("tt", key).alias("tconst"),
        kind.alias("title_type"),
        F.concat_ws(" ", "p_name", key.cast("string")).alias("primary_title"),
        F.col("p_name").alias("original_title"),
        (key % 50 == 0).alias("is_adult"),
        F.when(key % 17 != 0, year).cast("smallint").alias("start_year"),
        F.when((key % 17 != 0) & (kind == "tvSeries"), year + 3).cast("smallint").alias("end_year"),
        F.when(key % 13 != 0, key % 240 + 1).cast("int").alias("runtime_minutes"),
        F.when(key % 3 == 0, F.concat(F.lit("/p"), key.cast("string"), F.lit(".jpg"))).alias("poster_url"),
    )


def _person(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    born = 1900 + key % 100
    return table(spark, sf_dir, "supplier").select(
        ident("nm", key).alias("nconst"),
        F.col("s_name").alias("primary_name"),
        born.cast("smallint").alias("birth_year"),
        F.when(key % 4 == 0, born + 60).cast("smallint").alias("death_year"),
    )


CREDIT_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _credits(items: DataFrame) -> DataFrame:
    category = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair]),
        F.concat("l_returnflag", "l_linestatus"),
    )
    role = F.concat(F.lit('["Role '), F.col("l_partkey").cast("string"), F.lit('"]'))
    job = F.concat(F.lit("job "), F.col("l_partkey").cast("string"))
    return items.select(
        ident("tt", F.col("l_orderkey")).alias("tconst"),
        F.col("l_linenumber").cast("smallint").alias("ordering"),
        ident("nm", F.col("l_suppkey")).alias("nconst"),
        category.alias("category"),
        F.when(F.col("l_linenumber") % 2 == 0, job).alias("job"),
        F.when(category.isin("actor", "actress"), role).alias("characters"),
        *CREDIT_ORDER,
    )


def credit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as credits, repeats of (tconst, ordering) included."""
    return _credits(table(spark, sf_dir, "lineitem"))


def _principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = first_per_key(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in CREDIT_ORDER]
    )
    return _credits(items).drop(*CREDIT_ORDER)


def _principal_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in ranges of their key: its rows meet there, so the first is taken without another shuffle."""
    rows = credit_rows(spark, sf_dir).repartitionByRange("tconst", "ordering")
    return first_per_key(rows, ["tconst", "ordering"], [F.col(c) for c in CREDIT_ORDER]).drop(*CREDIT_ORDER)


def _genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    # There are a few brands at any scale; each query derives them anew, so they aren't stored.
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return names.select(F.row_number().over(Window.orderBy("name")).alias("genre_id"), "name")


def _genre_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands =table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name")
    )
    coded = attach_few(brands, _genre(spark, sf_dir), "name", "l_partkey").drop("name")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return attach(items, coded, "l_partkey", "l_orderkey").select("l_orderkey", "genre_id")


def _title_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _genre_pairs(spark, sf_dir).distinct().select(ident("tt", F.col("l_orderkey")).alias("tconst"), "genre_id")


def _title_genre_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in ranges, where repeats of a pair meet."""
    pairs = _genre_pairs(spark, sf_dir).select(ident("tt", F.col("l_orderkey")).alias("tconst"), "genre_id")
    return pairs.repartitionByRange("tconst", "genre_id").distinct()


def _rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenths = F.col("o_orderkey") * 37 % 91 + 10
    return (
        table(spark, sf_dir, "orders")
        .filter("o_orderstatus <> 'P'")
        .select(
            ident("tt", F.col("o_orderkey")).alias("tconst"),
            (tenths.cast("decimal(5,0)") * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(3,1)").alias(
                "average_rating"
            ),
            F.floor("o_totalprice").cast("int").alias("num_votes"),
        )
    )


def _episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    series = (
        orders.filter(F.col("o_orderpriority").startswith("2"))
        .groupBy("o_custkey")
        .agg(F.min("o_orderkey").alias("parent"))
    )
    parts = orders.filter(F.col("o_orderpriority").startswith("4")).select(
        "o_custkey", "o_orderkey", "o_orderdate"
    )
    joined = attach(parts, series, "o_custkey", "o_orderkey")
    return joined.select(
        ident("tt", F.col("o_orderkey")).alias("tconst"),
        ident("tt", F.col("parent")).alias("parent_tconst"),
        F.when(F.month("o_orderdate") != 12, F.year("o_orderdate") - 1994).cast("smallint").alias(
            "season_number"
        ),
        (F.col("o_orderkey") % 24 + 1).cast("smallint").alias("episode_number"),
    )


def link_changes(events: DataFrame) -> DataFrame:
    """Events as watch-link changes, in the order of ``ts, event_id``.

    Some lack a platform or a url: errors of low value, and events of low value.
    """
    return events.select(
        ident("tt", F.col("user_id")).alias("tconst"),
        F.when(~((F.col("event_type") == "error") & (F.col("value") < 2)), F.col("event_type")).alias("platform"),
        F.when(F.col("value") < 1, "")
        .otherwise(F.concat(F.lit("https://watch.example/"), F.col("event_id").cast("string")))
        .alias("url"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


def _streaming_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    links = first_per_key(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return links.select(
        ident("tt", F.col("user_id")).alias("tconst"),
        F.col("event_type").alias("platform"),
        F.concat(F.lit("https://watch.example/"), F.col("event_id").cast("string")).alias("url"),
    )


_TABLES = {
    "title": _title,
    "person": _person,
    "episode": _episode,
    "principal": _principal,
    "genre": _genre,
    "title_genre": _title_genre,
    "rating": _rating,
    "streaming_link": _streaming_link,
}

# Tables whose repeats meet in ranges of their key, so that a save moves them once.
_RANGED = {"principal": _principal_ranged, "title_genre": _title_genre_ranged}


# Raw dump rows ----------------------------------------------------------------------


def _token(value: Column, missing: str = "\\N") -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def raw_titles(cat: Catalog) -> DataFrame:
    """Rows of a title dump. Genre lists carry spaces, a blank entry and a repeated name."""
    lists = genre_lists(cat.title_genre, cat.genre)
    names = F.array_join("genre_names", ", ")
    return cat.title.join(lists, "tconst", "left").select(
        "tconst",
        F.col("title_type").alias("titleType"),
        F.col("primary_title").alias("primaryTitle"),
        F.concat(F.lit('"'), "original_title", F.lit("\\")).alias("originalTitle"),
        F.when(F.col("is_adult"), "1").when(F.col("runtime_minutes").isNull(), "\\N").otherwise("0").alias("isAdult"),
        _token(F.col("start_year")).alias("startYear"),
        _token(F.col("end_year"), "").alias("endYear"),
        _token(F.col("runtime_minutes")).alias("runtimeMinutes"),
        _token(F.concat(names, F.lit(", ,"), F.get("genre_names", F.lit(0)))).alias("genres"),
    )


def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a rating dump; a pending order has one of the two values missing."""
    pending = F.col("o_orderstatus") == "P"
    tenths = F.col("o_orderkey") * 37 % 91 + 10
    odd = F.col("o_orderkey") % 2 == 1
    text = (tenths.cast("decimal(5,0)") * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(3,1)").cast("string")
    return table(spark, sf_dir, "orders").select(
        ident("tt", F.col("o_orderkey")).alias("tconst"),
        F.when(pending & odd, "\\N").otherwise(text).alias("averageRating"),
        F.when(pending & ~odd, "").otherwise(F.floor("o_totalprice").cast("string")).alias("numVotes"),
    )


def raw_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a person dump; a supplier in debt has no name."""
    key = F.col("s_suppkey")
    born = 1900 + key % 100
    return table(spark, sf_dir, "supplier").select(
        ident("nm", key).alias("nconst"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_name")).otherwise("").alias("primaryName"),
        born.cast("string").alias("birthYear"),
        F.when(key % 4 == 0, (born + 60).cast("string")).otherwise("\\N").alias("deathYear"),
        F.lit("actor,producer").alias("primaryProfession"),
        F.lit("\\N").alias("knownForTitles"),
    )


def raw_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a credit dump, with composers of no category and tabs in the texts."""
    rows = credit_rows(spark, sf_dir)
    return rows.withColumns(
        {
            "ordering": F.col("ordering").cast("string"),
            "category": F.when(F.col("category") == "composer", "\\N").otherwise(F.col("category")),
            "job": _token(F.translate("job", " ", "\t")),
            "characters": _token(F.translate("characters", " ", "\n"), ""),
        }
    )


def raw_episodes(cat: Catalog) -> DataFrame:
    return cat.episode.select(
        "tconst",
        F.col("parent_tconst").alias("parentTconst"),
        _token(F.col("season_number")).alias("seasonNumber"),
        _token(F.col("episode_number")).alias("episodeNumber"),
    )


def solvent_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People without the suppliers in debt, so that some credits lack their person."""
    return _person(spark, sf_dir).join(
        table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(
            ident("nm", F.col("s_suppkey")).alias("nconst")
        ),
        "nconst",
        "left_semi",
    )


# Payloads ---------------------------------------------------------------------------

# Per credit category: job and department; a missing department is left out.
JOBS = {
    "director": ("Director", "Directing"),
    "writer": ("Story", "Writing"),
    "producer": ("Producer", "Production"),
    "composer": ("Composer", None),
}


#: Titles by number whose roles of one person make one payload.
TITLES_PER_PART = 20_000


def _local(value: Column) -> Column:
    """The number in an id."""
    return F.substring(value, 3, 20).cast("bigint")


def _date(year: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-06-15"))


def _kind(title_type: Column) -> Column:
    return F.when(title_type == "tvSeries", "tv").otherwise("movie")


def title_payloads(cat: Catalog) -> DataFrame:
    """One payload per title with its credits, watch providers and similar titles."""
    job = F.create_map(*[F.lit(x) for c, (name, _) in JOBS.items() for x in (c, name)])
    dept = F.create_map(*[F.lit(x) for c, (_, name) in JOBS.items() for x in (c, name)])
    # What follows from a credit's columns is made after its title's credits have met, so only these columns move.
    credit = F.struct("ordering", "category", "nconst", "name", "characters")
    members = F.transform(
        F.collect_list(credit),
        lambda c: F.struct(
            c["ordering"].alias("ordering"),
            c["category"].alias("category"),
            _local(c["nconst"]).alias("id"),
            c["name"].alias("name"),
            F.get_json_object(c["characters"], "$[0]").alias("character"),
            F.when(c["ordering"] % 2 == 1, F.concat(F.lit("/f"), c["nconst"], F.lit(".jpg"))).alias("profile_path"),
            F.try_element_at(job, c["category"]).alias("job"),
            F.try_element_at(dept, c["category"]).alias("department"),
        ),
    )
    credits = named_credits(cat, cat.principal).groupBy("tconst").agg(F.array_sort(members).alias("people"))
    links = cat.streaming_link.groupBy("tconst").agg(F.array_sort(F.collect_set("platform")).alias("platforms"))
    genres = genre_lists(cat.title_genre, cat.genre)
    is_tv = F.col("title_type") == "tvSeries"
    offers = F.transform(
        "platforms",
        lambda p: F.struct(p.alias("provider_name"), F.concat(F.lit("/l"), p, F.lit(".png")).alias("logo_path")),
    )
    none = F.array().cast("array<struct<provider_name:string,logo_path:string>>")
    # The first country lists no providers, the second repeats the first of its own.
    countries = F.create_map(
        F.lit("US"),
        F.struct(F.lit("https://us.example").alias("link"), none.alias("flatrate"), none.alias("rent")),
        F.lit("GB"),
        F.struct(F.lit("https://gb.example").alias("link"), offers.alias("flatrate"), F.slice(offers, 1, 1).alias("rent")),
    )
    item = F.struct(
        _local(F.col("tconst")).alias("id"),
        F.when(~is_tv, F.col("primary_title")).alias("title"),
        F.when(is_tv, F.col("primary_title")).alias("name"),
        F.when(~is_tv, F.col("original_title")).alias("original_title"),
        F.when(is_tv, F.col("original_title")).alias("original_name"),
        F.when(~is_tv, _date(F.col("start_year"))).alias("release_date"),
        F.when(is_tv, _date(F.col("start_year"))).alias("first_air_date"),
        F.coalesce("runtime_minutes", F.lit(0)).alias("runtime"),
        F.when(is_tv, F.array(F.lit(45), F.lit(50))).alias("episode_run_time"),
        F.col("poster_url").alias("poster_path"),
        F.when(F.col("is_adult"), F.concat(F.lit("/b"), "tconst")).alias("backdrop_path"),
        F.col("average_rating").cast("double").alias("vote_average"),
        F.col("num_votes").alias("vote_count"),
        F.transform("genre_names", lambda g: F.struct(F.length(g).alias("id"), g.alias("name"))).alias("genres"),
        F.col("is_adult").alias("adult"),
        F.struct(
            F.transform(
                F.filter("people", lambda p: p["category"].isin("actor", "actress")),
                lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["character"].alias("character"), p["profile_path"].alias("profile_path")),
            ).alias("cast"),
            F.transform(
                F.filter("people", lambda p: p["job"].isNotNull()),
                lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["job"].alias("job"), p["department"].alias("department")),
            ).alias("crew"),
        ).alias("credits"),
        F.struct(F.when(F.col("platforms").isNotNull(), countries).alias("results")).alias("watch/providers"),
        F.struct(
            F.transform(
                "genre_names",
                lambda g, i: F.struct(i.alias("id"), g.alias("title"), F.concat(g, F.lit(" series")).alias("name")),
            ).alias("results")
        ).alias("similar"),
    )
    return (
        with_rating(cat.title, cat.rating, "left")
        .join(credits, "tconst", "left")
        .join(links, "tconst", "left")
        .join(genres, "tconst", "left")
        .select(F.col("tconst").alias("key"), _kind(F.col("title_type")).alias("media_type"), F.to_json(item).alias("payload"))
    )


def person_payloads(cat: Catalog) -> DataFrame:
    """Each person's data as part 0, and all roles as further parts, one for every ``TITLES_PER_PART`` titles.

    A part is bounded by its titles, however many roles a person has.
    """
    is_tv = F.col("title_type") == "tvSeries"
    role = F.struct(
        _local(F.col("tconst")).alias("id"),
        _kind(F.col("title_type")).alias("media_type"),
        F.when(~is_tv, F.col("primary_title")).alias("title"),
        F.when(is_tv, F.col("primary_title")).alias("name"),
        F.when(~is_tv, _date(F.col("start_year"))).alias("release_date"),
        F.when(is_tv, _date(F.col("start_year"))).alias("first_air_date"),
        F.col("average_rating").cast("double").alias("vote_average"),
        F.get_json_object("characters", "$[0]").alias("character"),
    )
    roles = person_credits(cat).select("nconst", "tconst", "ordering", role.alias("role"))
    in_order = F.array_sort(F.collect_list(F.struct("tconst", "ordering", "role")))
    listed = F.transform("rows", lambda r: r["role"])

    known = cap_per_group(roles, ["nconst"], [F.col("tconst"), F.col("ordering")], 3)
    known = known.groupBy("nconst").agg(in_order.alias("rows")).select("nconst", listed.alias("known_for"))
    person = F.struct(
        _local(F.col("nconst")).alias("id"),
        F.lit("person").alias("media_type"),
        F.col("primary_name").alias("name"),
        F.when(F.col("death_year").isNull(), F.concat(F.lit("/f"), "nconst", F.lit(".jpg"))).alias("profile_path"),
        "known_for",
    )
    people = cat.person.join(known, "nconst", "left").select("nconst", F.lit(0).cast("long").alias("part"), F.to_json(person).alias("payload"))

    part = (F.floor(_local(F.col("tconst")) / TITLES_PER_PART) + 1).alias("part")
    credits = roles.groupBy("nconst", part).agg(in_order.alias("rows"))
    body = F.struct(_local(F.col("nconst")).alias("id"), F.struct(listed.alias("cast")).alias("combined_credits"))
    parts = people.unionByName(credits.select("nconst", "part", F.to_json(body).alias("payload")))
    return parts.select(F.col("nconst").alias("key"), "part", F.lit(None).cast("string").alias("media_type"), "payload")


def response_payloads(cat: Catalog) -> DataFrame:
    """Response pages of a mixed search: titles and people by number, 20 numbers a page, latest first."""
    is_tv = F.col("title_type") == "tvSeries"
    number = _local(F.col("tconst"))
    titles = cat.title.select(
        number.alias("id"),
        F.when(F.col("title_type") == "videoGame", "game").otherwise(_kind(F.col("title_type"))).alias("media_type"),
        F.when(~is_tv, F.col("primary_title")).alias("title"),
        F.when(is_tv, F.col("primary_title")).alias("name"),
        F.lit(None).cast("string").alias("profile_path"),
    )
    people = cat.person.select(
        _local(F.col("nconst")).alias("id"),
        F.lit("person").alias("media_type"),
        F.lit(None).cast("string").alias("title"),
        F.col("primary_name").alias("name"),
        F.concat(F.lit("/f"), "nconst").alias("profile_path"),
    )
    entry = F.struct((-F.col("id")).alias("back"), "media_type", "id", "title", "name", "profile_path")
    # Ids are unique within a table: at most 40 entries a page.
    pages = titles.unionByName(people).groupBy(F.floor(F.col("id") / 20).alias("page")).agg(
        F.array_sort(F.collect_list(entry)).alias("rows")
    )
    body = F.struct(
        F.transform("rows", lambda r: r.dropFields("back")).alias("results"),
        F.col("page").alias("page"),
        (F.col("page") * 10).alias("total_pages"),
        F.when(F.col("page") % 2 == 0, F.size("rows")).alias("total_results"),
    )
    return pages.select(F.col("page").cast("string").alias("key"), F.to_json(body).alias("payload"))


def lookup_payloads(cat: Catalog) -> DataFrame:
    """A poster lookup response per title; every eleventh is broken."""
    number = _local(F.col("tconst"))

    def entry(path: Column) -> Column:
        return F.struct(path.alias("poster_path"))

    def poster(letter: str) -> Column:
        return F.concat(F.lit(f"/{letter}"), number.cast("string"))

    none = F.lit(None).cast("string")
    body = F.struct(
        F.when(F.col("title_type") == "movie", F.array(entry(F.when(number % 2 == 0, poster("m"))))).alias("movie_results"),
        F.array(entry(F.when(number % 5 == 0, poster("s")).otherwise(""))).alias("tv_results"),
        F.array(entry(F.when(number % 7 != 0, poster("e")).otherwise(none)), entry(poster("x"))).alias("tv_episode_results"),
    )
    text = F.to_json(body)
    broken = F.substr(text, F.lit(1), F.length(text) - 1)
    return cat.title.select(
        F.col("tconst").alias("key"), F.when(number % 11 == 0, broken).otherwise(text).alias("payload")
    )
