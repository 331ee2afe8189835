"""Nested JSON payloads of a title service, reshaped as one job over a payload table.

A payload table has the columns ``key, media_type, payload``: ``media_type`` (may be
null) overrides the kind named in the payload, ``payload`` is JSON text. A field missing
from the JSON and a field set to null are treated alike. Rows whose payload is no JSON
object are left out; :func:`rejects` lists them. Operators work within the row, so they don't
shuffle, and parse only the fields that they read.

A person's credits have no bound, so a table of people may come in parts: with a column
``part``, part 0 of a key holds the person's data and any part may hold credits, in the
order of parts. A list over all parts keeps the first entries of each part before any
row moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titlelake.functions.media import image_url
from titlelake.functions.text import filled, year_of
from titlelake.operators.ranking import cap_per_group

# Fields read from a payload.
ITEM = {
    "id": "bigint",
    "media_type": "string",
    "title": "string",
    "name": "string",
    "original_title": "string",
    "original_name": "string",
    "release_date": "string",
    "first_air_date": "string",
    "poster_path": "string",
    "backdrop_path": "string",
    "overview": "string",
    "vote_average": "double",
    "vote_count": "int",
    "runtime": "int",
    "episode_run_time": "array<int>",
    "genre_ids": "array<int>",
    "genres": "array<struct<id: int, name: string>>",
    "adult": "boolean",
}
_ITEMS = ", ".join(f"{name}: {kind}" for name, kind in ITEM.items())
_OFFERS = "array<struct<provider_name: string, logo_path: string>>"
_COUNTRY = f"struct<link: string, flatrate: {_OFFERS}, rent: {_OFFERS}, buy: {_OFFERS}>"
_CAST = "array<struct<id: bigint, name: string, profile_path: string, character: string>>"
_CREW = "array<struct<id: bigint, name: string, job: string, department: string>>"

TITLE_FIELDS = ITEM | {
    "tagline": "string",
    "status": "string",
    "number_of_seasons": "int",
    "credits": f"struct<cast: {_CAST}, crew: {_CREW}>",
    "watch/providers": f"struct<results: map<string, {_COUNTRY}>>",
    "similar": f"struct<results: array<struct<{_ITEMS}>>>",
}
PERSON_FIELDS = {
    "id": "bigint",
    "name": "string",
    "profile_path": "string",
    "known_for_department": "string",
    "biography": "string",
    "birthday": "string",
    "deathday": "string",
    "place_of_birth": "string",
    "known_for": f"array<struct<{_ITEMS}>>",
    "combined_credits": f"struct<cast: array<struct<{_ITEMS}, character: string>>>",
}
# An entry of a mixed list.
RESULT_FIELDS = ITEM | {name: PERSON_FIELDS[name] for name in ("profile_path", "known_for_department", "known_for")}
RESULT_KINDS = ["movie", "tv", "person"]
PERSON_ITEM = {"id": "bigint", "name": "string"} | {
    name: PERSON_FIELDS[name] for name in ("profile_path", "known_for_department", "known_for")
}
# Columns of a normal title and of a normal person that the other lacks.
TITLE_ONLY = [
    "title", "original_title", "year", "runtime", "poster", "backdrop", "rating", "votes", "overview",
    "genre_ids", "genres", "adult",
]
PERSON_ONLY = ["name", "profile", "known_for_department", "known_for"]
# Lists of a lookup response, in the order in which they are asked for a poster.
LOOKUP_LISTS = ["movie_results", "tv_results", "tv_episode_results"]

# Countries tried for watch providers, writing jobs, list lengths.
COUNTRIES = ["US", "GB", "FR", "DE", "IN"]
WRITING_JOBS = ["Screenplay", "Writer", "Story"]
CAST_SIZE = 20
SIMILAR_SIZE = 10
FILMOGRAPHY_SIZE = 60


def schema_of(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def is_readable() -> Column:
    """Whether the payload is a JSON object."""
    return F.json_object_keys("payload").isNotNull()


def rejects(payloads: DataFrame) -> DataFrame:
    """The rows whose payload is missing, broken or no JSON object."""
    return payloads.filter("raw is null" if "raw" in payloads.columns else ~is_readable())


def parse(payloads: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Add the given fields of the parsed payload as the struct column ``raw``.

    A table of :func:`load_parsed` has them already; then only the columns of these fields are read.

    A payload that a query puts together is put together once a row: a filter would be moved below the column and make it again.
    """
    if "raw" not in payloads.columns:
        readable = F.when(is_readable(), F.array(F.from_json("payload", schema_of(fields))))
        return payloads.select("*", F.explode(readable).alias("raw"))
    if missing := set(fields) - set(payloads.schema["raw"].dataType.names):
        raise ValueError(f"the payloads were parsed without {', '.join(sorted(missing))}")
    return payloads.filter("raw is not null")


def save_parsed(payloads: DataFrame, path: str, fields: dict[str, str]) -> None:
    """Parse each payload once, for all jobs over the table: ``TITLE_FIELDS``, ``PERSON_FIELDS`` or others.

    The text is kept only where it is no JSON object.
    """
    parsed = payloads.withColumn("raw", F.when(is_readable(), F.from_json("payload", schema_of(fields))))
    parsed.withColumn("payload", F.when(F.col("raw").isNull(), F.col("payload"))).write.parquet(path)


def load_parsed(spark: SparkSession, path: str) -> DataFrame:
    """A table of payloads that :func:`save_parsed` has written; all jobs take it in place of the texts."""
    return spark.read.parquet(path)


def title_fields(*names: str) -> dict[str, str]:
    return {name: TITLE_FIELDS[name] for name in names}


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _list(value: Column) -> Column:
    return F.coalesce(value, F.array())


def normal_title(raw: Column, kind: Column | None = None) -> Column:
    """One title struct from a payload item: series and films use differently named fields."""
    named = F.coalesce(filled(raw["media_type"]), F.lit("movie"))
    kind = named if kind is None else F.coalesce(kind, named)
    is_tv = kind == "tv"

    def pick(tv: str, film: str) -> Column:
        return F.when(is_tv, raw[tv]).otherwise(raw[film])

    whole = F.when(raw["runtime"] != 0, raw["runtime"])
    per_episode = F.get(raw["episode_run_time"], F.lit(0))
    return F.struct(
        raw["id"].alias("id"),
        _text(pick("name", "title")).alias("title"),
        _text(pick("original_name", "original_title")).alias("original_title"),
        kind.alias("media_type"),
        year_of(pick("first_air_date", "release_date")).alias("year"),
        F.when(is_tv, F.coalesce(whole, per_episode)).otherwise(raw["runtime"]).alias("runtime"),
        image_url(raw["poster_path"]).alias("poster"),
        image_url(raw["backdrop_path"], "w1280").alias("backdrop"),
        raw["vote_average"].alias("rating"),
        raw["vote_count"].alias("votes"),
        _text(raw["overview"]).alias("overview"),
        _list(raw["genre_ids"]).alias("genre_ids"),
        F.transform(_list(raw["genres"]), lambda g: g["name"]).alias("genres"),
        F.coalesce(raw["adult"], F.lit(False)).alias("adult"),
    )


def normal_person(raw: Column) -> Column:
    return F.struct(
        raw["id"].alias("id"),
        _text(raw["name"]).alias("name"),
        image_url(raw["profile_path"], "w185").alias("profile"),
        F.lit("person").alias("media_type"),
        _text(raw["known_for_department"]).alias("known_for_department"),
        F.transform(_list(raw["known_for"]), lambda item: normal_title(item)).alias("known_for"),
    )


def normal_result(raw: Column) -> Column:
    """One struct for an entry of a mixed list; fields that its kind lacks are null."""
    is_person = raw["media_type"] == "person"
    title, person = normal_title(raw), normal_person(raw)
    return F.struct(
        raw["id"].alias("id"),
        raw["media_type"].alias("media_type"),
        *[F.when(~is_person, title[c]).alias(c) for c in TITLE_ONLY],
        *[F.when(is_person, person[c]).alias(c) for c in PERSON_ONLY],
    )


def cast_list(raw: Column, size: int | None = CAST_SIZE) -> Column:
    """Cast entries, the first ``size`` or all."""
    cast = _list(raw["credits"]["cast"])
    return F.transform(
        cast if size is None else F.slice(cast, 1, size),
        lambda c: F.struct(
            c["id"].alias("id"),
            c["name"].alias("name"),
            _text(c["character"]).alias("character"),
            image_url(c["profile_path"], "w185").alias("profile"),
        ),
    )


def crew_with_jobs(raw: Column, jobs: list[str]) -> Column:
    return F.transform(
        F.filter(_list(raw["credits"]["crew"]), lambda c: c["job"].isin(jobs)),
        lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name")),
    )


def crew_departments(raw: Column) -> Column:
    """Crew as ``array<struct<department, crew>>``, departments in first-seen order."""
    crew = F.transform(
        _list(raw["credits"]["crew"]),
        lambda c: F.struct(
            F.coalesce(c["department"], F.lit("Other")).alias("department"),
            F.struct(c["id"].alias("id"), c["name"].alias("name"), _text(c["job"]).alias("job")).alias("member"),
        ),
    )
    return F.transform(
        F.array_distinct(F.transform(crew, lambda c: c["department"])),
        lambda d: F.struct(
            d.alias("department"),
            F.transform(F.filter(crew, lambda c: c["department"] == d), lambda c: c["member"]).alias("crew"),
        ),
    )


def watch_options(raw: Column) -> Column:
    """Providers of the first country that has any, and the link of the last country looked at.

    A country without providers is passed over but, if listed, still leaves its link.
    Of several entries with one provider name the first is kept.
    """
    results = raw["watch/providers"]["results"]

    def country(code: str) -> Column:
        found = F.try_element_at(results, F.lit(code))
        offers = F.concat(_list(found["flatrate"]), _list(found["rent"]), _list(found["buy"]))
        listed = F.coalesce(
            found["link"].isNotNull() | found["flatrate"].isNotNull() | found["rent"].isNotNull() | found["buy"].isNotNull(),
            F.lit(False),
        )
        return F.struct(listed.alias("listed"), _text(found["link"]).alias("link"), offers.alias("offers"))

    visited = F.filter(F.array(*map(country, COUNTRIES)), lambda c: c["listed"])
    serving = F.get(F.filter(visited, lambda c: F.size(c["offers"]) > 0), F.lit(0))
    chosen = F.coalesce(serving, F.try_element_at(visited, F.lit(-1)))
    offers = F.transform(
        _list(chosen["offers"]),
        lambda p: F.struct(
            _text(p["provider_name"]).alias("name"), image_url(p["logo_path"], "w92").alias("logo")
        ),
    )
    names = F.transform(offers, lambda p: p["name"])
    first = F.filter(offers, lambda p, i: F.array_position(names, p["name"]) == i + 1)
    return F.struct(first.alias("providers"), _text(chosen["link"]).alias("watch_link"))


def dated_roles(raw: Column) -> Column:
    """A person's roles with their date, latest first and undated last, equal dates in payload order."""
    dated = F.transform(
        _list(raw["combined_credits"]["cast"]),
        lambda c, i: F.struct(
            _text(F.coalesce(filled(c["release_date"]), c["first_air_date"])).alias("date"),
            (-i).alias("back"),
            c.alias("role"),
        ),
    )
    return F.sort_array(dated, asc=False)


def role_entry(role: Column) -> Column:
    kind = F.coalesce(role["media_type"], F.lit("movie"))
    is_tv = kind == "tv"
    date = F.when(is_tv, role["first_air_date"]).otherwise(role["release_date"])
    return F.struct(
        role["id"].alias("id"),
        kind.alias("media_type"),
        _text(F.when(is_tv, role["name"]).otherwise(role["title"])).alias("title"),
        filled(F.substring(date, 1, 4)).alias("year"),
        _text(role["character"]).alias("character"),
        image_url(role["poster_path"]).alias("poster"),
        role["vote_average"].alias("rating"),
    )


def filmography_list(raw: Column, size: int = FILMOGRAPHY_SIZE) -> Column:
    """A person's latest roles, of one payload."""
    return F.transform(F.slice(dated_roles(raw), 1, size), lambda d: role_entry(d["role"]))


def similar_list(raw: Column, kind: Column, size: int = SIMILAR_SIZE) -> Column:
    return F.transform(
        F.slice(_list(raw["similar"]["results"]), 1, size), lambda item: normal_title(item, kind)
    )


# Jobs over a payload table ----------------------------------------------------------


def payload_titles(payloads: DataFrame) -> DataFrame:
    return (
        parse(payloads, ITEM)
        .select("key", normal_title(F.col("raw"), F.col("media_type")).alias("t"))
        .select("key", "t.*")
    )


def heads(payloads: DataFrame) -> DataFrame:
    """The rows with the person's data: all, where people don't come in parts."""
    return payloads.filter("part = 0") if "part" in payloads.columns else payloads


def payload_people(payloads: DataFrame) -> DataFrame:
    return parse(heads(payloads), PERSON_ITEM).select("key", normal_person(F.col("raw")).alias("p")).select("key", "p.*")


def payload_cast(payloads: DataFrame, size: int | None = CAST_SIZE) -> DataFrame:
    return (
        parse(payloads, title_fields("credits"))
        .select("key", F.posexplode(cast_list(F.col("raw"), size)).alias("place", "c"))
        .select("key", "place", "c.*")
    )


def payload_crew(payloads: DataFrame) -> DataFrame:
    """Directors and writers as two lists."""
    raw = F.col("raw")
    return parse(payloads, title_fields("credits")).select(
        "key",
        crew_with_jobs(raw, ["Director"]).alias("directors"),
        crew_with_jobs(raw, WRITING_JOBS).alias("writers"),
    )


def payload_departments(payloads: DataFrame) -> DataFrame:
    return (
        parse(payloads, title_fields("credits"))
        .select("key", F.posexplode(crew_departments(F.col("raw"))).alias("place", "d"))
        .select("key", "place", "d.*")
    )


def payload_providers(payloads: DataFrame) -> DataFrame:
    found = parse(payloads, title_fields("watch/providers"))
    return found.select("key", watch_options(F.col("raw")).alias("w")).select("key", "w.*")


def payload_filmography(payloads: DataFrame, size: int = FILMOGRAPHY_SIZE) -> DataFrame:
    parsed = parse(payloads, {"combined_credits": PERSON_FIELDS["combined_credits"]})
    if "part" not in payloads.columns:
        listed = parsed.select("key", F.posexplode(filmography_list(F.col("raw"), size)).alias("place", "f"))
        return listed.select("key", "place", "f.*")
    latest = parsed.select("key", "part", F.explode(F.slice(dated_roles(F.col("raw")), 1, size)).alias("d")).select(
        "key", "part", "d.*"
    )
    order = [F.desc("date"), F.col("part"), F.desc("back")]
    few = cap_per_group(latest, ["key"], order, size)
    place = F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1
    return few.select("key", place.alias("place"), role_entry(F.col("role")).alias("f")).select("key", "place", "f.*")


def payload_similar(payloads: DataFrame) -> DataFrame:
    return (
        parse(payloads, title_fields("similar"))
        .select("key", F.posexplode(similar_list(F.col("raw"), F.col("media_type"))).alias("place", "s"))
        .select("key", "place", "s.*")
    )


def payload_documents(payloads: DataFrame) -> DataFrame:
    """The whole title page: info with cast, crew, providers and similar titles."""
    raw, kind = F.col("raw"), F.col("media_type")
    return (
        parse(payloads, TITLE_FIELDS)
        .select(
            "key",
            normal_title(raw, kind).alias("t"),
            cast_list(raw).alias("cast"),
            crew_with_jobs(raw, ["Director"]).alias("directors"),
            crew_with_jobs(raw, WRITING_JOBS).alias("writers"),
            watch_options(raw).alias("w"),
            similar_list(raw, kind).alias("similar"),
            _text(raw["tagline"]).alias("tagline"),
            _text(raw["status"]).alias("status"),
            raw["number_of_seasons"].alias("number_of_seasons"),
        )
        .select(
            "key", "t.*", "cast", "directors", "writers", "w.*", "similar", "tagline", "status",
            "number_of_seasons",
        )
    )


def payload_credits(payloads: DataFrame) -> DataFrame:
    """The credits page: all cast, and the crew by department."""
    raw = F.col("raw")
    return parse(payloads, title_fields("id", "title", "name", "credits")).select(
        "key",
        raw["id"].alias("id"),
        _text(F.coalesce(filled(raw["title"]), raw["name"])).alias("title"),
        cast_list(raw, None).alias("cast"),
        crew_departments(raw).alias("crew"),
    )


def payload_person_documents(payloads: DataFrame) -> DataFrame:
    """The person page: life data and filmography."""
    raw, parts = F.col("raw"), "part" in payloads.columns
    fields = {k: v for k, v in PERSON_FIELDS.items() if k != "combined_credits"} if parts else PERSON_FIELDS
    people = parse(heads(payloads), fields)
    if parts:
        films = payload_filmography(payloads)
        entry = F.struct(*[c for c in films.columns if c not in ("key", "place")])
        lists = films.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))).alias("films"))
        people = people.join(lists, "key", "left")
        filmography = _list(F.transform("films", lambda f: f["entry"]))
    else:
        filmography = filmography_list(raw)
    return people.select(
        "key",
        raw["id"].alias("id"),
        _text(raw["name"]).alias("name"),
        image_url(raw["profile_path"]).alias("profile"),
        _text(raw["biography"]).alias("biography"),
        raw["birthday"].alias("birthday"),
        raw["deathday"].alias("deathday"),
        _text(raw["place_of_birth"]).alias("place_of_birth"),
        _text(raw["known_for_department"]).alias("known_for_department"),
        filmography.alias("filmography"),
    )


def multi_results(payloads: DataFrame) -> DataFrame:
    """Mixed entries, one a row: titles and people in one table, other kinds dropped."""
    kind = F.col("raw.media_type") if "raw" in payloads.columns else F.get_json_object("payload", "$.media_type")
    known = kind.isin(RESULT_KINDS)
    found = parse(payloads.filter(known), RESULT_FIELDS)
    return found.select("key", normal_result(F.col("raw")).alias("r")).select("key", "r.*")


def payload_results(responses: DataFrame, kind: str | None = None, size: int | None = None) -> DataFrame:
    """The entries of response payloads' ``results`` lists with their ``place`` from 0.

    With a ``kind`` all entries are titles of that kind, the first ``size`` of each list
    or all. Without one the entries name theirs: titles and people stay in the order of
    the list, other kinds are dropped and leave no gap.
    """
    fields = ITEM if kind else RESULT_FIELDS
    entries = ", ".join(f"{name}: {of}" for name, of in fields.items())
    parsed = parse(responses, {"results": f"array<struct<{entries}>>"})
    items = _list(F.col("raw")["results"])
    if kind is None:
        items = F.filter(items, lambda i: i["media_type"].isin(RESULT_KINDS))
    if size is not None:
        items = F.slice(items, 1, size)
    placed = parsed.select("key", F.posexplode(items).alias("place", "item"))
    entry = normal_title(F.col("item"), F.lit(kind)) if kind else normal_result(F.col("item"))
    return placed.select("key", "place", entry.alias("r")).select("key", "place", "r.*")


def response_pages(responses: DataFrame, cap: int = 500) -> DataFrame:
    """What response payloads say of their page: ``page``, ``total_pages`` (capped), ``total_results``."""
    raw = F.col("raw")
    parsed = parse(responses, {"page": "int", "total_pages": "int", "total_results": "bigint"})
    return parsed.select(
        "key",
        F.coalesce(raw["page"], F.lit(1)).alias("page"),
        F.least(F.coalesce(raw["total_pages"], F.lit(1)), F.lit(cap)).alias("total_pages"),
        F.coalesce(raw["total_results"], F.lit(0)).alias("total_results"),
    )


def found_posters(responses: DataFrame) -> DataFrame:
    """``tconst, found_url`` of lookup responses (key, payload): the poster of the first
    list whose first entry has one, null without any."""
    parsed = parse(responses, {name: "array<struct<poster_path: string>>" for name in LOOKUP_LISTS})
    firsts = [filled(F.get(F.col("raw")[name], F.lit(0))["poster_path"]) for name in LOOKUP_LISTS]
    return parsed.select(F.col("key").alias("tconst"), image_url(F.coalesce(*firsts)).alias("found_url"))
