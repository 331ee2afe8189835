from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F
from titlelake.plans import payloads
from titlelake.sources import testbed

IMG = "https://image.tmdb.org/t/p"


@pytest.fixture
def table(spark):
    def build(*items):
        rows = [(str(n), kind, json.dumps(item)) for n, (kind, item) in enumerate(items)]
        return spark.createDataFrame(rows, "key string, media_type string, payload string")

    return build


def one(df):
    return df.collect()[0].asDict(recursive=True)


def test_film(table):
    found = one(
        payloads.payload_titles(
            table(
                (
                    "movie",
                    {
                        "id": 1, "title": "Film", "name": "Other", "original_title": "Le Film",
                        "release_date": "1999-05-01", "runtime": 0, "poster_path": "/p.jpg", "vote_average": 7.25,
                        "vote_count": 10, "genres": [{"id": 1, "name": "Drama"}], "genre_ids": [1, 2],
                    },
                )
            )
        )
    )
    assert (found["title"], found["original_title"], found["year"]) == ("Film", "Le Film", 1999)
    assert (found["poster"], found["backdrop"]) == (f"{IMG}/w500/p.jpg", None)
    assert (found["runtime"], found["rating"], found["votes"]) == (0, 7.25, 10)
    assert (found["genres"], found["genre_ids"], found["adult"], found["overview"]) == (["Drama"], [1, 2], False, "")


def test_series(table):
    item = {
        "id": 2, "title": "Other", "name": "Series", "first_air_date": "2010", "runtime": 0,
        "episode_run_time": [45, 50], "media_type": "tv",
    }
    found = one(payloads.payload_titles(table((None, item))))
    assert (found["title"], found["media_type"], found["year"], found["runtime"]) == ("Series", "tv", 2010, 45)
    assert one(payloads.payload_titles(table(("tv", {"runtime": 30, "episode_run_time": [1]}))))["runtime"] == 30
    assert one(payloads.payload_titles(table(("tv", {"episode_run_time": []}))))["runtime"] is None


def test_missing_and_odd_fields(table):
    found = one(payloads.payload_titles(table((None, {"release_date": "19"}))))
    assert (found["media_type"], found["title"], found["year"], found["genres"]) == ("movie", "", None, [])
    assert one(payloads.payload_titles(table((None, {"release_date": "soon!"}))))["year"] is None


def test_person(table):
    item = {
        "id": 3, "name": "Ana", "profile_path": "/a.jpg",
        "known_for": [{"id": 1, "title": "F"}, {"id": 2, "media_type": "tv", "name": "S"}],
    }
    found = one(payloads.payload_people(table((None, item))))
    assert (found["profile"], found["media_type"], found["known_for_department"]) == (f"{IMG}/w185/a.jpg", "person", "")
    assert [(k["title"], k["media_type"]) for k in found["known_for"]] == [("F", "movie"), ("S", "tv")]


def test_cast_and_crew(table):
    crew = [
        {"id": 1, "name": "A", "job": "Director", "department": "Directing"},
        {"id": 2, "name": "B", "job": "Gaffer"},
        {"id": 3, "name": "C", "job": "Story", "department": "Writing"},
        {"id": 1, "name": "A", "job": "Screenplay", "department": "Writing"},
        {"id": 4, "name": "D", "department": "Directing"},
    ]
    cast = [{"id": n, "name": f"P{n}"} for n in range(25)]
    df = table(("movie", {"id": 1, "credits": {"cast": cast, "crew": crew}}))
    found = payloads.payload_cast(df).orderBy("place").collect()
    assert [r["id"] for r in found] == list(range(20))
    assert (found[0]["character"], found[0]["profile"]) == ("", None)
    assert payloads.payload_cast(df, size=None).count() == 25
    lists = one(payloads.payload_crew(df))
    assert [c["id"] for c in lists["directors"]] == [1]
    assert [c["id"] for c in lists["writers"]] == [3, 1]
    groups = [(r["department"], [m["id"] for m in r["crew"]]) for r in payloads.payload_departments(df).orderBy("place").collect()]
    assert groups == [("Directing", [1, 4]), ("Other", [2]), ("Writing", [3, 1])]


def offers(*names):
    return [{"provider_name": n, "logo_path": f"/{n}.png"} for n in names]


@pytest.mark.parametrize(
    "results, names, link",
    [
        ({"US": {"link": "us", "flatrate": offers("a"), "rent": offers("b", "a"), "buy": offers("c")}}, ["a", "b", "c"], "us"),
        ({"US": {"link": "us"}, "GB": {"link": "gb", "buy": offers("a")}, "FR": {"link": "fr", "buy": offers("z")}}, ["a"], "gb"),
        ({"US": {"link": "us"}, "DE": {"link": "de", "rent": []}}, [], "de"),
        ({"US": {"link": "us", "rent": offers("a")}, "IN": {"link": "in", "rent": offers("b")}}, ["a"], "us"),
        ({"JP": {"link": "jp", "rent": offers("a")}}, [], ""),
        ({"US": {}, "GB": {"buy": offers("a")}}, ["a"], ""),
        ({}, [], ""),
        (None, [], ""),
    ],
)
def test_providers(table, results, names, link):
    item = {"id": 1} if results is None else {"id": 1, "watch/providers": {"results": results}}
    found = one(payloads.payload_providers(table(("movie", item))))
    assert ([p["name"] for p in found["providers"]], found["watch_link"]) == (names, link)


def test_filmography_order_is_stable(table):
    roles = [
        {"id": 1, "title": "undated"},
        {"id": 2, "title": "old", "release_date": "1990-01-01"},
        {"id": 3, "title": "new a", "release_date": "2000-01-01"},
        {"id": 4, "name": "new b", "media_type": "tv", "release_date": "", "first_air_date": "2000-01-01"},
        {"id": 5, "title": "empty", "release_date": ""},
    ]
    df = table((None, {"id": 9, "combined_credits": {"cast": roles}}))
    found = payloads.payload_filmography(df).orderBy("place").collect()
    assert [r["id"] for r in found] == [3, 4, 2, 1, 5]
    assert [r["year"] for r in found] == ["2000", "2000", "1990", None, None]
    assert [r["title"] for r in found][:2] == ["new a", "new b"]


def test_filmography_keeps_sixty(table):
    roles = [{"id": n, "release_date": f"{1900 + n}-01-01"} for n in range(70)]
    df = table((None, {"combined_credits": {"cast": roles}}))
    assert [r["id"] for r in payloads.payload_filmography(df).orderBy("place").collect()] == list(range(69, 9, -1))


def test_similar_and_page(table):
    items = [{"id": n, "name": f"S{n}", "title": f"T{n}"} for n in range(12)]
    df = table(("tv", {"id": 1, "name": "Series", "similar": {"results": items}, "tagline": "x"}))
    found = payloads.payload_similar(df).orderBy("place").collect()
    assert [r["title"] for r in found] == [f"S{n}" for n in range(10)]
    page = one(payloads.payload_documents(df))
    assert (len(page["similar"]), page["tagline"], page["status"], page["number_of_seasons"]) == (10, "x", "", None)
    assert (page["cast"], page["directors"], page["providers"]) == ([], [], [])


def test_mixed_results_drop_unknown_kinds(table):
    df = table(
        (None, {"id": 1, "media_type": "movie", "title": "F"}),
        (None, {"id": 2, "media_type": "tv", "name": "S"}),
        (None, {"id": 3, "media_type": "person", "name": "P"}),
        (None, {"id": 4, "media_type": "collection"}),
        (None, {"id": 5}),
    )
    found = payloads.multi_results(df).collect()
    assert {(r["id"], r["media_type"], r["title"], r["name"]) for r in found} == {
        (1, "movie", "F", None), (2, "tv", "S", None), (3, "person", None, "P"),
    }


def test_payloads_that_are_no_objects_are_rejected(spark):
    bad = ["{oops", None, "", "[1]", '{"id": 1', "null"]
    items = [(str(n), None, text) for n, text in enumerate(['{"id": 7}', "{}", *bad])]
    df = spark.createDataFrame(items, "key string, media_type string, payload string")
    assert sorted(r["key"] for r in payloads.payload_titles(df).collect()) == ["0", "1"]
    assert sorted(r["key"] for r in payloads.rejects(df).collect()) == [str(n) for n in range(2, 8)]
    assert payloads.multi_results(df).count() == 0


def test_results_keep_the_order_of_the_list(table):
    results = [
        {"id": 3, "media_type": "person", "name": "P", "profile_path": "/p"},
        {"id": 4, "media_type": "collection"},
        {"id": 1, "media_type": "movie", "title": "F", "name": "Other"},
        {"id": 2, "media_type": "tv", "name": "S"},
    ]
    df = table((None, {"results": results, "page": 2, "total_pages": 900, "total_results": 7}), (None, {"results": []}), (None, {}))
    found = payloads.payload_results(df).orderBy("key", "place").collect()
    assert [(r["place"], r["id"], r["title"], r["name"]) for r in found] == [(0, 3, None, "P"), (1, 1, "F", None), (2, 2, "S", None)]
    as_films = payloads.payload_results(df, "movie", 3).orderBy("place").collect()
    assert [(r["id"], r["title"], r["media_type"]) for r in as_films] == [(3, "", "movie"), (4, "", "movie"), (1, "F", "movie")]
    pages = payloads.response_pages(df).orderBy("key").collect()
    assert [tuple(r)[1:] for r in pages] == [(2, 500, 7), (1, 1, 0), (1, 1, 0)]


def test_poster_of_the_first_list_that_has_one(table):
    df = table(
        (None, {"movie_results": [{"poster_path": "/m"}], "tv_results": [{"poster_path": "/s"}]}),
        (None, {"movie_results": [{"poster_path": ""}, {"poster_path": "/x"}], "tv_episode_results": [{"poster_path": "/e"}]}),
        (None, {"movie_results": []}),
    )
    found = payloads.found_posters(df).orderBy("tconst").collect()
    assert [r["found_url"] for r in found] == [f"{IMG}/w500/m", f"{IMG}/w500/e", None]


def test_no_role_of_a_person_is_lost(spark, monkeypatch):
    from fixtures import frames

    from titlelake.sources import testbed

    monkeypatch.setattr(testbed, "TITLES_PER_PART", 40)
    titles = [(f"tt{i:07d}", "movie", f"T{i}", f"T{i}", False, 1900 + i % 90, None, None, None) for i in range(150)]
    roles = [(key, 1, "nm0000001", "actor", None, None) for key, *_ in titles]
    people = [("nm0000001", "Ada", None, None), ("nm0000002", "Bea", None, None)]
    cat = frames(spark, title=titles, person=people, principal=roles)
    made = testbed.person_payloads(cat).persist()
    size = F.expr("json_array_length(get_json_object(payload, '$.combined_credits.cast'))").alias("n")
    sizes = {(r["key"], r["part"]): r["n"] for r in made.select("key", "part", size).collect()}
    assert sizes == {(p[0], 0): None for p in people} | {("nm0000001", k): n for k, n in ((1, 40), (2, 40), (3, 40), (4, 30))}
    # Latest first; of one year, in the order of the parts.
    wanted = sorted(range(150), key=lambda i: (-(i % 90), i))[:60]
    films = payloads.payload_filmography(made).orderBy("place").collect()
    assert [(r["place"], r["id"]) for r in films] == list(enumerate(wanted))
    pages = {r["key"]: [f["id"] for f in r["filmography"]] for r in payloads.payload_person_documents(made).collect()}
    assert pages == {"nm0000001": wanted, "nm0000002": []}
    known = {r["key"]: [k["id"] for k in r["known_for"]] for r in payloads.payload_people(made).collect()}
    assert known == {"nm0000001": [0, 1, 2], "nm0000002": []}


def test_jobs_over_payloads_that_were_parsed_once(spark, tmp_path):
    from titlelake.sources import testbed

    cat = testbed.catalogue(spark, "/root/testdata/sf0.001")
    cat = cat.replace(title=cat.title.limit(150))
    broken = spark.createDataFrame([("a", "movie", "[1]"), ("b", None, "{"), ("c", "tv", None), ("d", None, "{}"), ("e", None, '{"id": "x", "title": 5}')], "key string, media_type string, payload string")
    texts = testbed.title_payloads(cat).unionByName(broken)
    payloads.save_parsed(texts, str(tmp_path / "titles"), payloads.TITLE_FIELDS)
    stored = payloads.load_parsed(spark, str(tmp_path / "titles"))
    for job in (payloads.payload_titles, payloads.payload_cast, payloads.payload_crew, payloads.payload_departments, payloads.payload_providers, payloads.payload_similar, payloads.payload_documents, payloads.payload_credits):
        assert sorted(map(str, job(stored).collect())) == sorted(map(str, job(texts).collect())), job.__name__
    assert sorted(map(tuple, payloads.rejects(stored).select("key", "payload").collect()), key=str) == sorted(map(tuple, payloads.rejects(texts).select("key", "payload").collect()), key=str)
    plan = payloads.payload_crew(stored)._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "raw:struct<credits" in plan and "overview" not in plan
    with pytest.raises(ValueError):
        payloads.parse(stored, {"budget": "int"})


def test_people_that_were_parsed_once(spark, tmp_path):
    from titlelake.sources import testbed

    cat = testbed.catalogue(spark, "/root/testdata/sf0.001")
    texts = testbed.person_payloads(cat)
    payloads.save_parsed(texts, str(tmp_path / "people"), payloads.PERSON_FIELDS)
    stored = payloads.load_parsed(spark, str(tmp_path / "people"))
    for job in (payloads.payload_people, payloads.payload_filmography):
        assert sorted(map(str, job(stored).collect())) == sorted(map(str, job(texts).collect())), job.__name__


def test_a_payload_that_a_query_makes_is_made_once_a_row(spark):
    text = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.when(F.col("id") != 2, "}").otherwise(""))
    made = spark.range(4).select(F.col("id").cast("string").alias("key"), F.lit("movie").alias("media_type"), text.alias("payload"))
    found = payloads.payload_titles(made)
    assert found._jdf.queryExecution().optimizedPlan().toString().count('concat({"id": ') == 1
    assert sorted((r["key"], r["id"]) for r in found.collect()) == [("0", 0), ("1", 1), ("3", 3)]


@pytest.fixture
def bed(spark, tmp_path):
    """Test tables with repeated line items, a line item without number, one of an unknown supplier, and null keys."""
    day = "timestamp '1995-03-01'"
    spark.range(1, 7).selectExpr(
        "id as o_orderkey", "1L as o_custkey", "'F' as o_orderstatus", "id * 10.0D as o_totalprice", f"{day} as o_orderdate", "'2-HIGH' as o_orderpriority"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(0, 4).selectExpr("id as p_partkey", "concat('part ', id) as p_name", "concat('Brand#', id % 2) as p_brand").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 3).selectExpr("id as s_suppkey", "concat('Sup ', id) as s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [
        (1, 2, 1, 1, "A", "F"), (1, 1, 2, 2, "R", "F"), (1, 1, 1, 2, "R", "F"), (1, 1, 1, 2, "R", "F"), (1, 3, 3, 9, "N", "F"), (1, None, 2, 1, "R", "O"),
        (2, 1, 3, 2, "N", "O"), (None, 1, 1, 1, "R", "F"), (3, 4, 2, 1, None, "F"),
    ]
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, kinds).selectExpr("*", "1.0D as l_extendedprice", f"{day} as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 3).selectExpr("id as event_id", f"{day} as ts", "id as user_id", "'view' as event_type", "5.0D as value").write.parquet(f"{tmp_path}/events.parquet")
    return testbed.catalogue(spark, str(tmp_path))


def test_title_payloads_list_the_credits_in_order(bed, no_broadcast):
    found = {r["key"]: json.loads(r["payload"])["credits"] for r in testbed.title_payloads(bed).collect()}
    assert found["tt0000001"] == {
        "cast": [
            {"id": 1, "name": "Sup 1", "character": "Role 2"},
            {"id": 2, "name": "Sup 2", "character": "Role 1", "profile_path": "/fnm0000002.jpg"},
        ],
        "crew": [{"id": 1, "name": "Sup 1", "job": "Director", "department": "Directing"}],
    }
    assert found["tt0000002"] == {"cast": [], "crew": [{"id": 2, "name": "Sup 2", "job": "Composer"}]}
    assert found["tt0000003"] == {"cast": [], "crew": []} and found["tt0000004"] == {}


def test_title_payloads_move_only_what_they_need(bed, no_broadcast):
    text = testbed.title_payloads(bed)._jdf.queryExecution().executedPlan().toString()
    # Frequent people are counted in the line items as they are: repeats are taken out once, before and after one shuffle.
    assert text.count("WindowGroupLimit [l_orderkey") == 2
    # A counted list of genres is broadcast, so no link moves to meet its name.
    assert "SortMergeJoin [genre_id" not in text and "BroadcastHashJoin [genre_id" in text
    # The texts of a list of credits are made after its rows have met.
    partial = [line for line in text.splitlines() if "partial_collect_list" in line]
    assert partial and not any("get_json_object" in line for line in partial)
