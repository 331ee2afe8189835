from __future__ import annotations

import pytest
from fixtures import SERIES, film
from pyspark.sql import functions as F

from titlelake.functions.text import contains_ci
from titlelake.operators.ranking import page, page_after, page_info
from titlelake.plans import browse


def column(df, name):
    return [row[name] for row in df.collect()]


def test_top_rated_of_the_seed(seed):
    found = browse.home_top_rated(seed)
    assert column(found, "id") == [film(4), film(8), SERIES, film(3), film(7), film(2), film(6), film(1), film(5)]
    by_id = {row["id"]: row["genres"] for row in found.collect()}
    assert (by_id[film(6)], by_id[film(7)]) == ("Musical, Western", "War")
    assert found.columns == browse.HOME


def test_most_voted_of_the_seed_breaks_ties_by_id(seed):
    assert column(browse.home_most_voted(seed), "id")[:8] == [
        film(7), film(5), film(3), film(1), film(8), film(6), film(4), SERIES,
    ]


def test_home_lists_leave_out_episodes_games_and_few_votes(edges):
    assert column(browse.home_top_rated(edges), "id") == ["tt1", "tt4"]
    assert column(browse.home_top_rated(edges, include_adult=True), "id") == ["tt3", "tt1", "tt4"]
    assert column(browse.home_most_voted(edges, include_adult=True, k=2), "id") == ["tt3", "tt1"]


def test_list_without_genres_has_empty_text(edges):
    found = browse.home_top_rated(edges, include_adult=True)
    assert {r["id"]: r["genres"] for r in found.collect()} == {"tt3": "", "tt1": "Crime, Drama", "tt4": "Drama"}


def test_large_limits_give_the_same_list(edges):
    few = browse.home_top_rated(edges, include_adult=True).collect()
    assert browse.home_top_rated(edges, include_adult=True, k=browse.FEW_ROWS + 1).collect() == few


def test_genre_text_of_every_title(edges):
    found = {r["tconst"]: r["genres"] for r in browse.title_genres_string(edges).collect()}
    assert found["tt1"] == "Crime, Drama"
    assert found["tt2"] == ""
    assert len(found) == 9


def test_correlated_genre_text_agrees(spark, edges):
    for name in ("title", "title_genre", "genre"):
        edges[name].createOrReplaceTempView(f"edge_{name}")
    sql = """
        SELECT t.tconst, coalesce((SELECT listagg(g.name, ', ') WITHIN GROUP (ORDER BY g.name)
            FROM edge_title_genre tg JOIN edge_genre g USING (genre_id) WHERE tg.tconst = t.tconst), '') AS genres
        FROM edge_title t"""
    assert sorted(spark.sql(sql).collect()) == sorted(browse.title_genres_string(edges).collect())


def test_summary_keeps_unrated_titles(edges):
    row = browse.title_summary(edges, "tt2").collect()[0]
    assert (row["average_rating"], row["start_year"], row["primary_title"]) == (None, None, "red_ring")
    assert browse.title_summary(edges, "nothing").count() == 0


def test_keys_may_be_one_several_or_a_table(spark, edges):
    table = spark.createDataFrame([("tt1",), ("tt4",), ("tt4",)], "id string")
    assert browse.title_summary(edges, ["tt1", "tt4"]).count() == 2
    assert browse.title_summary(edges, table).count() == 2
    assert browse.title_summary(edges).count() == 9


def test_credits_by_role_and_by_billing(seed, edges):
    assert column(browse.full_credits(seed, film(4)), "ordering") == [4, 1, 3, 2]
    assert column(browse.full_credits(edges, "tt1"), "category") == [
        "director", "writer", "actor", "actor", "actress", "editor", "stunts",
    ]
    assert column(browse.full_credits(edges, "tt1", by_role=False), "ordering") == [1, 2, 3, 4, 5, 6, 7]


def test_crew_and_cast(edges):
    assert column(browse.title_crew(edges, "tt1"), "category") == ["writer", "director"]
    assert sorted(column(browse.top_cast(edges, "tt1", n=2), "ordering")) == [1, 2]
    assert browse.top_cast(edges).count() == 5


def test_seasons_and_episodes(seed, edges):
    assert column(browse.series_seasons(seed, SERIES), "season_number") == [1, 2]
    assert column(browse.series_episodes(seed, SERIES, 2), "tconst") == ["tt0007902", "tt0007903"]
    assert column(browse.series_seasons(edges, "tt4"), "season_number") == [0, 1]
    # Season 0 is a season; numbers and seasons that are missing come last.
    assert column(browse.series_episodes(edges, "tt4", 0), "tconst") == ["tt5", "tt8"]
    assert column(browse.series_episodes(edges, "tt4"), "tconst") == ["tt5", "tt8", "tt6", "tt7"]


def test_person(seed, edges):
    assert browse.person_info(edges, "nm2").collect()[0]["death_year"] == 2000
    found = browse.filmography(seed, "nm0000803").collect()
    assert [(r["category"], r["start_year"]) for r in found] == [("actress", 1988), ("actress", 1987), ("actress", 1957)]
    ana = browse.filmography(edges, "nm1").collect()
    # actor before actress; latest year first and no year last
    assert [(r["category"], r["tconst"]) for r in ana] == [
        ("actor", "tt1"), ("actor", "tt4"), ("actor", "tt2"), ("actress", "tt1"),
    ]


def test_filmography_cap_is_per_person_and_category(edges):
    found = browse.filmography_top(edges, n=1).collect()
    assert sorted((r["nconst"], r["category"], r["tconst"]) for r in found) == [
        ("nm1", "actor", "tt1"), ("nm1", "actress", "tt1"), ("nm2", "actor", "tt1"), ("nm3", "director", "tt1"),
        ("nm3", "editor", "tt1"), ("nm3", "producer", "tt4"), ("nm3", "stunts", "tt1"), ("nm3", "writer", "tt1"),
    ]


def test_search_of_the_seed(seed):
    assert column(browse.search_titles(seed, "in"), "id") == [film(k) for k in (6, 2, 7, 1, 4)]
    assert column(browse.search_titles(seed, "in", prefix_first=False), "id") == [film(k) for k in (7, 1, 6, 4, 2)]


def test_search_wildcards_case_and_filters(edges):
    assert column(browse.search_titles(edges, " RING "), "id") == ["tt9", "tt1", "tt2"]
    assert column(browse.search_titles(edges, "d_r"), "id") == ["tt2"]
    assert column(browse.search_titles(edges, "d%r"), "id") == ["tt1", "tt2"]
    assert column(browse.search_titles(edges, "0%", literal=True), "id") == ["tt1"]
    assert column(browse.search_titles(edges, "d_r", literal=True), "id") == ["tt2"]
    assert column(browse.search_titles(edges, "ring", include_adult=True), "id") == ["tt9", "tt3", "tt1", "tt2"]


def test_search_people_and_all(edges):
    people = browse.search_people(edges, "an")
    assert column(people, "id") == ["nm1", "nm2"]
    both = browse.search_all(browse.search_titles(edges, "ring"), browse.search_people(edges, "en"))
    assert {(r["result_type"], r["id"]) for r in both.collect()} == {
        ("title", "tt9"), ("title", "tt1"), ("title", "tt2"), ("person", "nm3"),
    }


def test_a_backslash_escapes_what_follows(spark, edges):
    assert column(browse.search_titles(edges, "d\\_r"), "id") == ["tt2"]
    assert column(browse.search_titles(edges, "r\\ing"), "id") == column(browse.search_titles(edges, "ring"), "id")
    names = spark.createDataFrame([("a\\b",), ("ab",), ("ab%",)], "v string")
    found = lambda query: sorted(r["v"] for r in names.filter(contains_ci(F.col("v"), query)).collect())
    assert found("a\\b") == ["ab", "ab%"]
    assert found("a\\\\b") == ["a\\b"]
    assert found("b\\") == ["ab%"]  # the sign that is appended


def test_short_queries_are_refused_and_low_pages_are_the_first(edges):
    with pytest.raises(ValueError):
        browse.search_titles(edges, " r ")
    assert column(browse.search_people(edges, "ana", number=0), "id") == ["nm1", "nm2"]
    assert column(browse.discover(edges, number=-1), "id") == ["tt1"]


def test_pages_join_up(spark):
    df = spark.range(45).select(F.col("id").alias("n"))
    pages = [page(df, [F.desc("n")], 20, k).collect() for k in (1, 2, 3)]
    assert [r["n"] for p in pages for r in p] == list(range(44, -1, -1))
    assert [{r["has_more"] for r in p} for p in pages] == [{True}, {True}, {False}]
    assert [{r["total_pages"] for r in p} for p in pages] == [{2}, {3}, {3}]
    assert [r["place"] for p in pages for r in p] == list(range(1, 46))
    assert page(df, [F.desc("n")], 20, 4).count() == 0
    assert {r["has_more"] for r in page(df.limit(20), [F.desc("n")], 20, 1).collect()} == {False}


def test_keyset_pages_join_up_over_ties_and_nulls(spark):
    rows = [(k, None if k % 4 == 0 else k % 3) for k in range(50)]
    df = spark.createDataFrame(rows, "id int, votes int")
    order, last, seen = [("votes", True), ("id", False)], None, []
    while got := page_after(df, order, 7, last).collect():
        seen += [r["id"] for r in got]
        last = [got[-1]["votes"], got[-1]["id"]]
    assert seen == [k for k, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]


def test_page_numbers(spark):
    row = page_info(spark.range(41), 20).collect()[0]
    assert (row["total_results"], row["total_pages"]) == (41, 3)
    assert page_info(spark.range(20_001), 20, cap=500).collect()[0]["total_pages"] == 500
    assert page_info(spark.range(0), 20).collect()[0]["total_pages"] == 0


def test_discover(seed, edges):
    assert column(browse.discover(seed, genre="Musical", min_rating=6.3), "id") == [film(k) for k in (8, 4, 2)]
    assert column(browse.discover(seed, genre="Western", sort="votes"), "id") == [film(k) for k in (3, 6, 9)]
    assert column(browse.discover(seed, year=1975), "id") == [film(6)]
    assert column(browse.discover(seed, kind="tv", sort="rating"), "id") == [SERIES]
    # An unknown kind means films, an unknown sort popularity; adult titles need the flag.
    assert column(browse.discover(edges, kind="radio", sort="name"), "id") == ["tt1"]
    assert column(browse.discover(edges, include_adult=True), "id") == ["tt3", "tt1"]
    assert column(browse.discover(seed, sort="release_date", size=1), "id") == [film(9)]
    assert column(browse.discover(seed, sort="release_date", size=1, number=2), "id") == [film(8)]


def test_genre_list(seed):
    assert column(browse.genre_list(seed), "name")[:3] == ["Musical", "Noir", "War"]


def test_links_show_known_platforms_in_any_case(edges):
    found = {r["platform"]: (r["icon"], r["color"]) for r in browse.link_display(edges).collect()}
    assert found == {"Netflix": ("🔴", "#E50914"), "corner": ("🔗", "#666")}


def test_hero_list_limits_before_it_filters(spark):
    cards = spark.createDataFrame([(i, None if i % 2 else f"/{i}.jpg") for i in range(9)], "id int, poster string")
    assert column(browse.hero_list(cards, [F.asc("id")]), "id") == [0, 2, 4]
