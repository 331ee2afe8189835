from __future__ import annotations

from pyspark.sql import functions as F

from titlelake.operators import checks, load, merge
from titlelake.schemas import TABLES

KEYS = ["tconst", "platform"]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=str)


def links(spark, *items):
    return spark.createDataFrame(list(items), "tconst string, platform string, url string, n int")


def test_latest_change_wins(spark):
    base = links(spark, ("t1", "a", "old", 0), ("t2", "a", "kept", 0)).drop("n")
    changes = links(spark, ("t1", "a", "first", 1), ("t1", "a", "second", 2), ("t3", "b", "new", 1))
    found = merge.upsert_latest(base, changes, KEYS, [F.desc("n")])
    assert rows(found) == [("t1", "a", "second"), ("t2", "a", "kept"), ("t3", "b", "new")]


def test_existing_row_wins(spark):
    base = links(spark, ("t1", "a", "old", 0)).drop("n")
    changes = links(spark, ("t1", "a", "no", 1), ("t2", "a", "first", 1), ("t2", "a", "second", 2))
    found = merge.insert_missing(base, changes, KEYS, [F.asc("n")])
    assert rows(found) == [("t1", "a", "old"), ("t2", "a", "first")]


def test_incomplete_links_are_rejected(spark):
    changes = links(spark, ("t1", "a", "u", 1), ("t2", "", "u", 2), ("t3", "a", None, 3), ("t4", None, "", 4))
    valid, rejected = merge.split_valid(changes)
    assert rows(valid, "tconst") == [("t1",)]
    assert rows(rejected, "tconst") == [("t2",), ("t3",), ("t4",)]


def test_poster_order(spark, edges):
    found = spark.createDataFrame([("tt1", "x"), ("tt2", "y"), ("tt3", "")], "tconst string, found_url string")
    resolved = dict(rows(merge.resolve_poster(edges.title, found, "none")))
    assert (resolved["tt1"], resolved["tt2"], resolved["tt3"], resolved["tt4"]) == ("/one.jpg", "y", "none", "none")
    stored = merge.store_posters(edges.title, found)
    assert stored.columns == edges.title.columns
    assert dict(rows(stored, "tconst", "poster_url"))["tt2"] == "y"
    assert dict(rows(stored, "tconst", "poster_url"))["tt3"] is None


def test_deletes_cascade(spark, edges):
    titles = spark.createDataFrame([("tt4",)], "tconst string")
    people = spark.createDataFrame([("nm3",)], "nconst string")
    after = merge.cascade_delete(edges, titles, people)
    counts = {r["table_name"]: r["row_count"] for r in load.table_counts(after, list(TABLES)).collect()}
    assert counts == {
        "title": 8, "person": 3, "episode": 0, "principal": 4, "genre": 2, "title_genre": 2, "rating": 5,
        "streaming_link": 2,
    }
    assert after.principal.columns == edges.principal.columns
    assert checks.violations(after, list(TABLES)).filter("violations > 0").count() == 0
    only_people = merge.cascade_delete(edges, people=people)
    assert only_people.title.count() == 9


def test_two_posters_found_do_not_double_a_title(spark, edges):
    found = spark.createDataFrame([("tt2", "https://b"), ("tt2", "https://a"), ("tt2", "")], "tconst string, found_url string")
    out = {r["tconst"]: r["poster_url"] for r in merge.resolve_poster(edges.title, found).collect()}
    assert out["tt2"] == "https://a" and merge.store_posters(edges.title, found).count() == edges.title.count()


def test_deleted_genres_take_their_links(spark, edges):
    after = merge.cascade_delete(edges, genres=spark.createDataFrame([(2,)], "genre_id int"))
    assert rows(after.genre) == [(1, "Crime")] and rows(after.title_genre) == [("tt1", 1)]
    assert after.title.count() == 9
