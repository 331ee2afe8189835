from __future__ import annotations

from decimal import Decimal

import pytest
from fixtures import frames
from pyspark.sql import functions as F

from titlelake.operators import checks, load
from titlelake.schemas import DUMPS, TABLES
from titlelake.sources.dumps import read_dump, write_dump
from titlelake.sources.tables import load_bucketed, load_catalog, save_bucketed, save_catalog, save_frame

TITLES = [
    'tt1\tmovie\tThe "Quoted" One\tback\\slash\t0\t1999\t\\N\t90\tDrama, Crime,, Drama ,',
    "tt2\ttvSeries\t\t\\N\t1\t\\N\t\t\\N\t\\N",
    "tt3\ttvEpisode\t'single\tC:\\new\\table\t2\t2001\t\\N\t30\tComedy",
    "tt4\tmovie\tShort row",
]


def write(path, dump, lines, header=None):
    path.write_text("\n".join(["\t".join(header or DUMPS[dump]), *lines]) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture
def raw(spark, tmp_path):
    def build(dump, lines):
        return read_dump(spark, write(tmp_path / f"{dump}.tsv", dump, lines), dump)

    return build


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_dump_is_read_literally(raw):
    found = {r["tconst"]: r for r in raw("title.basics", TITLES).collect()}
    assert found["tt1"]["primaryTitle"] == 'The "Quoted" One'
    assert found["tt1"]["originalTitle"] == "back\\slash"
    assert found["tt3"]["originalTitle"] == "C:\\new\\table"
    assert found["tt2"]["primaryTitle"] is None
    assert (found["tt4"]["primaryTitle"], found["tt4"]["originalTitle"], found["tt4"]["genres"]) == ("Short row", None, None)


def test_dump_with_another_header_is_refused(spark, tmp_path):
    path = write(tmp_path / "x.tsv", "title.ratings", ["tt1\t9.0\t5"], ["tconst", "numVotes", "averageRating"])
    with pytest.raises(Exception, match="header|schema"):
        read_dump(spark, path, "title.ratings").collect()


def test_titles(raw):
    found = {r["tconst"]: r for r in load.load_titles(raw("title.basics", TITLES)).collect()}
    assert (found["tt1"]["start_year"], found["tt1"]["runtime_minutes"], found["tt1"]["is_adult"]) == (1999, 90, False)
    assert (found["tt2"]["is_adult"], found["tt2"]["start_year"], found["tt2"]["primary_title"]) == (True, None, None)
    assert (found["tt3"]["is_adult"], found["tt4"]["is_adult"]) == (False, False)


def test_bad_numbers(raw):
    bad = raw("title.basics", ["tt1\tmovie\tA\tA\t0\tsoon\t\\N\t90\t\\N", "tt2\tmovie\tB\tB\t0\t1999\t\\N\t99999999999\t\\N"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load.load_titles(bad).collect()
    found = rows(load.load_titles(bad, lenient=True), "tconst", "start_year", "runtime_minutes")
    assert found == [("tt1", None, 90), ("tt2", 1999, None)]
    assert rows(load.quarantine(bad, "title.basics"), "tconst") == [("tt1",), ("tt2",)]


def test_genres(raw):
    links = load.explode_genres(raw("title.basics", TITLES))
    assert rows(links, "tconst", "name") == [
        ("tt1", "Crime"), ("tt1", "Drama"), ("tt1", "Drama"), ("tt3", "Comedy"),
    ]
    genre = load.build_genre_dim(links)
    assert rows(genre, "genre_id", "name") == [(1, "Comedy"), (2, "Crime"), (3, "Drama")]
    assert rows(load.build_title_genre(links, genre), "tconst", "genre_id") == [("tt1", 2), ("tt1", 3), ("tt3", 1)]
    known = genre.filter("name <> 'Crime'")
    assert rows(load.build_title_genre(links, known), "tconst", "genre_id") == [("tt1", 3), ("tt3", 1)]


def test_known_genres_keep_their_ids(spark):
    existing = spark.createDataFrame([(7, "Drama"), (3, "Short")], TABLES["genre"])
    links = spark.createDataFrame([("tt1", n) for n in ("Zombie", "Drama", "Action")], "tconst string, name string")
    found = rows(load.build_genre_dim(links, existing), "genre_id", "name")
    assert found == [(3, "Short"), (7, "Drama"), (8, "Action"), (9, "Zombie")]
    none_yet = spark.createDataFrame([], TABLES["genre"])
    assert rows(load.build_genre_dim(links, none_yet), "genre_id", "name") == [(1, "Action"), (2, "Drama"), (3, "Zombie")]


def test_ratings(spark, raw):
    title = spark.createDataFrame([("tt1",), ("tt2",), ("tt3",)], "tconst string")
    dump = raw("title.ratings", ["tt1\t9.0\t5", "tt1\t8.0\t50", "tt2\t\\N\t5", "tt3\t7.1\t", "tt9\t9.9\t9"])
    assert rows(load.load_ratings(dump, title), "tconst", "average_rating", "num_votes") == [("tt1", Decimal("8.0"), 50)]
    before = spark.createDataFrame([("tt1", Decimal("1.0"), 1), ("tt2", Decimal("2.0"), 2)], TABLES["rating"])
    assert rows(load.load_ratings(dump, title, before), "tconst", "num_votes") == [("tt1", 50), ("tt2", 2)]


def test_people(raw):
    dump = raw("name.basics", ["nm1\tAna\t1950\t\\N\tactor\ttt1", "nm2\t\\N\t\\N\t\\N\t\\N\t\\N", "nm3\t\t1900\t1999\t\t"])
    assert rows(load.load_people(dump), "nconst", "primary_name", "birth_year", "death_year") == [
        ("nm1", "Ana", 1950, None), ("nm2", "Unknown", None, None), ("nm3", "Unknown", 1900, 1999),
    ]


PRINCIPALS = [
    'tt1\t1\tnm1\tactor\t\\N\t["A"]',
    "tt1\t1\tnm2\tactor\t\\N\t\\N",
    "tt1\t2\tnm9\tactor\t\\N\t\\N",
    "tt9\t1\tnm1\tactor\t\\N\t\\N",
    "tt1\t3\tnm2\t\t\\N\t\\N",
]


def test_principals(spark, raw):
    title = spark.createDataFrame([("tt1",)], "tconst string")
    person = spark.createDataFrame([("nm1",), ("nm2",)], "nconst string")
    dump = raw("title.principals", PRINCIPALS)
    found = load.load_principals(dump, title, person, [F.asc("nconst")])
    assert rows(found, "tconst", "ordering", "nconst", "category", "characters") == [
        ("tt1", 1, "nm1", "actor", '["A"]'), ("tt1", 3, "nm2", "unknown", None),
    ]
    last = load.load_principals(dump, title, person, [F.desc("nconst")])
    assert rows(last, "ordering", "nconst")[0] == (1, "nm2")
    assert last.schema.simpleString() == frames(spark).principal.schema.simpleString()


def test_repeats_are_chosen_among_known_people(spark, raw):
    title = spark.createDataFrame([("tt1",)], "tconst string")
    person = spark.createDataFrame([("nm2",)], "nconst string")
    found = load.load_principals(raw("title.principals", PRINCIPALS), title, person, [F.asc("nconst")])
    assert rows(found, "ordering", "nconst") == [(1, "nm2"), (3, "nm2")]


def test_episodes(spark, raw):
    title = spark.createDataFrame([("tt1",), ("tt2",), ("tt3",)], "tconst string")
    dump = raw("title.episode", ["tt1\ttt2\t1\t\\N", "tt9\ttt2\t1\t1", "tt3\ttt8\t1\t1", "tt3\ttt2\t\\N\t\\N"])
    assert rows(load.load_episodes(dump, title), "tconst", "parent_tconst", "season_number", "episode_number") == [
        ("tt1", "tt2", 1, None), ("tt3", "tt2", None, None),
    ]


@pytest.fixture
def loaded(raw):
    return load.load_all(
        {
            "title.basics": raw("title.basics", TITLES),
            "name.basics": raw("name.basics", ["nm1\tAna\t1950\t\\N\t\\N\t\\N", "nm2\tBen\t\\N\t\\N\t\\N\t\\N"]),
            "title.ratings": raw("title.ratings", ["tt1\t9.0\t5", "tt9\t9.9\t9"]),
            "title.principals": raw("title.principals", PRINCIPALS),
            "title.episode": raw("title.episode", ["tt3\ttt2\t1\t1", "tt3\ttt7\t1\t1"]),
        },
        [F.asc("nconst")],
    )


LOADED = ["title", "person", "episode", "principal", "genre", "title_genre", "rating"]


def test_a_loaded_catalogue_breaks_no_constraint(loaded):
    found = checks.violations(loaded, LOADED)
    assert found.filter("violations > 0").count() == 0
    counts = {r["table_name"]: r["row_count"] for r in load.table_counts(loaded, LOADED).collect()}
    assert counts == {"title": 4, "person": 2, "episode": 1, "principal": 2, "genre": 3, "title_genre": 3, "rating": 1}


def test_saved_tables_come_back_and_are_replaced(spark, loaded, tmp_path):
    path = str(tmp_path / "lake")
    save_catalog(loaded, path, LOADED)
    back = load_catalog(spark, path)
    for name in LOADED:
        assert sorted(back[name].collect(), key=str) == sorted(loaded[name].collect(), key=str)
        assert back[name].schema.simpleString() == loaded[name].schema.simpleString()
    fewer = loaded.replace(person=loaded.person.filter("nconst = 'nm1'"))
    save_catalog(fewer, path, ["person"])
    assert load_catalog(spark, path).person.count() == 1


def test_bucketed_tables_join_without_a_shuffle(spark, loaded, no_broadcast):
    save_bucketed(loaded, ["title", "rating", "principal"], 4, prefix="bucketed_")
    cat = load_bucketed(spark, "bucketed_")
    joined = cat.title.join(cat.rating, "tconst").join(cat.principal, "tconst")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 2


def test_dump_round_trip(spark, tmp_path):
    odd = [('tt1', 'mo"vie', "a\\b", " lead", "0", None, "tail ", "'q'", "x,y"), ("tt2", None, "", '""', "1", "2", "#", "\\", "é")]
    df = spark.createDataFrame(odd, ", ".join(f"{c} string" for c in DUMPS["title.basics"]))
    write_dump(df, str(tmp_path / "out"), "title.basics")
    back = read_dump(spark, str(tmp_path / "out"), "title.basics")
    expected = [tuple(v or None for v in row) for row in odd]
    assert rows(back, *DUMPS["title.basics"]) == sorted(expected, key=str)


def test_chart_tables_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1990, 8.5)], "decade int, avg_rating double")
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        save_frame(df, path, kind)
        save_frame(df, path, kind)
        reader = spark.read.schema("decade int, avg_rating double").option("header", True).format(kind)
        assert reader.load(path).collect() == df.collect()


def test_unknown_table_is_refused(loaded):
    with pytest.raises(KeyError):
        loaded["titles"]
    with pytest.raises(AttributeError):
        loaded.titles


def test_dumps_keep_rows_whole_when_text_has_tabs_and_breaks(spark, tmp_path):
    from titlelake.schemas import DUMPS
    from titlelake.sources import dumps

    columns = DUMPS["title.ratings"]
    df = spark.createDataFrame([("tt1", "a\tb\nc", "d"), ("tt2", None, 'q"')], columns)
    dumps.write_dump(df, str(tmp_path / "d"), "title.ratings")
    back = sorted(tuple(r) for r in dumps.read_dump(spark, str(tmp_path / "d"), "title.ratings").collect())
    assert back == [("tt1", "a b c", "d"), ("tt2", None, 'q"')]


def test_a_catalogue_may_replace_itself(spark, edges, tmp_path):
    from titlelake.operators.merge import cascade_delete
    from titlelake.schemas import TABLES
    from titlelake.sources.tables import drop_versions, versions

    path = str(tmp_path / "lake")
    save_catalog(edges, path, list(TABLES))
    cat = load_catalog(spark, path)
    left = cascade_delete(cat, cat.title.filter("title_type = 'videoGame'"))
    save_catalog(left, path, ["title", "rating"])
    after = load_catalog(spark, path)
    assert (after.title.count(), after.rating.count(), after.person.count()) == (8, 5, 4)
    assert after.rating.join(after.title, "tconst", "left_anti").count() == 0
    # A save that fails leaves the version before in place.
    broken = after.replace(rating=after.rating.withColumn("num_votes", F.raise_error(F.lit("stop")).cast("int")))
    with pytest.raises(Exception, match="stop"):
        save_catalog(broken, path, ["title", "rating"])
    assert versions(spark, path) == [1, 2] and load_catalog(spark, path).rating.count() == 5
    assert load_catalog(spark, path, version=1).title.count() == 9
    drop_versions(spark, path, keep=1)
    assert versions(spark, path) == [2] and load_catalog(spark, path).person.count() == 4
    with pytest.raises(FileNotFoundError):
        load_catalog(spark, str(tmp_path / "nothing"))
