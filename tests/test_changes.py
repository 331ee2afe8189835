"""Merges into a saved catalogue: which files they touch, and that they end in the plain result."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from titlelake import Catalog
from titlelake.schemas import TABLES
from titlelake.sources import tables
from titlelake.sources.shared import Taken


def titles(spark, numbers, name="first"):
    return spark.createDataFrame([(f"tt{i:07d}", "movie", f"{name} {i}", None, False, None, None, i % 200, None) for i in numbers], TABLES["title"])


@pytest.fixture
def lake(spark, tmp_path):
    """Titles 0, 2, 4, ... 1998, some episodes; ten files a table."""
    path = str(tmp_path / "lake")
    episodes = [(f"tt{i:07d}", f"tt{i % 50:07d}", 1, i % 30) for i in range(0, 2000, 4)]
    cat = Catalog.of({"title": titles(spark, range(0, 2000, 2)), "episode": spark.createDataFrame(episodes, TABLES["episode"])})
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.save_catalog(cat, path, ["title", "episode"])
    yield path
    for k, v in before.items():
        spark.conf.set(k, v)


def files_of(spark, path, name, version=None):
    place = tables.folders(spark, path, version)[name]
    listed = tables._listed(spark, path, place) if place.startswith("files/") else tables._ranges(spark, path, name, place)
    return {f["file"]: (f["low"], f["high"], f["rows"]) for f in listed}


def names(cat):
    return {r["tconst"]: r["primary_title"] for r in cat.title.select("tconst", "primary_title").collect()}


def test_a_small_upsert_keeps_all_other_files(spark, lake):
    before = files_of(spark, lake, "title")
    assert len(before) == 10
    number = tables.merge_catalog(spark, lake, {"title": titles(spark, range(400, 410), "second")})
    after = files_of(spark, lake, "title")
    assert number == 2 and len(set(before) & set(after)) >= 8
    found = names(tables.load_catalog(spark, lake))
    assert len(found) == 1005
    assert {k for k, v in found.items() if v.startswith("second")} == {f"tt{i:07d}" for i in range(400, 410)}
    # The version before reads as it was, and other tables keep their folder.
    assert len(names(tables.load_catalog(spark, lake, 1))) == 1000
    assert tables.folders(spark, lake, 1)["episode"] == tables.folders(spark, lake, 2)["episode"]


def test_many_merges_equal_a_dictionary_and_ranges_stay_apart(spark, lake):
    rng = random.Random(3)
    want = {f"tt{i:07d}": f"first {i}" for i in range(0, 2000, 2)}
    for step in range(4):
        up = rng.sample(range(-20, 2100), 15) if step else [5, 1995]
        up = [i for i in up if i >= 0]
        gone = rng.sample(range(2000), 12)
        tables.merge_catalog(
            spark, lake, {"title": titles(spark, up, f"step{step}")},
            {"title": spark.createDataFrame([(f"tt{i:07d}",) for i in gone], "tconst string")},
        )
        for i in gone:
            want.pop(f"tt{i:07d}", None)
        want |= {f"tt{i:07d}": f"step{step} {i}" for i in up}
    assert names(tables.load_catalog(spark, lake)) == want
    ranges = sorted(v[:2] for v in files_of(spark, lake, "title").values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    tables.drop_versions(spark, lake, keep=1)
    assert tables.versions(spark, lake) == [5]
    assert names(tables.load_catalog(spark, lake)) == want
    assert tables.load_catalog(spark, lake).episode.count() == 500


def test_all_keys_at_once(spark, lake, monkeypatch):
    monkeypatch.setattr(tables, "FEW_KEYS", 3)
    tables.merge_catalog(spark, lake, {"title": titles(spark, range(100, 200), "second")})
    found = names(tables.load_catalog(spark, lake))
    assert len(found) == 1050 and sum(v.startswith("second") for v in found.values()) == 100
    assert len(files_of(spark, lake, "title")) >= 9


def test_a_store_named_with_its_scheme_keeps_all_rows(spark, lake, monkeypatch):
    path = f"file://{lake}"
    episode = spark.createDataFrame([("tt0000004", "tt0000049", 2, 1)], TABLES["episode"])
    for few in (tables.FEW_KEYS, 0):
        monkeypatch.setattr(tables, "FEW_KEYS", few)
        tables.merge_catalog(spark, path, {"title": titles(spark, [7], f"limit{few}"), "episode": episode})
        cat = tables.load_catalog(spark, path)
        assert len(names(cat)) == 1001 and names(cat)["tt0000007"] == f"limit{few} 7"
        assert cat.episode.count() == 500


@pytest.mark.parametrize("few", [tables.FEW_KEYS, 0])
def test_replaced_and_competing_rows(spark, tmp_path, monkeypatch, few):
    """As many keys and as few: rows that leave with their title, rows that compete, keys that go, keys with a null, keys that repeat."""
    path = str(tmp_path / "lake")
    kinds = {n: TABLES[n] for n in ("title_genre", "rating", "principal")}

    def frame(name, *rows):
        return spark.createDataFrame(list(rows), kinds[name])

    def rating(key, mean, votes):
        return (key, Decimal(mean), votes)

    there = {
        "title_genre": frame("title_genre", ("t1", 1), ("t1", 2), ("t2", 1), ("t3", 3)),
        "rating": frame("rating", rating("t1", "5.0", 10), rating("t2", "5.0", 10), rating("t4", "5.0", 1), rating("t4", "5.0", 1), rating("t5", "1.0", 1)),
        "principal": frame("principal", ("t1", 1, "n2", "a", None, None), ("t1", None, "n3", "a", None, None), ("t1", None, "n4", "a", None, None), ("t2", 1, "n1", "a", None, None)),
    }
    tables.save_catalog(Catalog.of(there), path, list(there))
    monkeypatch.setattr(tables, "FEW_KEYS", few)
    tables.merge_catalog(
        spark, path,
        {
            "title_genre": frame("title_genre", ("t1", 2), ("t1", 4), ("t2", 1), ("t2", 2)),
            "rating": frame("rating", rating("t1", "6.0", 9), rating("t2", "6.0", 20), rating("t2", "7.0", 20), rating("t3", "1.0", 1)),
            "principal": frame("principal", ("t1", 1, "n1", "a", None, None), ("t2", 1, "n5", "a", None, None), ("t2", 1, "n1", "a", None, None)),
        },
        {"rating": spark.createDataFrame([("t5",), ("t1",)], "tconst string")},
        {"rating": [F.desc("num_votes"), F.desc("average_rating")]},
        {"title_genre": spark.createDataFrame([("t1",), ("t1",), ("t9",)], "tconst string")},
        ["rating"],
    )
    cat = tables.load_catalog(spark, path)
    found = {n: sorted(tuple(str(v) for v in r) for r in cat[n].select(*there[n].columns).collect()) for n in kinds}
    assert found["title_genre"] == [("t1", "2"), ("t1", "4"), ("t2", "1"), ("t2", "2"), ("t3", "3")]
    assert found["rating"] == [("t1", "5.0", "10"), ("t2", "7.0", "20"), ("t3", "1.0", "1"), ("t4", "5.0", "1"), ("t4", "5.0", "1")]
    assert [r[:3] for r in found["principal"]] == [("t1", "1", "n1"), ("t1", "None", "n3"), ("t1", "None", "n4"), ("t2", "1", "n1")]


def test_many_keys_move_once(spark, lake, monkeypatch):
    """A merge of many keys has one shuffle of rows: no join to find those that are replaced."""
    monkeypatch.setattr(tables, "FEW_KEYS", 3)
    plans = []
    write = DataFrameWriter.parquet

    def seen(writer, path, *args, **kwargs):
        if path.startswith(f"{lake}/title/"):
            plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return write(writer, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    tables.merge_catalog(spark, lake, {"title": titles(spark, range(100, 200), "second")})
    assert len(plans) == 1 and plans[0].count("Exchange ") == 1 and "Join" not in plans[0]


def test_a_row_moves_with_its_cluster_key(spark, lake):
    moved = spark.createDataFrame([("tt0000004", "tt0000049", 2, 1)], TABLES["episode"])
    tables.merge_catalog(spark, lake, {"episode": moved}, {"episode": spark.createDataFrame([("tt0000008",)], "tconst string")})
    found = {r["tconst"]: r["parent_tconst"] for r in tables.load_catalog(spark, lake).episode.collect()}
    assert len(found) == 499 and found["tt0000004"] == "tt0000049" and "tt0000008" not in found


def test_of_two_writers_one_wins(spark, lake, monkeypatch):
    inner = tables._merge_table

    def slow(*args):
        out = inner(*args)
        monkeypatch.setattr(tables, "_merge_table", inner)
        tables.merge_catalog(spark, lake, {"title": titles(spark, [1], "fast")})
        return out

    monkeypatch.setattr(tables, "_merge_table", slow)
    with pytest.raises(Taken):
        tables.merge_catalog(spark, lake, {"title": titles(spark, [3], "slow")})
    found = names(tables.load_catalog(spark, lake))
    assert found["tt0000001"] == "fast 1" and "tt0000003" not in found
    tables.merge_catalog(spark, lake, {"title": titles(spark, [3], "slow")})
    assert names(tables.load_catalog(spark, lake))["tt0000003"] == "slow 3"


def test_the_first_change_in_order_counts_and_changes_win_over_deletes(spark, lake):
    rows = titles(spark, [2], "a").unionByName(titles(spark, [2], "b"))
    key = spark.createDataFrame([("tt0000002",)], "tconst string")
    tables.merge_catalog(spark, lake, {"title": rows}, {"title": key}, {"title": [F.desc("primary_title")]})
    assert names(tables.load_catalog(spark, lake))["tt0000002"] == "b 2"


def test_a_table_may_be_emptied_and_filled(spark, lake):
    cat = tables.load_catalog(spark, lake)
    tables.merge_catalog(spark, lake, deletes={"title": cat.title.select("tconst")})
    assert tables.load_catalog(spark, lake).title.count() == 0
    tables.merge_catalog(spark, lake, {"title": titles(spark, [7])})
    assert tables.load_catalog(spark, lake).title.count() == 1


def test_loading_takes_no_job(spark, lake):
    spark.sparkContext.setJobGroup("loading", "")
    tables.load_catalog(spark, lake)["title"]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("loading")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
