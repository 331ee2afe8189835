"""Search by the trigram index against the search that compares every name."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from titlelake import Catalog
from titlelake.functions.text import contains_ci
from titlelake.operators import grams
from titlelake.plans import browse
from titlelake.schemas import TABLES
from titlelake.sources import tables

NAMES = [
    "Red Ring", "ring", "RING of Fire", "İstanbul", "ΣΊΣΥΦΟΣ", "Straße", "100% Wolf", "under_score", "back\\slash", "a", "ab", "",
    "日本語の映画", "éclair", "Ｒｉｎｇ", "tab\tname", "ring ring ring", None, "r", "🎬 film 🎬", "Ain't it", "%", "_", "xyzzy" * 30,
]
QUERIES = [
    ("ring", False), ("RING", False), ("r%g", False), ("r_ng", False), ("ri", False), ("g", False), ("%%", False), ("__", False), ("i%f", False),
    ("100\\%", False), ("100%", True), ("r_s", True), ("r\\_s", False), ("k\\\\s", False), ("k\\s", True), ("k\\", False), ("istanbul", False), ("İst", False),
    ("σίσυφος", False), ("ΣΊΣ", False), ("σίς", False), ("STRASSE", False), ("straß", False), ("日本", False), ("語", False), ("éc", False), ("Ｒｉ", False),
    ("🎬", False), ("m 🎬", False), ("b\tn", False), ("'t", False), ("nothing here", False), ("xyzzy" * 29, False), ("ing r%ing", False), ("%", True),
]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(f"tt{i:03d}", name) for i, name in enumerate(NAMES)], "id string, name string")


@pytest.fixture(scope="module")
def index(spark, names, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    grams.save(grams.build(names), path)
    return grams.load(spark, path)


def test_every_query_finds_what_a_scan_finds(names, index):
    for query, literal in QUERIES:
        want = sorted(names.filter(contains_ci(F.col("name"), query, literal)).collect())
        assert sorted(grams.matches(index, query, literal).collect()) == want, query


def test_random_queries_over_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grams, "BLOCK", 50)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abAB é") for _ in range(rng.randrange(12))) for _ in range(400)]
    names = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "id string, name string")
    grams.save(grams.build(names), str(tmp_path / "i"))
    index = grams.load(spark, str(tmp_path / "i"))
    assert index.names.agg(F.max("block"), F.max("place")).first() == (7, 49)
    assert index.postings.filter(F.size("places") > 50).count() == 0
    for _ in range(12):
        query = "".join(rng.choice("abAB é%_") for _ in range(rng.randrange(1, 6)))
        want = sorted(names.filter(contains_ci(F.col("name"), query)).collect())
        assert sorted(grams.matches(index, query).collect()) == want, query


def test_pieces_of_a_pattern():
    assert grams.pieces("%ab_c\\%d%%e\\\\f%") == ["ab", "c%d", "e\\f"]
    assert grams.pieces("%%%") == []


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake"))
    rows = [(f"tt{i:04d}", "movie", f"Ring {i} of {i % 7}", None, i % 9 == 0, 1990, None, None, None) for i in range(300)]
    people = [(f"nm{i:04d}", f"Kim {i % 50} Ring", None, None) for i in range(200)]
    cat = Catalog.of({
        "title": spark.createDataFrame(rows, TABLES["title"]), "person": spark.createDataFrame(people, TABLES["person"]),
        "rating": spark.createDataFrame([(f"tt{i:04d}", None, i % 11) for i in range(0, 300, 2)], TABLES["rating"]),
    })
    tables.save_catalog(cat, path, ["title", "person", "rating"])
    tables.save_search(spark, path)
    return path


def test_pages_are_those_of_the_search_without_index(spark, lake):
    cat, index = tables.load_catalog(spark, lake), tables.load_search(spark, lake)
    for query, more in [("ring 1", {}), ("g 2%of", {"number": 2}), ("of 3", {"include_adult": True}), ("zz", {}), ("5", None)]:
        if more is None:
            with pytest.raises(ValueError):
                browse.search_titles_indexed(cat, index["title"], query)
            continue
        want = browse.search_titles(cat, query, **more).collect()
        assert browse.search_titles_indexed(cat, index["title"], query, **more).collect() == want
    for query in ("kim 4", "m 1% r"):
        assert browse.search_people_indexed(cat, index["person"], query).collect() == browse.search_people(cat, query).collect()


def test_the_plan_reads_postings_and_the_titles_found(spark, lake):
    cat, index = tables.load_catalog(spark, lake), tables.load_search(spark, lake)
    plan = grams.candidates(index["title"], "ring 1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and "primary_title" not in plan and "names" not in plan
    page = browse.search_titles_indexed(cat, index["title"], "ring 17")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "tt0017" in plan.split("PushedFilters")[1] and "ilike" not in plan.lower().split("pushedfilters")[0]


def test_an_index_belongs_to_a_version(spark, lake):
    version = tables.merge_catalog(spark, lake, {"title": spark.createDataFrame([("tt9999", "movie", "Ring new", None, False, None, None, None, None)], TABLES["title"])})
    with pytest.raises(FileNotFoundError):
        tables.load_search(spark, lake)
    assert tables.load_search(spark, lake, version - 1)["title"].names.count() == 300
    tables.save_search(spark, lake)
    assert [r["id"] for r in grams.matches(tables.load_search(spark, lake)["title"], "g new").collect()] == ["tt9999"]
