"""Bitmap facets, jumps to pages and lookups by a second key against the plain queries."""

from __future__ import annotations

from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from titlelake import Catalog
from titlelake.functions.numbers import decade
from titlelake.operators.ranking import page, page_jump, save_listing
from titlelake.plans import browse, facets
from titlelake.schemas import TABLES
from titlelake.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def films(spark):
    """Enough titles for two blocks of numbers; some unrated, undated, without genre, or with all of them."""
    n, i = 40_000, F.col("id")
    title = spark.range(n).select(
        F.format_string("tt%07d", i).alias("tconst"), F.element_at(F.array(*map(F.lit, ["movie", "tvMovie", "tvSeries", "tvMiniSeries", "tvEpisode"])), (i % 5 + 1).cast("int")).alias("title_type"),
        F.lit("x").alias("primary_title"), F.lit(None).cast("string").alias("original_title"), (i % 11 == 0).alias("is_adult"),
        F.when(i % 7 > 0, 1900 + i % 90).cast("smallint").alias("start_year"), F.lit(None).cast("smallint").alias("end_year"),
        F.lit(None).cast("int").alias("runtime_minutes"), F.lit(None).cast("string").alias("poster_url"),
    )
    rating = spark.range(n).filter("id % 3 > 0").select(F.format_string("tt%07d", i).alias("tconst"), ((i % 91 + 10) / 10).cast("decimal(3,1)").alias("average_rating"), (i % 200).cast("int").alias("num_votes"))
    links = spark.range(n).select(F.format_string("tt%07d", i).alias("tconst"), F.explode(F.filter(F.array(*map(F.lit, [1, 2, 3])), lambda g: i % (g + 1) == 0)).alias("genre_id"))
    genre = spark.createDataFrame([(1, "Musical"), (2, "Noir"), (3, "War")], TABLES["genre"])
    return Catalog.of({"title": title.cache(), "rating": rating, "genre": genre, "title_genre": links})


@pytest.fixture(scope="module")
def index(films):
    return facets.build(films).cache()


def plain(cat, wanted):
    """Counts from the rows that discover lists."""
    found = browse.discover_rows(cat, **wanted).select(F.col("id").alias("tconst")).join(cat.title, "tconst")
    parts = [
        found.select(F.lit("kind").alias("facet"), F.lit(wanted.get("kind", "movie")).alias("value")),
        found.select(F.lit("decade").alias("facet"), decade(F.col("start_year")).cast("string").alias("value")),
        found.select(F.lit("adult").alias("facet"), F.col("is_adult").cast("string").alias("value")),
        found.join(cat.title_genre, "tconst").join(cat.genre, "genre_id").select(F.lit("genre").alias("facet"), F.col("name").alias("value")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows(every.filter("value is not null").groupBy("facet", "value").count())


def test_each_subset_of_filters(films, index):
    assert index.agg(F.max("block")).first()[0] == 2
    options = {"kind": "tv", "genre": "Noir", "year": 1950, "min_rating": 7.25, "include_adult": True}
    for use in product([False, True], repeat=len(options)):
        wanted = {k: v for (k, v), on in zip(options.items(), use, strict=True) if on}
        assert rows(facets.discover_facets(index, **wanted)) == plain(films, wanted), wanted
    assert facets.count_titles(index, facets.filters()).first()[0] == browse.discover_rows(films).count()
    assert rows(facets.discover_facets(index, genre="none")) == []


def test_facets_of_few_titles(edges):
    assert rows(facets.discover_facets(facets.build(edges), include_adult=True)) == plain(edges, {"include_adult": True})


def test_pages_of_a_listing(spark, tmp_path):
    n = 5000
    df = spark.range(n).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 300).alias("votes"))
    order = [F.desc_nulls_last("votes"), F.asc("id")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        save_listing(df, order, str(tmp_path / "listing"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for number in (0, 1, 2, 125, 249, 250, 251):
        want = page(df, order, 20, number).select("id", "votes", "place", "has_more", "total_pages").orderBy("place").collect()
        assert page_jump(spark, str(tmp_path / "listing"), 20, number).select("id", "votes", "place", "has_more", "total_pages").collect() == want
    jump = page_jump(spark, str(tmp_path / "listing"), 20, 125)
    assert read_rows(jump) < n / 2 and "PushedFilters: [IsNotNull(place)" in jump._jdf.queryExecution().executedPlan().toString()


def read_rows(df):
    """Rows that the scans of a query gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    total = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        leaf = leaf.plan().collectLeaves().apply(0) if "QueryStage" in leaf.getClass().getSimpleName() else leaf
        metric = leaf.metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_a_listing_without_rows(spark, tmp_path):
    save_listing(spark.range(0), [F.asc("id")], str(tmp_path / "none"))
    assert page_jump(spark, str(tmp_path / "none"), 20, 1).count() == 0


@pytest.fixture(scope="module")
def credited(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake"))
    i = F.col("id")
    title = spark.range(3000).select(F.format_string("tt%07d", i).alias("tconst"), F.lit("movie").alias("title_type"), F.lit("x").alias("primary_title"), (1950 + i % 70).cast("smallint").alias("start_year"))
    for name, kind in (("original_title", "string"), ("is_adult", "boolean"), ("end_year", "smallint"), ("runtime_minutes", "int"), ("poster_url", "string")):
        title = title.withColumn(name, F.lit(None).cast(kind))
    credits = spark.range(30_000).select(
        F.format_string("tt%07d", i % 3000).alias("tconst"), (i / 3000).cast("smallint").alias("ordering"), F.format_string("nm%07d", F.pmod(F.xxhash64("id"), F.lit(400))).alias("nconst"),
        F.lit("actor").alias("category"), F.lit(None).cast("string").alias("job"), F.lit(None).cast("string").alias("characters"),
    )
    cat = Catalog.of({
        "title": title, "principal": credits, "rating": spark.createDataFrame([("tt0000001", Decimal("7.0"), 9)], TABLES["rating"]),
        "episode": spark.createDataFrame([], TABLES["episode"]), "title_genre": spark.createDataFrame([], TABLES["title_genre"]),
        "person": spark.createDataFrame([("nm0000001", "A", None, None)], TABLES["person"]),
    })
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.save_catalog(cat, path, ["title", "principal", "rating", "episode", "title_genre", "person"])
        plain_cat = tables.load_catalog(spark, path)
        tables.save_copies(spark, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    return path, plain_cat


def test_one_person_reads_a_part_of_the_credits(spark, credited):
    path, plain_cat = credited
    cat = tables.load_catalog(spark, path)
    for ids in ("nm0000100", ["nm0000007", "nm0000399"], "nobody", spark.createDataFrame([("nm0000007",)], "nconst string")):
        assert browse.filmography(cat, ids).collect() == browse.filmography(plain_cat, ids).collect()
    one = cat.clustered("principal", "nconst").filter("nconst = 'nm0000100'")
    assert read_rows(one.select("tconst")) <= 30_000 / 2 < read_rows(plain_cat.principal.filter("nconst = 'nm0000100'").select("tconst"))


def test_a_copy_belongs_to_its_version(spark, credited):
    path, _ = credited
    tables.merge_catalog(spark, path, deletes={"person": spark.createDataFrame([("nm0000001",)], "nconst string")})
    cat = tables.load_catalog(spark, path)
    assert cat.clustered("principal", "nconst") is cat.principal
    old = tables.load_catalog(spark, path, 1)
    assert old.clustered("principal", "nconst") is not old.principal
