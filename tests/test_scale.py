"""Skewed keys and the shape of plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from titlelake.operators.joins import HOT_KEYS, attach, attach_few, fits_broadcast, moved
from titlelake.operators.ranking import cap_per_group, number_by
from titlelake.plans import analysis, browse, documents


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same(left, right):
    columns = sorted(left.columns)
    assert sorted(right.columns) == columns
    assert sorted(map(str, left.select(columns).collect())) == sorted(map(str, right.select(columns).collect()))


@pytest.fixture
def skewed(spark):
    """A third of the rows hold one key, some have none, and more keys exist than can be hot."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 != 1, F.col("id") % (HOT_KEYS + 100))
    facts = spark.range(6000).select(F.col("id"), key.cast("int").alias("k"))
    dim = spark.range(HOT_KEYS).select(F.col("id").cast("int").alias("k"), F.col("id").alias("v"))
    return facts, dim


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_gives_the_rows_of_the_plain_join(skewed, how, no_broadcast):
    facts, dim = skewed
    assert not fits_broadcast(dim)
    same(attach(facts, dim, "k", "id", how), facts.join(dim, "k", how))


def test_salted_join_spreads_the_hot_key(spark, skewed, no_broadcast):
    facts, dim = skewed
    # Tiny partitions would be merged again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = attach(facts, dim, "k", "id").filter("k = 7")
        spread = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in spread) > 2000
    assert len(spread) > 1
    assert max(r["count"] for r in spread) < 1200


def test_small_side_is_left_to_spark(skewed):
    facts, dim = skewed
    assert fits_broadcast(dim)
    assert "_salt" not in plan(attach(facts, dim, "k", "id"))


def test_numbers_are_dense_and_in_order(spark):
    names = ["b", "ab", "aa", "é", "B", "", "z", "日本", "a"]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    found = sorted((r["n"], r["name"]) for r in number_by(df, "name", "n", 10).collect())
    assert found == list(enumerate(sorted(names), 11))


def test_a_million_names_that_begin_alike_are_numbered_in_several_tasks(spark):
    n = 1_000_000
    name = F.concat(F.lit("same-start-"), F.lpad(F.pmod(F.col("id") * 7919, F.lit(n)).cast("string"), 7, "0"))
    numbered = number_by(spark.range(n).select(name.alias("name"), F.spark_partition_id().alias("_read")), "name", "n", kind="bigint")
    right = numbered.filter(F.col("n") == F.substring("name", 12, 7).cast("bigint") + 1)
    assert right.count() == n
    file = F.col("_metadata.file_path")
    parts = [r["count"] for r in spark.read.parquet(*numbered.inputFiles()).groupBy(file).count().collect()]
    assert len(parts) > 1 and max(parts) < 0.6 * n


def test_caps_prune_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    found = cap_per_group(df, ["k"], [F.desc("id")], 2)
    before_shuffle = plan(found).split("Exchange")[-1]
    assert "WindowGroupLimit" in before_shuffle
    assert sorted(r["id"] for r in found.collect()) == [994, 995, 996, 997, 998, 999]


def test_results_do_not_depend_on_broadcasts(edges, spark):
    queries = [
        lambda c: browse.full_credits(c), lambda c: browse.top_cast(c), lambda c: browse.title_crew(c),
        lambda c: browse.title_genres_string(c), lambda c: documents.title_documents(c),
        lambda c: documents.credits_by_category(c), lambda c: documents.person_documents(c),
        lambda c: analysis.prolific_actors(c, 1), lambda c: analysis.top_directors(c, 1),
        lambda c: analysis.genre_popularity(c, 1), lambda c: browse.home_top_rated(c),
        lambda c: browse.filmography(c, c.person.select("nconst")),
    ]
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    for query in queries:
        wanted = sorted(map(str, query(edges).collect()))
        spark.conf.set(name, "-1")
        try:
            assert sorted(map(str, query(edges).collect())) == wanted
        finally:
            spark.conf.set(name, before)


def test_no_query_pairs_everything(edges, no_broadcast):
    for query in (
        browse.full_credits, browse.filmography, browse.home_top_rated, browse.series_episodes,
        documents.title_documents, documents.person_documents, documents.credits_by_category,
        analysis.genre_popularity, analysis.prolific_actors, analysis.top_directors, analysis.ratings_by_decade,
    ):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(query(edges))), query


def test_lists_are_top_k_and_lookups_reach_the_scan(spark, edges, tmp_path):
    assert "TakeOrderedAndProject" in plan(browse.home_top_rated(edges))
    assert "TakeOrderedAndProject" in plan(analysis.top_directors(edges))
    path = str(tmp_path / "title")
    edges.title.write.parquet(path)
    cat = edges.replace(title=spark.read.parquet(path))
    scan = plan(browse.title_summary(cat, ["tt1", "tt2"]))
    assert "In(tconst, [tt1,tt2])" in scan
    narrow = plan(analysis.ratings_by_decade(cat))
    assert "ReadSchema: struct<tconst:string,title_type:string,start_year:smallint>" in narrow
    assert "GreaterThanOrEqual(start_year,1890)" in narrow


def test_a_stored_table_with_small_files_and_many_rows_is_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "dim")
    spark.range(60_000).select(F.format_string("tt%09d", "id").alias("k"), (F.col("id") % 7).alias("v")).write.parquet(path)
    dim = spark.read.parquet(path)
    facts = spark.range(100).select(F.format_string("tt%09d", "id").alias("k"), "id")
    size = int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(2 * size))
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            for joined in (attach(facts, dim, "k", "id", how), facts.join(moved(dim), "k", how)):
                assert "SortMergeJoin" in plan(joined), how
                same(joined, facts.join(dim, "k", how))
    finally:
        spark.conf.set(name, before)


def test_a_derived_table_of_few_rows_is_counted_and_broadcast(spark, monkeypatch):
    facts = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    dim = spark.range(50_000).select((F.col("id") % 5).alias("k")).distinct().withColumn("v", F.col("k") * 2)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1k")
    try:
        assert not fits_broadcast(dim)
        for how in ("inner", "left", "left_semi", "left_anti"):
            joined = attach_few(facts, dim, "k", "id", how)
            assert "BroadcastHashJoin" in plan(joined) and "_salt" not in plan(joined)
            same(joined, facts.join(dim, "k", how))
        monkeypatch.setattr("titlelake.operators.joins.FEW_ROWS", 4)
        joined = attach_few(facts, dim, "k", "id")
        assert "_salt" in plan(joined)
        same(joined, facts.join(dim, "k"))
    finally:
        spark.conf.set(name, before)
