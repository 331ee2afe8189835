from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from titlelake.operators.merge import split_valid, upsert_latest
from titlelake.sources.shared import shared_folder
from titlelake.streaming import links, trending


def changes(spark, numbers):
    """Change ``n`` touches key ``n % 7``; some are incomplete and times run backwards in part."""
    n = F.col("id")
    return numbers.select(
        F.concat(F.lit("tt"), (n % 7).cast("string")).alias("tconst"),
        F.when(n % 11 != 0, F.lit("view")).alias("platform"),
        F.when(n % 13 == 0, "").otherwise(F.concat(F.lit("u"), n.cast("string"))).alias("url"),
        F.timestamp_seconds(F.when(n % 5 == 0, n - 40).otherwise(n) + 1_000_000).alias("ts"),
        n.alias("event_id"),
    )


def rows(df):
    return sorted(map(tuple, df.select("tconst", "platform", "url").collect()))


@pytest.fixture
def base(spark):
    return spark.createDataFrame(
        [("tt0", "view", "old"), ("tt0", "archive", "kept"), ("tt99", "view", "kept")], links.LINK
    )


def put(spark, source, start, end):
    changes(spark, spark.range(start, end, 1, 2)).write.mode("append").parquet(source)


def run(spark, source, store):
    stream = spark.readStream.schema(links.CHANGE).option("maxFilesPerTrigger", 1).parquet(source)
    query = links.stream_upsert(stream, store, f"{store}/checkpoint")
    query.awaitTermination()
    return query


def test_stream_ends_in_the_batch_result(spark, base, tmp_path):
    source, store = str(tmp_path / "source"), str(tmp_path / "store")
    links.start_store(base, store)
    assert rows(links.current_links(spark, store)) == rows(base)
    put(spark, source, 0, 100)
    run(spark, source, store)
    put(spark, source, 100, 150)
    run(spark, source, store)
    run(spark, source, store)
    everything = changes(spark, spark.range(150))
    valid, rejected = split_valid(everything)
    wanted = rows(upsert_latest(base, valid, links.KEYS, links.newest()))
    assert rows(links.current_links(spark, store)) == wanted
    assert links.change_log(spark, store, "rejects").count() == rejected.count()
    folded = str(tmp_path / "folded")
    links.fold(spark, store, folded)
    assert rows(links.current_links(spark, folded)) == wanted


def test_a_batch_run_twice_counts_once(spark, base, tmp_path):
    source, store = str(tmp_path / "source"), str(tmp_path / "store")
    links.start_store(base, store)
    put(spark, source, 0, 60)
    run(spark, source, store)
    once = rows(links.current_links(spark, store))
    rejects = links.change_log(spark, store, "rejects").count()
    # Without the old checkpoint all batches are written again, under the same numbers.
    stream = spark.readStream.schema(links.CHANGE).option("maxFilesPerTrigger", 1).parquet(source)
    links.stream_upsert(stream, store, f"{store}/checkpoint2").awaitTermination()
    assert rows(links.current_links(spark, store)) == once
    assert links.change_log(spark, store, "rejects").count() == rejects


def test_store_without_base(spark, tmp_path):
    source, store = str(tmp_path / "source"), str(tmp_path / "store")
    put(spark, source, 1, 5)
    run(spark, source, store)
    assert len(rows(links.current_links(spark, store))) == 4


def test_a_late_older_change_loses_after_a_fold(spark, tmp_path):
    store, folded = str(tmp_path / "store"), str(tmp_path / "folded")
    change = "select 'tt1' tconst, 'web' platform, '{}' url, timestamp'{}' ts, bigint({}) event_id"
    links.start_store(spark.createDataFrame([("tt1", "web", "first")], links.LINK), store)
    spark.sql(change.format("new", "2024-05-01", 2)).write.parquet(f"{store}/changes/batch=0")
    links.fold(spark, store, folded)
    spark.sql(change.format("older", "2024-04-01", 3)).write.parquet(f"{folded}/changes/batch=0")
    assert [r["url"] for r in links.current_links(spark, folded).collect()] == ["new"]


@pytest.fixture
def plenty(spark, base, tmp_path):
    """A store and a source of 12 files of 30 changes, a file a batch."""
    source, store = str(tmp_path / "source"), str(tmp_path / "store")
    links.start_store(base, store)
    for start in range(0, 360, 30):
        changes(spark, spark.range(start, start + 30, 1, 1)).write.mode("append").parquet(source)
    valid, _ = split_valid(changes(spark, spark.range(360)))
    return source, store, rows(upsert_latest(base, valid, links.KEYS, links.newest()))


def start(spark, source, store, **more):
    stream = spark.readStream.schema(links.CHANGE).option("maxFilesPerTrigger", 1).parquet(source)
    return links.stream_upsert(stream, store, f"{store}/checkpoint", **more)


def test_compaction_inside_the_stream_bounds_what_a_read_opens(spark, plenty):
    source, store, wanted = plenty
    start(spark, source, store, compact_every=2).awaitTermination()
    assert rows(links.current_links(spark, store)) == wanted
    now = links.state(spark, store)
    assert now["through"] == 11 and now["number"] == 6
    # Base and six runs of two batches: levels hold three at most.
    assert len(links.parts(spark, store)) == len(now["runs"]) <= 4
    assert max(r["level"] for r in now["runs"]) == 1
    links.vacuum(spark, store)
    assert rows(links.current_links(spark, store)) == wanted
    assert links.batches(spark, store) == []


def test_compaction_beside_a_running_stream(spark, plenty):
    source, store, wanted = plenty
    query = start(spark, source, store)
    seen = 0
    while query.isActive:
        seen = max(seen, links.compact(spark, store)["through"])
    query.awaitTermination()
    assert rows(links.current_links(spark, store)) == wanted
    links.compact(spark, store)
    assert links.state(spark, store)["through"] == 11
    assert rows(links.current_links(spark, store)) == wanted
    assert links.change_log(spark, store, "rejects").count() > 0


def test_of_two_compactions_one_wins(spark, plenty, monkeypatch):
    source, store, wanted = plenty
    start(spark, source, store).awaitTermination()
    inner = links.merged

    def slow(*args):
        monkeypatch.setattr(links, "merged", inner)
        links.compact(spark, store)
        return inner(*args)

    monkeypatch.setattr(links, "merged", slow)
    assert links.compact(spark, store)["number"] == 1
    assert len(links.state(spark, store)["runs"]) == 2
    assert rows(links.current_links(spark, store)) == wanted


def test_a_failed_compaction_changes_nothing(spark, plenty, monkeypatch):
    source, store, wanted = plenty
    start(spark, source, store).awaitTermination()
    monkeypatch.setattr(links, "merged", lambda *a: spark.range(1).select(F.raise_error(F.lit("stop")).alias("tconst"), F.lit("x").alias("platform")))
    with pytest.raises(Exception, match="stop"):
        links.compact(spark, store)
    monkeypatch.undo()
    assert links.state(spark, store)["number"] == 0
    assert rows(links.current_links(spark, store)) == wanted


def test_a_new_checkpoint_after_a_compaction_loses_nothing(spark, plenty, tmp_path):
    source, store, wanted = plenty
    start(spark, source, store, compact_every=3).awaitTermination()
    more = str(tmp_path / "more")
    late = "select 'tt3' tconst, 'view' platform, 'late' url, timestamp'2030-01-01' ts, bigint(999) event_id"
    spark.sql(late).write.parquet(more)
    stream = spark.readStream.schema(links.CHANGE).parquet(more)
    links.stream_upsert(stream, store, f"{store}/other").awaitTermination()
    found = {r[:2]: r[2] for r in rows(links.current_links(spark, store))}
    assert found == {r[:2]: r[2] for r in wanted} | {("tt3", "view"): "late"}


def test_a_missing_store_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        links.current_links(spark, str(tmp_path / "nothing"))


def test_folders_lie_under_the_shared_one(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_weekly_counts_over_batches(spark):
    store = shared_folder(spark, "trending")
    week = 7 * 86400
    for times in ([0, 1, week - 1], [2, week, 3 * week]):
        data = [("tt1", t) for t in times]
        events = spark.createDataFrame(data, "tconst string, t long").select("tconst", F.timestamp_seconds("t").alias("ts"))
        events.coalesce(1).write.mode("append").parquet(f"{store}/events")
        stream = spark.readStream.schema("tconst string, ts timestamp").parquet(f"{store}/events")
        trending.stream_counts(stream, store, f"{store}/checkpoint", late="28 days").awaitTermination()
    found = trending.current_counts(spark, store).select(F.unix_seconds("start"), "views").collect()
    assert sorted(map(tuple, found)) == [(0, 4), (week, 1), (3 * week, 1)]
