"""Integrity and trend states that are moved on against the full computation."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from titlelake.operators import checks, integrity
from titlelake.operators.merge import cascade_delete
from titlelake.plans import analysis, trends
from titlelake.schemas import TABLES
from titlelake.sources import tables
from titlelake.sources.shared import Taken


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def lake(spark, edges, tmp_path):
    path = str(tmp_path / "lake")
    tables.save_catalog(edges, path, list(TABLES))
    return path


def step(spark, path, number):
    """Changes that break and mend references and keys, rename people, and end in a reload."""
    row = lambda text, name: spark.createDataFrame(text, TABLES[name])
    key = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    if number == 1:  # A parent goes, a child without parent comes, a rating changes.
        return tables.merge_catalog(
            spark, path,
            {"rating": row([("tt1", None, 5), ("tt77", None, 1)], "rating"), "person": row([("nm3", "Ana", None, None), ("nm5", None, None, None)], "person")},
            {"title": key(["tt4"], "tconst")},
        )
    if number == 2:  # The parent comes back, another goes, credits change.
        return tables.merge_catalog(
            spark, path,
            {"title": row([("tt4", "movie", "Back", None, True, 1955, None, None, None)], "title"),
             "principal": row([("tt2", 1, "nm3", "director", None, None), ("tt4", 9, "nm9", "actor", None, None)], "principal"),
             "title_genre": row([("tt2", 2), ("tt2", 8)], "title_genre")},
            {"person": key(["nm1"], "nconst")},
        )
    cat = tables.load_catalog(spark, path)
    left = cascade_delete(cat, cat.title.filter("title_type = 'videoGame'"))
    twice = left.replace(genre=left.genre.unionByName(left.genre.filter("genre_id = 1").withColumn("genre_id", F.lit(7))), title=left.title.unionByName(left.title.limit(1)))
    return tables.save_catalog(twice, path, list(TABLES))


def test_a_state_equals_the_full_check_after_each_change(spark, lake, tmp_path):
    state = str(tmp_path / "state")
    integrity.start(tables.load_catalog(spark, lake), state)
    for number in (1, 2, 3):
        version = step(spark, lake, number)
        integrity.advance(spark, state, *tables.differences(spark, lake, version - 1, version))
        want = sorted_rows(checks.violations(tables.load_catalog(spark, lake), list(TABLES)))
        assert sorted_rows(integrity.report(spark, state)) == want, number
        assert sum(r[2] for r in want) > 0


def test_many_changes_are_added_up(spark, lake, tmp_path, monkeypatch):
    monkeypatch.setattr(integrity, "DELTAS", 2)
    state = str(tmp_path / "state")
    integrity.start(tables.load_catalog(spark, lake), state)
    for number in (1, 2, 3):
        version = step(spark, lake, number)
        integrity.advance(spark, state, *tables.differences(spark, lake, version - 1, version))
        assert len(integrity._state(spark, state)["counts"]) <= 2
    want = sorted_rows(checks.violations(tables.load_catalog(spark, lake), list(TABLES)))
    assert sorted_rows(integrity.report(spark, state)) == want


def test_of_two_that_move_a_state_on_one_wins(spark, lake, tmp_path, monkeypatch):
    state = str(tmp_path / "state")
    integrity.start(tables.load_catalog(spark, lake), state)
    now = integrity._state(spark, state)
    changes = tables.differences(spark, lake, 1, step(spark, lake, 1))
    integrity.advance(spark, state, *changes)
    monkeypatch.setattr(integrity, "_state", lambda *a: now)
    with pytest.raises(Taken):
        integrity.advance(spark, state, *changes)


def test_rows_and_keys_are_counted_apart(spark, edges):
    broken = edges.replace(principal=edges.principal.withColumn("nconst", F.when(F.col("nconst") == "nm1", "gone").otherwise(F.col("nconst"))))
    found = {r["rule"]: (r["violations"], r["rows"]) for r in checks.violations(broken, ["principal"]).collect()}
    assert found["nconst not in person"] == (1, edges.principal.filter("nconst = 'nm1'").count())


def test_trend_states_equal_the_tables_after_each_change(spark, lake, tmp_path):
    state = str(tmp_path / "state")
    trends.start(tables.load_catalog(spark, lake), state)
    for number in (1, 2, 3):
        before = tables.load_catalog(spark, lake)
        version = step(spark, lake, number)
        removed, added = tables.differences(spark, lake, version - 1, version)
        rows = {name: trends.differing(removed[name], added[name]) for name in removed}
        after = tables.load_catalog(spark, lake)
        trends.advance(before, after, state, rows)
        now = trends.sums(spark, state)
        assert trends.ratings_by_decade(now).collect() == analysis.ratings_by_decade(after).collect()
        assert trends.decade_counts(now).collect() == analysis.decade_counts(after).collect()
        assert trends.top_directors(now, 1).collect() == analysis.top_directors(after, 1).collect()
        assert trends.genre_popularity(now, 1).collect() == analysis.genre_popularity(after, 1).collect()
        assert trends.prolific_actors(now, 1).collect() == analysis.prolific_actors(after, 1).collect()


def test_unchanged_titles_add_nothing_to_a_change(spark, lake, tmp_path):
    state = str(tmp_path / "state")
    before = tables.load_catalog(spark, lake)
    trends.start(before, state)
    removed, added = tables.differences(spark, lake, 1, step(spark, lake, 1))
    rows = {name: trends.differing(removed[name], added[name]) for name in removed}
    titles = trends.changed_titles(before, tables.load_catalog(spark, lake), rows)
    # tt4 went, tt1 and tt77 are rated anew, nm3 is renamed in tt1 and tt4.
    assert sorted(r[0] for r in titles.collect()) == ["tt1", "tt4", "tt77"]
    trends.advance(before, tables.load_catalog(spark, lake), state, {})
    assert trends._state(spark, state)["number"] == 1
