"""Dumps that arrive in batches against one load of all of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from titlelake.operators import load
from titlelake.schemas import DUMPS
from titlelake.sources.dumps import read_dump
from titlelake.sources import tables as tables_of_files
from titlelake.sources.tables import load_catalog, versions
from titlelake.streaming import dumps

ORDER = ["nconst", "category"]
# By batch and dump. Credits come before their people and titles, an episode before its series, a rating before its title.
BATCHES = [
    {
        "title.basics": ["tt1\tmovie\tA\tA\t0\t1990\t\\N\t90\tWar,Noir", "tt2\ttvSeries\tB\tB\t0\t19x0\t\\N\t\\N\t\\N"],
        "title.principals": ["tt1\t1\tnm2\tactor\t\\N\t\\N", "tt9\t1\tnm1\tactor\t\\N\t\\N", "tt1\t2\tnm7\twriter\t\\N\t\\N", "tt1\t3\tnm1\teditor\t\\N\t\\N"],
        "title.ratings": ["tt1\t7.5\t100", "tt3\t6.0\t10", "tt2\t\\N\t5"],
    },
    {
        "name.basics": ["nm1\tAna\t1950\t\\N\t\\N\t\\N", "nm2\tBen\t\\N\t\\N\t\\N\t\\N"],
        "title.episode": ["tt4\ttt2\t1\t2", "tt3\ttt8\t1\t1"],
        "title.ratings": ["tt1\t7.6\t90", "tt4\t5.5\t7"],
        "title.basics": ["tt4\ttvEpisode\tD\tD\t0\t1991\t\\N\t30\tComedy,War"],
    },
    {
        "title.basics": ["tt3\ttvEpisode\tC\tC\t1\t1992\t\\N\t30\tAction", "tt8\ttvSeries\tH\tH\t0\t1992\t\\N\t\\N\tNoir"],
        "title.principals": ["tt1\t1\tnm1\tactress\t\\N\t[\"X\"]", "tt3\t1\tnm2\tactor\t\\N\t\\N"],
        "title.ratings": ["tt1\t7.7\t200", "tt5\t1.0\t1"],
    },
]


def put(folder, batch, number):
    for dump, lines in batch.items():
        path = folder / dump
        path.mkdir(parents=True, exist_ok=True)
        (path / f"part-{number}.tsv").write_text("\n".join(["\t".join(DUMPS[dump]), *lines]) + "\n")


def tables(cat):
    """The loaded tables, genres by name."""
    named = cat.title_genre.join(cat.genre, "genre_id").select("tconst", "name")
    frames = {name: cat[name] for name in ("title", "person", "rating", "principal", "episode")}
    frames |= {"links": named, "genres": cat.genre.select("name")}
    return {name: sorted(map(tuple, df.collect()), key=str) for name, df in frames.items()}


@pytest.fixture
def want(spark, tmp_path):
    for number, batch in enumerate(BATCHES):
        put(tmp_path / "all", batch, number)
    raw = {dump: read_dump(spark, str(tmp_path / "all" / dump), dump) for dump in DUMPS}
    return tables(load.load_all(raw, [F.asc(c) for c in ORDER], lenient=True))


def run(spark, folder, store):
    dumps.stream_load(spark, str(folder), store, f"{store}/checkpoint", [F.asc(c) for c in ORDER]).awaitTermination()


def test_three_batches_end_in_one_load_of_all(spark, tmp_path, want):
    store = str(tmp_path / "store")
    dumps.start_load(spark, store)
    for number, batch in enumerate(BATCHES):
        put(tmp_path / "incoming", batch, number)
        run(spark, tmp_path / "incoming", store)
        run(spark, tmp_path / "incoming", store)
    assert tables(load_catalog(spark, f"{store}/catalogue")) == want
    assert versions(spark, f"{store}/catalogue") == [1, 2, 3, 4]
    waiting = {dump: sorted(r[0] for r in dumps.pending(spark, store, dump).collect()) for dump in dumps.WAITING}
    assert waiting == {"title.ratings": ["tt5"], "title.principals": ["tt1", "tt9"], "title.episode": []}
    bad = spark.read.parquet(f"{store}/quarantine/title.basics").select("tconst", "startYear")
    assert [tuple(r) for r in bad.collect()] == [("tt2", "19x0")]


def test_many_keys_a_batch_in_a_store_named_with_its_scheme(spark, tmp_path, want, monkeypatch):
    """Each table is merged by ranges, and the rows that are there stay."""
    monkeypatch.setattr(tables_of_files, "FEW_KEYS", 0)
    store = f"file://{tmp_path}/store"
    dumps.start_load(spark, store)
    for number, batch in enumerate(BATCHES):
        put(tmp_path / "incoming", batch, number)
        run(spark, tmp_path / "incoming", store)
    assert tables(load_catalog(spark, f"{store}/catalogue")) == want


def test_rows_are_compared_with_known_keys_once(spark, tmp_path, monkeypatch):
    asked = []
    inner = load.mark_known
    monkeypatch.setattr(load, "mark_known", lambda raw, references, mark: asked.append(sorted(references)) or inner(raw, references, mark))
    store = str(tmp_path / "store")
    dumps.start_load(spark, store)
    put(tmp_path / "incoming", BATCHES[0], 0)
    run(spark, tmp_path / "incoming", store)
    assert sorted(asked) == [["nconst", "tconst"], ["parentTconst", "tconst"], ["tconst"]]


def test_a_batch_that_fails_after_its_merge_is_run_again(spark, tmp_path, want, monkeypatch):
    store = str(tmp_path / "store")
    dumps.start_load(spark, store)
    inner = dumps.merge_catalog

    def once(*args):
        inner(*args)
        monkeypatch.setattr(dumps, "merge_catalog", inner)
        raise RuntimeError("lost")

    for number, batch in enumerate(BATCHES):
        put(tmp_path / "incoming", batch, number)
        if number == 1:
            monkeypatch.setattr(dumps, "merge_catalog", once)
            with pytest.raises(Exception, match="lost"):
                run(spark, tmp_path / "incoming", store)
        run(spark, tmp_path / "incoming", store)
    assert tables(load_catalog(spark, f"{store}/catalogue")) == want


def test_a_batch_that_is_done_is_left_out(spark, tmp_path):
    store = str(tmp_path / "store")
    dumps.start_load(spark, store)
    put(tmp_path / "incoming", BATCHES[0], 0)
    run(spark, tmp_path / "incoming", store)
    again = spark.createDataFrame([("title.basics", "tt7\tmovie\tA\tA\t0\t1990\t\\N\t90\tWar")], "dump string, value string")
    dumps.load_batch(spark, store, again, 0, [F.asc("nconst")])
    assert versions(spark, f"{store}/catalogue") == [1, 2]
