"""Dump files as a stream: each micro-batch of files becomes one version of a saved catalogue.

Files arrive below ``<incoming>/<dump name>/`` in any order. Of a batch, titles and people are upserted; ratings, credits and
episodes are loaded if what they refer to is known, else kept as pending and tried again with the next batch.
So after all files the catalogue is that of :func:`load.load_all`, but for genre ids, which are given in the order of arrival.
A batch costs what it and the pending rows hold, and the files that it changes.

A load store is a folder with ``catalogue``, ``pending``, ``quarantine`` (rows with a number that does not parse, by batch) and
``batches``, a small file per batch that is done. A batch that Spark runs again after it was done is left out; one that failed
before is computed anew, from the pending rows of the batch before it, and ends in the same rows.
"""

from __future__ import annotations

import json
import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from titlelake.catalog import Catalog
from titlelake.functions.text import clean
from titlelake.operators import load
from titlelake.schemas import DUMPS, TABLES
from titlelake.sources.shared import Files, shared_folder, stored, together
from titlelake.sources.tables import load_catalog, merge_catalog, save_catalog

#: Dumps whose rows wait for what they refer to.
WAITING = ["title.ratings", "title.principals", "title.episode"]


def start_load(spark: SparkSession, store: str) -> None:
    """An empty load store."""
    empty = Catalog.of({name: spark.createDataFrame([], kind) for name, kind in TABLES.items()})
    save_catalog(empty, f"{store}/catalogue", list(TABLES))


def _split(spark: SparkSession, lines: DataFrame) -> dict[str, DataFrame]:
    """The raw rows of each dump among lines (dump, value), without headers; all lines are split and written at once."""
    width = max(map(len, DUMPS.values()))
    cells = F.split("value", "\t", -1)
    headers = ["\t".join(columns) for columns in DUMPS.values()]
    header = F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(DUMPS, headers, strict=True) for x in pair]), F.col("dump"))
    own = lines.filter(F.col("dump").isin(list(DUMPS)) & (F.col("value") != header))
    folder = shared_folder(spark, "lines")
    own.select("dump", *[clean(F.get(cells, F.lit(i))).alias(f"c{i}") for i in range(width)]).write.partitionBy("dump").parquet(folder)
    schema = ", ".join([f"c{i} string" for i in range(width)] + ["dump string"])
    rows = spark.read.schema(schema).option("basePath", folder).parquet(folder)
    return {
        dump: rows.filter(F.col("dump") == dump).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
        for dump, columns in DUMPS.items()
    }


def _last(spark: SparkSession, store: str, before: int) -> dict:
    """What the last batch that is done before a number has left: ``pending`` folders by dump."""
    files = Files(spark, store)
    done = [int(n) for n in files.names("batches") if n.isdigit() and int(n) < before]
    return json.loads(files.read(f"batches/{max(done):08d}")) if done else {"pending": {}}


def load_batch(spark: SparkSession, store: str, lines: DataFrame, number: int, order: list[Column]) -> None:
    """Load one batch of lines (dump, value) and commit it as a version."""
    files = Files(spark, store)
    if files.exists(f"batches/{number:08d}"):
        return
    cat = load_catalog(spark, f"{store}/catalogue")
    raw = _split(spark, lines)

    def reject(dump: str, rows: DataFrame) -> None:
        load.quarantine(rows, dump).write.mode("overwrite").parquet(f"{store}/quarantine/{dump}/batch={number}")

    together(spark, [partial(reject, dump, rows) for dump, rows in raw.items()])
    for dump, folder in _last(spark, store, number)["pending"].items():
        kept = spark.read.schema(", ".join(f"{c} string" for c in DUMPS[dump])).parquet(f"{store}/{folder}")
        raw[dump] = raw[dump].unionByName(kept)

    title = load.load_titles(raw["title.basics"], lenient=True)
    person = load.load_people(raw["name.basics"], lenient=True)
    links = load.explode_genres(raw["title.basics"])
    genre, known, people = together(spark, [
        lambda: stored(load.build_genre_dim(links, cat.genre), "genre"),
        lambda: stored(cat.title.select("tconst").unionByName(title.select("tconst")).distinct(), "known"),
        lambda: stored(cat.person.select("nconst").unionByName(person.select("nconst")).distinct(), "known"),
    ])

    # What refers to unknown rows waits; each dump is compared with the known keys once.
    raw["title.ratings"] = raw["title.ratings"].filter("averageRating is not null and numVotes is not null")
    refers = {
        "title.ratings": {"tconst": known}, "title.principals": {"nconst": people, "tconst": known}, "title.episode": {"tconst": known, "parentTconst": known},
    }

    def compare(dump: str) -> tuple[DataFrame, str]:
        marked = stored(load.mark_known(raw[dump], refers[dump], "_known"), "known")
        folder = f"pending/{dump}/{uuid.uuid4().hex[:12]}"
        marked.filter("not _known").select(*DUMPS[dump]).write.parquet(f"{store}/{folder}")
        return marked.filter("_known").select(*DUMPS[dump]), folder

    compared = dict(zip(WAITING, together(spark, [partial(compare, dump) for dump in WAITING]), strict=True))
    ready, pending = {d: rows for d, (rows, _) in compared.items()}, {d: folder for d, (_, folder) in compared.items()}
    changes = {
        "title": title,
        "person": person,
        "genre": genre.join(cat.genre, "genre_id", "left_anti"),
        "title_genre": load.build_title_genre(links, genre),
        "rating": load.load_ratings(ready["title.ratings"], None, lenient=True, repeated=True),
        "principal": load.load_principals(ready["title.principals"], None, None, order, lenient=True, repeated=True),
        "episode": load.load_episodes(ready["title.episode"], None, lenient=True),
    }
    # A title that is sent again has the genres of its last row. Ratings and credits that are there compete with what comes, as in
    # one load of both.
    replaced, orders = {"title_genre": title.select("tconst")}, {"rating": load.rating_order(), "principal": order}
    version = merge_catalog(spark, f"{store}/catalogue", changes, None, orders, replaced, ["rating", "principal"])
    files.create(f"batches/{number:08d}", json.dumps({"version": version, "pending": pending}))


def stream_load(spark: SparkSession, incoming: str, store: str, checkpoint: str, order: list[Column], files_per_batch: int | None = None) -> StreamingQuery:
    """Load the files that have arrived, then stop; running it again with the same checkpoint goes on with new ones.

    ``order`` ranks repeated credits by columns of the credits table.
    """
    source = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    names = "|".join(name.replace(".", "[.]") for name in DUMPS)
    dump = F.regexp_extract("_metadata.file_path", f"/({names})/", 1)
    lines = source.load(incoming).select(dump.alias("dump"), "value")
    return (
        lines.writeStream.foreachBatch(lambda batch, number: load_batch(batch.sparkSession, store, batch, number, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def pending(spark: SparkSession, store: str, dump: str) -> DataFrame:
    """Rows of a dump that wait for what they refer to."""
    folder = _last(spark, store, 1 << 62)["pending"][dump]
    return spark.read.schema(", ".join(f"{c} string" for c in DUMPS[dump])).parquet(f"{store}/{folder}")
