"""Watch-link changes as a stream: validated, one row per key and batch, latest wins.

A store is a folder with ``base`` (the links before the stream, optional), ``changes``
and ``rejects``. A base link may have the time of the change that made it; one without a
time loses to any change. Each micro-batch writes its own ``batch=<id>`` folder and overwrites it
if Spark runs the batch again after a failure, so every change counts once. A batch
costs what it holds: the existing links are not rewritten. :func:`current_links` merges
on read.

:func:`compact` merges batches into sorted runs, also while the stream goes on. ``state`` holds numbered
small files; the last one names the runs and the last batch that is in them. Runs have levels: when a
level would have ``RUNS`` of them, they become one of the next, so a link is rewritten about once a level and
a read opens at most ``RUNS - 1`` runs a level and the batches since. As the newest change of a key wins in whatever order changes are
merged, a batch that is merged twice counts once.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from titlelake.operators.merge import split_valid
from titlelake.operators.ranking import first_per_key
from titlelake.sources.shared import Files, Taken

KEYS = ["tconst", "platform"]
LINK = "tconst string, platform string, url string"
CHANGE = f"{LINK}, ts timestamp, event_id bigint"

#: So many runs of a level are merged into one of the next.
RUNS = 4


def newest() -> list[Column]:
    return [F.desc("ts"), F.desc("event_id")]


def stream_upsert(changes: DataFrame, store: str, checkpoint: str, compact_every: int | None = None) -> StreamingQuery:
    """Apply a stream of changes ``tconst, platform, url, ts, event_id`` to a store.

    Takes what is available and stops; running it again with the same checkpoint goes
    on where it stopped. After every ``compact_every`` batches they are merged into a run; without
    it, :func:`compact` may be called at any time, by any process.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            valid, rejected = split_valid(batch)
            latest = first_per_key(valid, KEYS, newest())
            latest.write.mode("overwrite").parquet(f"{store}/changes/batch={number}")
            rejected.write.mode("overwrite").parquet(f"{store}/rejects/batch={number}")
        finally:
            batch.unpersist()
        spark = batch.sparkSession
        if number <= state(spark, store)["through"]:
            # A new checkpoint counts from 0 again: reads skip this number, so the batch goes into a run at once.
            compact(spark, store, again=number)
        elif compact_every and (number + 1) % compact_every == 0:
            compact(spark, store)

    return (
        changes.select("tconst", "platform", "url", "ts", "event_id")
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def change_log(spark: SparkSession, store: str, kind: str = "changes") -> DataFrame:
    """Accepted (``changes``) or rejected (``rejects``) changes of all batches."""
    return spark.read.schema(CHANGE).parquet(f"{store}/{kind}").select(
        "tconst", "platform", "url", "ts", "event_id"
    )


def start_store(links: DataFrame, store: str) -> None:
    """Begin a store with links; those of a change also have its ``ts`` and ``event_id``."""
    since = {"ts": "timestamp", "event_id": "bigint"}
    missing = {c: F.lit(None).cast(kind) for c, kind in since.items() if c not in links.columns}
    links.withColumns(missing).select("tconst", "platform", "url", *since).write.mode("overwrite").parquet(f"{store}/base")


def state(spark: SparkSession, store: str) -> dict:
    """The last state: its ``number``, the ``runs`` (folder and level), and ``through``, the last batch in them.

    Before the first compaction the base is the only run and no batch is in it.
    """
    files = Files(spark, store)
    numbers = [int(n) for n in files.names("state") if n.isdigit()]
    if numbers:
        return json.loads(files.read(f"state/{max(numbers):08d}")) | {"number": max(numbers)}
    base = [{"folder": "base", "level": 0}] if files.exists("base") else []
    return {"number": 0, "runs": base, "through": -1}


def batches(spark: SparkSession, store: str, after: int = -1) -> list[int]:
    """Numbers of the complete batches after a number."""
    files = Files(spark, store)
    found = [int(n.removeprefix("batch=")) for n in files.names("changes") if n.startswith("batch=")]
    return sorted(n for n in found if n > after and files.exists(f"changes/batch={n}/_SUCCESS"))


def parts(spark: SparkSession, store: str) -> list[str]:
    """The folders that make up the links now: runs and the batches since."""
    now = state(spark, store)
    return [r["folder"] for r in now["runs"]] + [f"changes/batch={n}" for n in batches(spark, store, now["through"])]


def merged(spark: SparkSession, store: str, folders: list[str]) -> DataFrame:
    """The newest change of each key in some folders of a store; one without a time is the oldest."""
    rows = spark.read.schema(CHANGE).parquet(*[f"{store}/{folder}" for folder in folders])
    order = [F.desc_nulls_last("ts"), F.desc_nulls_last("event_id"), F.asc("url")]
    return first_per_key(rows.select("tconst", "platform", "url", "ts", "event_id"), KEYS, order)


def compact(spark: SparkSession, store: str, again: int | None = None) -> dict:
    """Merge the batches since the last state into a sorted run, and full levels into the next; returns the new state.

    One run is written, of all that is merged; then a small file makes it part of the store. Readers see the old
    state or the new one. If another compaction was first, nothing changes and its state is returned; if it
    fails, the store stays as it is. A batch that is in the runs already is merged ``again`` on request.
    """
    now = state(spark, store)
    new = batches(spark, store, now["through"])
    taken = [f"changes/batch={n}" for n in new] + ([f"changes/batch={again}"] if again is not None else [])
    if not taken:
        return now
    level, runs = 0, now["runs"]
    while len(full := [r for r in runs if r["level"] == level]) >= RUNS - 1:
        taken += [r["folder"] for r in full]
        runs = [r for r in runs if r["level"] != level]
        level += 1
    folder = f"runs/{uuid.uuid4().hex[:12]}"
    merged(spark, store, taken).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).write.parquet(f"{store}/{folder}")
    after = {"runs": [*runs, {"folder": folder, "level": level}], "through": max([now["through"], *new])}
    try:
        Files(spark, store).create(f"state/{now['number'] + 1:08d}", json.dumps(after))
    except Taken:
        Files(spark, store).delete(folder)
        return compact(spark, store, again) if again is not None else state(spark, store)
    return after | {"number": now["number"] + 1}


def vacuum(spark: SparkSession, store: str) -> None:
    """Remove the batches and runs that the last state has replaced; readers of earlier states must have ended."""
    files, now = Files(spark, store), state(spark, store)
    if not now["number"]:
        return
    held = {r["folder"] for r in now["runs"]}
    for n in batches(spark, store):
        if n <= now["through"]:
            files.delete(f"changes/batch={n}")
    for folder in ["base", *(f"runs/{n}" for n in files.names("runs"))]:
        if folder not in held:
            files.delete(folder)
    for n in files.names("state"):
        if n.isdigit() and int(n) < now["number"]:
            files.delete(f"state/{n}")


def timed_links(spark: SparkSession, store: str) -> DataFrame:
    """The links after all batches so far, each with the time of its change if it has one."""
    found = parts(spark, store)
    if not found:
        raise FileNotFoundError(f"no store of links in {store}")
    return merged(spark, store, found)


def current_links(spark: SparkSession, store: str) -> DataFrame:
    """The links after all batches so far."""
    return timed_links(spark, store).select("tconst", "platform", "url")


def fold(spark: SparkSession, store: str, new_store: str) -> None:
    """Start a new store whose base is the current state of this one.

    Changes that a stream writes to this store later are not in the new one, so stop it first; :func:`compact` needs no stop.
    """
    start_store(timed_links(spark, store), new_store)
