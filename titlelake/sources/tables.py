"""Saved catalogues: versions of parquet tables clustered by key, changed file by file, or bucketed tables.

A catalogue is a folder. ``versions/<number>`` is a small text file with one line per table: either the
folder that holds its files, or ``files/<name>``, a list of its files with the first and
last cluster key of each. A version never changes; a new one may share files with those before.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_right
from collections.abc import Collection
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titlelake.catalog import Catalog
from titlelake.operators import grams
from titlelake.operators.grams import NameIndex
from titlelake.operators.joins import moved
from titlelake.operators.ranking import first_per_key
from titlelake.schemas import PRIMARY_KEYS, TABLES
from titlelake.sources.shared import Files, stored, together

# The column each table is mostly joined and looked up by.
CLUSTER = {
    "title": "tconst",
    "person": "nconst",
    "episode": "parent_tconst",
    "principal": "tconst",
    "genre": "genre_id",
    "title_genre": "tconst",
    "rating": "tconst",
    "streaming_link": "tconst",
}

VERSIONS, LISTS, SEARCH, COPIES = "versions", "files", "search", "copies"

# Columns that tables are looked up by besides their cluster column.
SECOND_KEYS = [("principal", "nconst"), ("title_genre", "genre_id"), ("episode", "tconst")]

# Tables with names to search: key and name.
NAMED = {"title": ("tconst", "primary_title"), "person": ("nconst", "primary_name")}

#: Up to this many keys, the files that a change touches are found one key at a time.
FEW_KEYS = 10_000


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a saved catalogue, oldest first."""
    return sorted(int(name) for name in Files(spark, path).names(VERSIONS) if name.isdigit())


def folders(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """Where each table of a version (the latest by default) lies, relative to the catalogue."""
    known = versions(spark, path)
    if not known:
        return {}
    lines = Files(spark, path).read(f"{VERSIONS}/{version or known[-1]:08d}").splitlines()
    return dict(line.split("=", 1) for line in lines)


def _listed(spark: SparkSession, path: str, place: str) -> list[dict]:
    """The files of a table: ``file``, its first and last cluster key ``low`` and ``high``, and its ``rows``."""
    return [json.loads(line) for line in Files(spark, path).read(place).splitlines()]


def _file(folder: str) -> Column:
    """The file of a row, relative to a folder above it.

    Spark may spell the scheme of a path in another way (``file:/`` for ``file:///``), so only what follows it is compared.
    """
    folder = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder)
    whole = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return F.substring_index(whole, f"{folder.rstrip('/')}/", -1)


def _ranges(spark: SparkSession, path: str, name: str, folder: str) -> list[dict]:
    """The files of a folder with their ranges; reads the cluster column only."""
    key = F.col(CLUSTER[name])
    rows = spark.read.option("recursiveFileLookup", "true").schema(TABLES[name]).parquet(f"{path}/{folder}")
    found = rows.groupBy(_file(folder).alias("file")).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows")
    )
    return [r.asDict() | {"file": f"{folder}/{r['file']}"} for r in found.collect()]


def _open(spark: SparkSession, path: str, name: str, place: str) -> DataFrame:
    if not place.startswith(f"{LISTS}/"):
        return spark.read.schema(TABLES[name]).parquet(f"{path}/{place}")
    return _read(spark, name, [f"{path}/{f['file']}" for f in _listed(spark, path, place)])


def _read(spark: SparkSession, name: str, files: list[str], below: str | None = None) -> DataFrame:
    """Rows of some files, with their ``_file`` below a folder if that is given."""
    if not files:
        return spark.createDataFrame([], TABLES[name] + (", _file string" if below else ""))
    rows = spark.read.option("recursiveFileLookup", "true").schema(TABLES[name]).parquet(*files)
    return rows.withColumn("_file", _file(below)) if below else rows


def load_catalog(spark: SparkSession, path: str, version: int | None = None) -> Catalog:
    """A saved catalogue in its latest version or an earlier one; takes no Spark job."""
    where = folders(spark, path, version)
    if not where:
        raise FileNotFoundError(f"no saved catalogue in {path}")
    number = version or versions(spark, path)[-1]
    copies = set(Files(spark, path).names(f"{COPIES}/{number:08d}"))

    def copy(name: str, column: str) -> DataFrame | None:
        folder = f"{name}-{column}"
        return spark.read.schema(TABLES[name]).parquet(f"{path}/{COPIES}/{number:08d}/{folder}") if folder in copies else None

    return Catalog(lambda name: _open(spark, path, name, where[name]), copy)


def _commit(spark: SparkSession, path: str, number: int, where: dict[str, str]) -> int:
    Files(spark, path).create(f"{VERSIONS}/{number:08d}", "\n".join(f"{k}={v}" for k, v in sorted(where.items())))
    return number


def _order(name: str) -> list[str]:
    return [CLUSTER[name], *[c.split()[0] for c in TABLES[name].split(", ") if c.split()[0] != CLUSTER[name]]]


def save_catalog(cat: Catalog, path: str, names: list[str]) -> int:
    """Save tables as a new version of the catalogue and return its number.

    All tables are written to new folders first; then one small file is created that says
    which folder each table has, and tables not named keep theirs. Readers see the old
    version or the new one, never a mixture, a failed save changes nothing, and tables
    may be derived from the very catalogue they replace. Of two writers that take the same
    number one raises ``Taken``.

    Each table is range-partitioned and sorted by its cluster column, so the row-group
    statistics let a key lookup skip almost all of the data. All columns take part in
    the ranges: a parent with very many episodes still splits over several files.
    """
    spark = cat[names[0]].sparkSession
    where = folders(spark, path)
    number = max(versions(spark, path), default=0) + 1
    batch = uuid.uuid4().hex[:12]
    where |= {name: f"{name}/{batch}" for name in names}

    def save(name: str) -> None:
        order = _order(name)
        cat.ranged(name, order).sortWithinPartitions(*order).write.parquet(f"{path}/{where[name]}")

    together(spark, [partial(save, name) for name in names])
    return _commit(spark, path, number, where)


def merge_catalog(
    spark: SparkSession,
    path: str,
    changes: dict[str, DataFrame] | None = None,
    deletes: dict[str, DataFrame] | None = None,
    order: dict[str, list[Column]] | None = None,
    replaced: dict[str, DataFrame] | None = None,
    competing: Collection[str] = (),
) -> int:
    """Upsert and delete rows of tables as a new version and return its number.

    ``changes`` holds rows by table; of several for a key the first in ``order`` counts, by default the smallest by all columns.
    ``deletes`` holds primary keys by table; a key that is also changed is kept as changed. ``replaced`` holds cluster keys by
    table, of which all rows go that are there now. In a ``competing`` table a row that is there now counts for its key with those that come.

    Only files whose key range holds a changed key are read and written anew; the new version shares
    all others with the one before. New files keep to the ranges of the files
    they replace, so ranges stay narrow however many merges follow. Keys are looked up one by one up to
    ``FEW_KEYS``; beyond, all files between the smallest and the largest are rewritten. Tables are merged at once, four at a time.

    Of two merges into the same version one raises ``Taken`` and changes nothing; it may be run again.
    """
    number = max(versions(spark, path), default=0)
    where = folders(spark, path)
    if not where:
        raise FileNotFoundError(f"no saved catalogue in {path}")
    changes, deletes, order, replaced = changes or {}, deletes or {}, order or {}, replaced or {}
    names = sorted({*changes, *deletes, *replaced})

    def merge(name: str) -> list[dict]:
        parts = (changes.get(name), deletes.get(name), order.get(name), replaced.get(name), name in competing)
        return _merge_table(spark, path, name, where[name], *parts)

    for name, new in zip(names, together(spark, [partial(merge, name) for name in names]), strict=True):
        where[name] = f"{LISTS}/{name}-{uuid.uuid4().hex[:12]}"
        Files(spark, path).create(where[name], "\n".join(json.dumps(f) for f in new))
    return _commit(spark, path, number + 1, where)


def _merge_table(
    spark: SparkSession,
    path: str,
    name: str,
    place: str,
    changes: DataFrame | None,
    deletes: DataFrame | None,
    order: list[Column] | None,
    replaced: DataFrame | None = None,
    competing: bool = False,
) -> list[dict]:
    """The files of a table after a merge."""
    keys, cluster = PRIMARY_KEYS[name], CLUSTER[name]
    order = order or [F.asc(c) for c in _order(name)]
    files = _listed(spark, path, place) if place.startswith(f"{LISTS}/") else _ranges(spark, path, name, place)
    files.sort(key=lambda f: (f["low"], f["high"], f["file"]))
    new = spark.createDataFrame([], TABLES[name])
    if changes is not None:
        new = stored(changes.select(*new.columns), f"changes-{name}")
    if deletes is not None:
        deletes = stored(deletes.select(*keys).distinct(), f"keys-{name}")
    if replaced is not None:
        replaced = replaced.select(F.col(replaced.columns[0]).alias(cluster))
    every = reduce(DataFrame.unionByName, [df.select(cluster) for df in (new, deletes, replaced) if df is not None and cluster in df.columns])
    if cluster in keys:
        few = [r[0] for r in every.distinct().limit(FEW_KEYS + 1).collect()]
        if len(few) > FEW_KEYS:
            return _merge_ranges(spark, path, name, files, every, new, deletes, order, replaced, competing)

    # Few keys, or rows that may move to another file: what is there now is looked up by key.
    now = _open(spark, path, name, place)
    if competing:
        new = new.unionByName(now.join(moved(new.select(*keys).distinct()), keys, "left_semi").select(*new.columns))
    if changes is not None:
        new = stored(first_per_key(new, keys, order), f"changes-{name}")
    gone = new.select(*keys)
    if replaced is not None:
        gone = gone.unionByName(now.join(moved(replaced.distinct()), cluster, "left_semi").select(*keys))
    if deletes is not None:
        gone = gone.unionByName(deletes)
    if replaced is not None or deletes is not None:
        gone = stored(gone.distinct(), f"keys-{name}")

    if cluster not in keys:
        # The row that a key has now may lie elsewhere; only the two columns are read.
        every = every.unionByName(now.select(*keys, cluster).join(moved(gone), keys, "left_semi").select(cluster))
        few = [r[0] for r in every.distinct().limit(FEW_KEYS + 1).collect()]
    held = sorted(few)
    if len(few) <= FEW_KEYS:
        touched = [f for f in files if _any_between(held, f["low"], f["high"])]
    else:
        low, high = every.agg(F.min(cluster), F.max(cluster)).first()
        # Many keys in small files: a broadcast would hold all of them in the driver.
        gone = gone.hint("merge")
        touched = [f for f in files if f["low"] <= high and f["high"] >= low]

    # Rows stay in the range of the file they come from; new ones go to the last file that begins at or before them, and between
    # two files that stay they make one of their own.
    place_of = {f["file"]: i for i, f in enumerate(files)}
    file = spark.createDataFrame([(f["file"], place_of[f["file"]]) for f in touched], "_file string, _range int")
    now = _read(spark, name, [f"{path}/{f['file']}" for f in touched], path).join(gone, keys, "left_anti").join(F.broadcast(file), "_file")
    if len(few) <= FEW_KEYS:
        lows = [f["low"] for f in files]
        kind = new.schema[cluster].dataType.simpleString()
        slots = spark.createDataFrame([(k, max(bisect_right(lows, k) - 1, 0)) for k in held], f"{cluster} {kind}, _range int")
        new = new.join(F.broadcast(slots), cluster)
    else:
        new = new.withColumn("_range", F.lit(0))
    columns = [*_order(name), "_range"]
    rows = now.select(*columns).unionByName(new.select(*columns))
    folder = f"{name}/{uuid.uuid4().hex[:12]}"
    by = ["_range", *_order(name)]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("_range").parquet(f"{path}/{folder}")
    names = {f["file"] for f in touched}
    return [f for f in files if f["file"] not in names] + _ranges(spark, path, name, folder)


def _merge_ranges(
    spark: SparkSession,
    path: str,
    name: str,
    files: list[dict],
    every: DataFrame,
    new: DataFrame,
    deletes: DataFrame | None,
    order: list[Column],
    replaced: DataFrame | None,
    competing: bool,
) -> list[dict]:
    """The files of a table after a merge of many keys, for a table whose cluster column is in its key.

    The rows that are there, those that come and the keys that go move once, to ranges of their key, where those of a key meet.
    """
    keys, cluster, columns = PRIMARY_KEYS[name], CLUSTER[name], new.columns
    low, high = every.agg(F.min(cluster), F.max(cluster)).first()
    touched = [f for f in files if f["low"] <= high and f["high"] >= low]
    now = _read(spark, name, [f"{path}/{f['file']}" for f in touched])
    comes, goes, there, leaves = range(4)

    def of(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumn("_kind", F.lit(kind))

    rows = of(now.select(*columns), there).unionByName(of(new, comes))
    if deletes is not None:
        rows = rows.unionByName(of(deletes, goes), allowMissingColumns=True)
    if replaced is not None:
        rows = rows.unionByName(of(replaced.distinct(), leaves), allowMissingColumns=True)
    kind, first = F.col("_kind"), F.col("_first")
    # A key with a null meets no other.
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in keys])
    rank = F.when(kind == comes, 0).when((kind == there) & whole, 0 if competing else 1).otherwise(2)
    own = Window.partitionBy(*keys)
    rows = rows.repartitionByRange(*([cluster] if replaced is not None else keys)).withColumns(
        {"_place": F.row_number().over(own.orderBy(rank, *order)), "_first": F.min("_kind").over(own)}
    )
    stays = (kind == there) & ((first == there) | ~whole)
    if replaced is not None:
        rows = rows.withColumn("_leaves", F.max(kind == leaves).over(Window.partitionBy(cluster)))
        stays = stays & (~F.col("_leaves") | F.col(cluster).isNull())
    rows = rows.filter(stays | ((first == comes) & (F.col("_place") == 1))).select(*_order(name))
    folder = f"{name}/{uuid.uuid4().hex[:12]}"
    rows.sortWithinPartitions(*keys).write.parquet(f"{path}/{folder}")
    names = {f["file"] for f in touched}
    return [f for f in files if f["file"] not in names] + _ranges(spark, path, name, folder)


def _any_between(held: list, low, high) -> bool:
    """Whether a sorted list has a value from ``low`` to ``high``."""
    at = bisect_right(held, high)
    return at > 0 and held[at - 1] >= low


def differences(spark: SparkSession, path: str, old: int, new: int) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Rows that went and rows that came between two versions, by table.

    Only files that one of the versions has alone are read; rows that such files have in common are on both sides.
    """
    before, after = folders(spark, path, old), folders(spark, path, new)

    def files(name: str, place: str | None) -> set[str]:
        if place is None:
            return set()
        if place.startswith(f"{LISTS}/"):
            return {f["file"] for f in _listed(spark, path, place)}
        return {f"{place}/{n}" for n in Files(spark, path).names(place) if n.endswith(".parquet")}

    removed, added = {}, {}
    for name in TABLES:
        if before.get(name) != after.get(name):
            a, b = files(name, before.get(name)), files(name, after.get(name))
            removed[name] = _read(spark, name, [f"{path}/{f}" for f in sorted(a - b)])
            added[name] = _read(spark, name, [f"{path}/{f}" for f in sorted(b - a)])
    return removed, added


def save_copies(spark: SparkSession, path: str) -> int:
    """Copies of the latest version's tables for lookups by a second key, and its number.

    A copy is sorted by that key, so a lookup skips the files and row groups of all others. It belongs to its version: a
    later one reads the table itself until it has copies of its own.
    """
    version = versions(spark, path)[-1]
    cat = load_catalog(spark, path, version)

    def save(name: str, column: str) -> None:
        order = [column, *[c for c in _order(name) if c != column]]
        copy = cat[name].repartitionByRange(*order).sortWithinPartitions(*order)
        copy.write.parquet(f"{path}/{COPIES}/{version:08d}/{name}-{column}")

    together(spark, [partial(save, *second) for second in SECOND_KEYS])
    return version


def save_search(spark: SparkSession, path: str) -> int:
    """Index the names of the latest version for search, and return its number."""
    version = versions(spark, path)[-1]
    cat = load_catalog(spark, path, version)

    def save(name: str, key: str, text: str) -> None:
        names = cat[name].select(F.col(key).alias("id"), F.col(text).alias("name"))
        grams.save(grams.build(names), f"{path}/{SEARCH}/{version:08d}/{name}")

    together(spark, [partial(save, name, *columns) for name, columns in NAMED.items()])
    return version


def load_search(spark: SparkSession, path: str, version: int | None = None) -> dict[str, NameIndex]:
    """The indexes of a version, by table."""
    version = version or versions(spark, path)[-1]
    if not Files(spark, path).exists(f"{SEARCH}/{version:08d}"):
        raise FileNotFoundError(f"version {version} of {path} has no search index")
    return {name: grams.load(spark, f"{path}/{SEARCH}/{version:08d}/{name}") for name in NAMED}


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all versions but the latest ``keep``, with the files only they have."""
    store = Files(spark, path)
    known = versions(spark, path)
    old, kept = known[: -keep or None], known[-keep:]

    def places(numbers: list[int]) -> set[str]:
        return {p for v in numbers for p in folders(spark, path, v).values()}

    def files(listed: set[str]) -> set[str]:
        return {f["file"] for p in listed if p.startswith(f"{LISTS}/") for f in _listed(spark, path, p)}

    used = places(kept)
    in_use = files(used)
    gone = places(old) - used
    used_folders = {"/".join(f.split("/")[:2]) for f in in_use} | used
    for file in files(gone) - in_use:
        folder = "/".join(file.split("/")[:2])
        store.delete(file if folder in used_folders else folder)
    for place in gone:
        if place.startswith(f"{LISTS}/") or place not in used_folders:
            store.delete(place)
        elif place not in used:
            for name in store.names(place):
                if f"{place}/{name}" not in in_use and not name.startswith("_"):
                    store.delete(f"{place}/{name}")
    for version in old:
        store.delete(f"{VERSIONS}/{version:08d}")
        store.delete(f"{SEARCH}/{version:08d}")
        store.delete(f"{COPIES}/{version:08d}")


def save_bucketed(cat: Catalog, names: list[str], buckets: int, prefix: str = "") -> None:
    """Save tables keyed by title as tables bucketed by ``tconst``; joins of them do not shuffle."""
    for name in names:
        (
            cat[name]
            .write.mode("overwrite")
            .bucketBy(buckets, "tconst")
            .sortBy("tconst")
            .format("parquet")
            .saveAsTable(f"{prefix}{name}")
        )


def load_bucketed(spark: SparkSession, prefix: str = "") -> Catalog:
    return Catalog(lambda name: spark.table(f"{prefix}{name}"))


def save_frame(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result, for example the table behind a chart."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
