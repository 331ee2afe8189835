"""Benchmark decontamination by spaced-seed hashing, with DataFrame operations only.

Two fixed masks pick six of the tokens under them and ignore the others. Together they hit
every stretch of 13 tokens in which at most two were substituted, wherever these lie: for
any two positions, one of the masks fits in between at some offset. The masked tokens are
hashed in documents and benchmark items, equal hashes give an alignment, and each
alignment is verified token by token: a document overlaps an item if, in some window of 13
aligned tokens (the whole item, if it is shorter), at least 80 % are equal.

Items of under 13 tokens have masks of their own length: the item is cut into blocks, and
each mask leaves out as many blocks as tokens may differ, so that one mask avoids any
allowed substitutions. Of items of up to 4 tokens none may differ, and the mask is the whole
item. Documents are hashed under those masks only if the benchmark has such items.

Defined cases: a null or empty text, and an item without tokens, overlap nothing; rows that repeat an id and a text are reported once; null ids are kept as null; an
empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import row_key, written

#: The token offsets that each mask looks at.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW = 13
SHARE = 0.8
#: Blocks that an item is cut into, by how many of its tokens may differ.
BLOCKS = {0: 1, 1: 3, 2: 4}
#: Seeds of the benchmark, counted first, up to which they are sent to every executor.
SEEDS_SENT = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-case letter and digit runs of a text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def short_masks(length: int) -> list[tuple[int, ...]]:
    """Masks of a whole item of under ``WINDOW`` tokens: one avoids any allowed substitutions."""
    differ = length - math.ceil(round(length * SHARE, 6))
    blocks = BLOCKS[differ]
    cuts = [length * k // blocks for k in range(blocks + 1)]
    return [
        tuple(i for k in kept for i in range(cuts[k], cuts[k + 1]))
        for kept in combinations(range(blocks), blocks - differ)
    ]


#: The masks of each short length, and all masks by number, moved to begin at 0.
SHORT = {n: short_masks(n) for n in range(1, WINDOW)}
SHAPES = [*MASKS, *sorted({tuple(i - m[0] for i in m) for masks in SHORT.values() for m in masks} - set(MASKS))]


def seed(number: int, near: Callable[[int], Column]) -> Column:
    """The hash under a mask; null where its last token lies beyond the end."""
    shape = SHAPES[number]
    return F.when(near(shape[-1]).isNotNull(), F.xxhash64(F.lit(number), *[near(o) for o in shape]))


def seeds(rows: DataFrame, *keep: str, numbers: Sequence[int] = range(len(MASKS))) -> DataFrame:
    """The masked hashes of ``tokens``: kept columns, ``at`` (from 0), ``seed``."""
    offsets = sorted({o for k in numbers for o in SHAPES[k]})
    t, least = F.col("tokens"), min(SHAPES[k][-1] for k in numbers)
    shifted = [F.slice(t, o + 1, F.greatest(F.size(t) - least, F.lit(0))).alias(f"t{o}") for o in offsets]
    places = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("at", "near"))
    each = F.explode(F.array(*[seed(k, lambda o: F.col(f"near.t{o}")) for k in numbers])).alias("seed")
    return places.select(*keep, "at", each).filter("seed is not null")


def short_numbers(length: int) -> list[tuple[int, int]]:
    """Where each mask of a short item begins, and its number."""
    return [(m[0], SHAPES.index(tuple(i - m[0] for i in m))) for m in SHORT[length]]


def short_seeds(items: DataFrame, lengths: Sequence[int], *keep: str) -> DataFrame:
    """The masked hashes of items of the given lengths, each under its length's masks."""
    own = [
        F.when(F.size("tokens") == n, F.struct(F.lit(at).alias("at"), seed(k, lambda o, at=at: F.get("tokens", F.lit(at + o))).alias("seed")))
        for n in lengths
        for at, k in short_numbers(n)
    ]
    return items.select(*keep, F.explode(F.array(*own)).alias("own")).filter("own is not null").select(*keep, "own.at", "own.seed")


def aligned(first: Column, document: Column, item: Column) -> Column:
    """For each token of the item 1 if the document has it at its place, else 0."""
    return F.transform(
        item,
        lambda x, j: F.when(
            (first + j >= 0) & (first + j < F.size(document)),
            (F.get(document, first + j) == x).cast("int"),
        ).otherwise(0),
    )


def best_window(same: Column, width: Column) -> Column:
    """The most equal tokens in any window of the given width."""
    starts = F.sequence(F.lit(1), F.size(same) - width + 1)
    return F.array_max(
        F.transform(starts, lambda i: F.aggregate(F.slice(same, i, width), F.lit(0), lambda a, x: a + x))
    )


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Documents and the items they overlap: ``doc_id``, ``item_id``, ``n_equal`` (equal
    tokens of the best alignment), ``window_equal`` (those of its best window) and ``row``,
    the key of the document's row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("row", row_key())
    items = benchmark.select(
        F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("tokens")
    ).withColumn("item", F.xxhash64(F.col("item_id"), F.lit("|"), F.col("tokens"))).dropDuplicates(["item"])
    items = written(items, "items")
    # At most WINDOW - 1 lengths; documents are hashed under the masks that some item has.
    lengths = sorted(r["n"] for r in items.select(F.size("tokens").alias("n")).filter(F.col("n").between(1, WINDOW - 1)).distinct().collect())
    marked = items.withColumn("exact", F.size("tokens").isin([n for n in SHORT if len(SHORT[n]) == 1]))
    wanted = seeds(marked.filter(F.size("tokens") >= WINDOW), "item", "exact")
    if lengths:
        wanted = wanted.unionAll(short_seeds(marked, lengths, "item", "exact"))
    numbers = sorted({*range(len(MASKS)), *[k for n in lengths for _, k in short_numbers(n)]})
    wanted = written(wanted.withColumnRenamed("at", "item_at").distinct(), "seeds")
    if wanted.count() <= SEEDS_SENT:
        wanted = F.broadcast(wanted)
    first = F.col("at") - F.col("item_at")
    # All places of an exact copy are alike, so one of them is verified.
    hits = (
        seeds(rows.select("row", tokens(F.col("text")).alias("tokens")), "row", numbers=numbers)
        .join(wanted, "seed")
        .groupBy("row", "item", F.when(F.col("exact"), 0).otherwise(first).alias("place"))
        .agg(F.min(first).alias("first"))
        .drop("place")
    )
    hits = written(hits, "hits")
    width = F.least(F.lit(WINDOW), F.size("theirs"))
    found = (
        rows.join(hits, "row")
        .select("row", "doc_id", "item", "first", tokens(F.col("text")).alias("tokens"))
        .join(items.select("item", "item_id", F.col("tokens").alias("theirs")), "item")
        .select("row", "doc_id", "item_id", "item", width.alias("width"), aligned(F.col("first"), F.col("tokens"), F.col("theirs")).alias("same"))
        .select("*", best_window(F.col("same"), F.col("width")).alias("best"))
        .filter(F.col("best") * 5 >= F.col("width") * round(5 * SHARE))
    )
    equal = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    return found.groupBy("row", "doc_id", "item", "item_id").agg(
        F.max(equal).cast("long").alias("n_equal"), F.max("best").cast("long").alias("window_equal")
    ).drop("item")


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that overlap no item of the benchmark (item_id, text), unchanged."""
    leaks = written(overlaps(docs, benchmark, doc_id, text).select(F.col("row").alias("leak")).distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("doc"), row_key(doc_id, text).alias("key"))
    return rows.join(leaks, F.col("key") == F.col("leak"), "left_anti").select("doc.*")
