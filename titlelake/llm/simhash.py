"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits have a common variant: one bit away
from either and two bits away from the other. Fingerprints at an odd distance have
different parity, so only those of odd parity emit their two-bit variants; and as two of
any three bits lie in the same half of the word, only pairs of bits in one half are needed
(2 * C(32, 2) = 992). All fingerprints emit themselves and their one-bit variants (65).
Variants meet in a shuffle; colliding pairs are verified and deduplicated.

A bucket never yields all its pairs: whoever reached a variant in one bit is within three
bits of everyone else there, so a star from one such member links the bucket. Fingerprints
that differ in at most three bits always meet in a bucket with such a member.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links
like any other; fewer than three words make one shingle of the whole sequence; repeated
rows share their fingerprint; a null ``doc_id`` is never a class id unless the class has
no other; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import each, written

SHINGLE = 3
RADIUS = 3
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Fingerprints whose variants are made at once, and variants of one shuffle group.
FINGERPRINTS, GROUP = 4096, 2_000_000

ONE = np.uint64(1)
BITS = [ONE << np.uint64(i) for i in range(64)]
HALVES = [*combinations(BITS[:32], 2), *combinations(BITS[32:], 2)]
#: By code: no flip, one flip, then two flips in one half.
FLIPS = np.array([0, *BITS, *(a | b for a, b in HALVES)], dtype=np.uint64)
LIGHT = 65
MEAN_VARIANTS = (LIGHT + len(FLIPS)) // 2


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint: a bit is set if it is in more than half of the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(words, words[1:], words[2:], strict=False)), len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows as ``row`` (a struct of all columns), with ``fp``, the fingerprint's bits."""

    @F.arrow_udf("long")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t) for t in each(batch)], dtype=np.uint64).view(np.int64))

    return docs.select(F.struct("*").alias("row"), found.asNondeterministic()(F.col(text)).alias("fp"))


def spread(values: np.ndarray, parts: int) -> np.ndarray:
    """A part for each variant, evenly whatever the bits."""
    x = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(parts)).astype(np.int32)


def variants(parts: int):
    """Batches of fingerprints to, by part, the owners with the codes of their variants."""
    schema = pa.schema([("part", pa.int32()), ("owner", pa.binary()), ("n", pa.binary()), ("code", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for start in range(0, len(fps), FINGERPRINTS):
                own = fps[start : start + FINGERPRINTS]
                odd = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) % 2 == 1
                light = np.repeat(np.arange(len(own), dtype=np.int32), LIGHT)
                heavy = np.repeat(np.flatnonzero(odd).astype(np.int32), len(FLIPS) - LIGHT)
                owner = np.concatenate([light, heavy])
                code = np.concatenate([
                    np.tile(np.arange(LIGHT, dtype=np.uint16), len(own)),
                    np.tile(np.arange(LIGHT, len(FLIPS), dtype=np.uint16), int(odd.sum())),
                ])
                part = spread(own[owner] ^ FLIPS[code], parts)
                order = np.lexsort((owner, part))
                owner, code, part = owner[order], code[order], part[order]
                cuts = np.flatnonzero(np.diff(part)) + 1
                rows: list[tuple] = []
                for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                    whose, count = np.unique(owner[a:b], return_counts=True)
                    rows.append((int(part[a]), own[whose].tobytes(), count.astype("<u2").tobytes(), code[a:b].tobytes()))
                for k in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1024], strict=True), schema.types, strict=True)],
                        schema=schema,
                    )

    return emit


def meet(table: pa.Table) -> pa.Table:
    """Of the variants of a part: links between their owners, as a forest of stars."""
    owner = np.frombuffer(b"".join(table.column("owner").to_pylist()), dtype="<u8")
    n = np.frombuffer(b"".join(table.column("n").to_pylist()), dtype="<u2")
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype="<u2")
    owner = np.repeat(owner, n)
    variant = owner ^ FLIPS[code]
    # In each bucket a member that came in one bit at most stands first.
    order = np.lexsort((code >= LIGHT, variant))
    owner, variant, near = owner[order], variant[order], (code < LIGHT)[order]
    first = np.ones(len(variant), dtype=bool)
    first[1:] = variant[1:] != variant[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(variant)), 0))
    at = np.flatnonzero(~first & near[head])
    pairs = np.stack([owner[head[at]], owner[at]], axis=1)
    differ = np.unpackbits((pairs[:, 0] ^ pairs[:, 1]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
    pairs = pairs[(differ > 0) & (differ <= RADIUS)]
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        if (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
    linked = [(x, find(x)) for x in list(root) if find(x) != x]
    ends = np.array(linked, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within the radius.

    ``fps`` should be stored, as it is counted first.
    """
    parts = max(1, -(-fps.count() * MEAN_VARIANTS // GROUP))
    made = fps.select("fp").mapInArrow(variants(parts), "part int, owner binary, n binary, code binary")
    return made.groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """For each node of the links (a, b): ``node`` and ``root``, the smallest reachable.

    Large-star and small-star steps, each a grouped minimum and a join, until nothing
    changes; each round is stored. A hub is only a join key: the minimum is aggregated
    before the shuffle, and Spark splits a skewed join.
    """
    own = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(rounds):
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = written(after, "links")
        same = after.count() == own.count() and not after.join(own, ["u", "v"], "left_anti").take(1)
        own = after
        if same:
            break
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    return own.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def classes(rows: DataFrame) -> DataFrame:
    """For each distinct ``fp`` of the stored rows (doc_id, fp): its class's smallest
    (doc_id, fp) as ``lead``, null ids last.

    Only fingerprints with a link are joined; all others lead themselves.
    """
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    fps = written(rows.groupBy("fp").agg(F.min(least).alias("own")), "fingerprints")
    roots = written(components(links(fps)), "roots")
    linked = roots.select(F.col("node").alias("fp"), "root").unionByName(
        roots.select(F.col("root").alias("fp"), "root").distinct()
    )
    joined = fps.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lead = joined.groupBy("root").agg(F.min("own").alias("lead"))
    return joined.select("fp", "root").join(lead, "root").select("fp", "lead")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex) and ``component_id``."""
    rows = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    rows = written(rows.select("row.doc_id", "fp"), "simhash")
    # A fingerprint may hold a third of all rows: leave room for Spark to split the join.
    return rows.join(classes(rows), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("lead.doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of which one document of each class stays, the one with the smallest id.

    Rows are numbered when they are stored. Which numbers stay is found on narrow rows;
    whole rows move once, in the join with these numbers.
    """
    numbered = fingerprints(docs, text).withColumn("number", F.monotonically_increasing_id())
    stored = written(numbered, "simhash-rows")
    rows = stored.select(F.col(f"row.{doc_id}").alias("doc_id"), "fp", "number")
    lead = classes(rows).select("lead.doc_id", F.col("lead.fp").alias("fp")).distinct()
    once = rows.groupBy("doc_id", "fp").agg(F.min("number").alias("number"))
    kept = once.alias("o").join(
        lead.alias("l"), F.col("o.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("o.fp") == F.col("l.fp")), "left_semi"
    )
    return stored.join(kept.select("number"), "number", "left_semi").select("row.*")
