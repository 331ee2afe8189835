"""Near-duplicates by MinHash with tensored banding.

A text's set holds its distinct shingles of ``WORDS`` words as 64-bit hashes. Two small collections of
``SIDE`` sub-keys, each made of ``ROWS`` minhashes, are computed per set; the keys of the
``SIDE * SIDE`` tables are all pairs of a sub-key of the one and a sub-key of the other, so 48
minhashes serve 144 tables of four. Sets meet in a table if they agree in a sub-key of either
collection: for a similarity of 0.8 that fails with a probability of
``2 * (1 - 0.8**2)**12 = 1e-5``, for 0.85 of 2e-7. Candidates are verified on the full sets.

What is done at each step:

1. Equal sets are one from the start, so copies cost nothing further.
2. In a bucket all sets are compared with its first one only, which is linear in the bucket.
   Stars are begun before the shuffle, so a bucket with a third of all sets arrives as a few rows.
3. The verified links give components, and the candidate pairs give families. Where a family holds several
   components, their sets are compared in full, in cells of about ``PART`` shingles on either side, so a link that
   no star has shown is found too. Only links leave a cell, no pairs: a family of texts that are
   alike but not linked costs comparisons inside tasks, not rows.
4. Candidate pairs are pruned if their sizes exclude the similarity, or if fewer than ``AGREE`` of their 48 minhashes
   agree (for a similarity of 0.8 a chance below 1e-9).

Full sets are needed for candidates only: a second scan sends those whose row is marked in a table of
at most 2**27 bits.

Defined cases: a null or empty text, or one of white space, has an empty set, is its own component and
linked with nothing; fewer than ``WORDS`` words make one shingle of the whole sequence; repeated rows
and equal texts have one set; a null ``doc_id`` is a component's id only if the component has no other; very long
texts are hashed in pieces of ``PIECE`` shingles; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import each, row_key, written
from titlelake.llm.simhash import components

WORDS = 4
#: Similarity in percent from which sets are linked.
LEAST = 80
#: Minhashes of a sub-key, sub-keys of a collection, minhashes in all.
ROWS, SIDE = 2, 12
HASHES = 2 * SIDE * ROWS
#: Of two sets that many minhashes agree at least.
AGREE = 20
#: Shingles hashed at once, sets whose keys are made at once, table entries of one shuffle group.
PIECE, SETS, GROUP = 4096, 4096, 2_000_000
#: Shingles on one side of a cell.
PART = 500_000
#: Links up to which one task joins them.
FEW_LINKS = 300_000
#: Bits of the table of rows whose sets are sent: for each one, and at most.
BITS_EACH, MOST_BITS = 32, 1 << 27
#: Words whose hashes are remembered.
REMEMBERED = 1 << 20

SEED = np.random.default_rng(12)
ODD = SEED.integers(0, 1 << 63, size=WORDS + HASHES + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE, MULTIPLY, MIX = ODD[:WORDS], ODD[WORDS:-2], ODD[-2:]
SIDES = np.arange(SIDE * SIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        return self.setdefault(word, xxhash.xxh64_intdigest(word, 12))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: Words) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    own = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(len(own) - WORDS + 1, min(len(own), 1))
    sums = np.zeros(n, dtype=np.uint64)
    for i in range(min(WORDS, len(own))):
        sums += own[i : i + n] * PLACE[i]
    return np.unique(mixed(sums))


def minhashes(own: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), PIECE):
        np.minimum(least, (own[at : at + PIECE, None] * MULTIPLY).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: ``doc_id``, ``row`` (its key), ``n``, the set's name ``high, low``, ``sub`` (sub-keys) and ``agree`` (a byte of each minhash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            out: list[tuple] = []
            for value in each(batch.column(2)):
                own = shingles(value, words)
                name = xxhash.xxh3_128_digest(own.tobytes())
                least = minhashes(own)
                sub = mixed((least.reshape(-1, ROWS) * MULTIPLY[:ROWS]).sum(axis=1, dtype=np.uint64) + MIX[0])
                out.append((len(own), *np.frombuffer(name, dtype="<i8").tolist(), sub.tobytes(), mixed(least).astype(np.uint8).tobytes()))
            n, high, low, sub, agree = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sub, pa.binary()), pa.array(agree, pa.binary())],
                names=["doc_id", "row", "n", "high", "low", "sub", "agree"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(f"`{doc_id}`", f"`{text}`").alias("row"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row long, n long, high long, low long, sub binary, agree binary")


def table_keys(sub: np.ndarray) -> np.ndarray:
    """The table keys of sets (a row each) by their sub-keys: all pairs of the two collections."""
    pairs = sub[:, :SIDE, None] * MIX[1] + sub[:, None, SIDE:]
    return mixed(pairs.reshape(len(sub), -1) + SIDES)


def stars(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in order of key and owner: which are first of their key, and the pairs (first, other) as places."""
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    other = np.flatnonzero(~first & (owner != owner[head]))
    return first, head[other], other


STAR = "key long, lead long, member long"


def entries(parts: int):
    """Batches of (sid, sub) to, by part, table entries ``key, owner`` and the stars already seen."""
    schema = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("owner", pa.binary()), ("star", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SETS):
                own = batch.slice(start, SETS)
                sid = own.column(0).to_numpy()
                key = table_keys(np.frombuffer(b"".join(own.column(1).to_pylist()), dtype="<u8").reshape(len(sid), -1)).ravel()
                owner = np.repeat(sid, SIDE * SIDE)
                part = (key % np.uint64(parts)).astype(np.int32)
                order = np.lexsort((owner, key, part))
                part, key, owner = part[order], key[order], owner[order]
                first, lead, member = stars(key, owner)
                star = np.stack([key[member].view(np.int64), owner[lead], owner[member]], axis=1)
                star_part = part[member]
                part, key, owner = part[first], key[first], owner[first]
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
                rows = [
                    (int(part[a]), key[a:b].tobytes(), owner[a:b].tobytes(), star[slice(*np.searchsorted(star_part, [part[a], part[a] + 1]))].tobytes())
                    for a, b in zip(cuts, cuts[1:], strict=False)
                ]
                for k in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1024], strict=True), schema.types, strict=True)], schema=schema
                    )

    return run


def meet(table: pa.Table) -> pa.Table:
    """All stars of a part: ``key``, the bucket's ``lead`` and one ``member``."""
    def values(name: str) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype="<i8")

    key, owner = values("key"), values("owner")
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    _, lead, member = stars(key, owner)
    found = np.concatenate([values("star").reshape(-1, 3), np.stack([key[member], owner[lead], owner[member]], axis=1)])
    return pa.table({name: pa.array(found[:, i]) for i, name in enumerate(("key", "lead", "member"))})


def buckets(sets: DataFrame) -> DataFrame:
    """Stars ``key, lead, member`` of all tables. ``sets`` (sid, sub) should be stored, as it is counted."""
    parts = max(1, -(-sets.count() * SIDE * SIDE // GROUP))
    made = sets.select("sid", "sub").mapInArrow(entries(parts), "part int, key binary, owner binary, star binary")
    return made.groupBy("part").applyInArrow(meet, STAR)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minhashes agree, by their bytes."""
    return (a == b).sum(axis=-1)


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and minhashes don't exclude."""

    @F.arrow_udf("boolean")
    def alike(mine: pa.Array, other: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for x in (mine, other))
        return pa.array(agreeing(a, b) >= AGREE)

    own = [sets.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("agree").alias(f"agree_{side}")) for side in "ab"]
    both = pairs.join(own[0], "a").join(own[1], "b")
    small = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * LEAST
    return both.filter(small & alike("agree_a", "agree_b")).select("a", "b")


def marked(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A table of bits, packed, in which the keys ``row`` are set; its size goes with the rows up to a limit."""
    n = rows.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(15, (BITS_EACH * n).bit_length()))
    # Bitmaps number their values from 1.
    place = F.pmod("row", F.lit(bits)) + 1
    found = rows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table = np.zeros(bits // 8, dtype=np.uint8)
    for r in found.collect():
        own = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        start = (r["bucket"] - 1) * len(own)
        table[start : start + len(own)] = own
    return table, bits


def full_sets(docs: DataFrame, needed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``sid`` and ``own``, the hashes of the needed sets (sid, row, high, low)."""
    table, bits = marked(needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            place = batch.column(0).to_numpy() & np.int64(bits - 1)
            there = np.flatnonzero(table[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            for start in range(0, len(there), 64):
                rows, texts = (batch.column(i).take(pa.array(there[start : start + 64])) for i in (0, 1))
                own = [shingles(value, words).tobytes() for value in each(texts)]
                names = [np.frombuffer(xxhash.xxh3_128_digest(x), dtype="<i8").tolist() for x in own]
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()), pa.array(own, pa.binary())],
                    names=["row", "high", "low", "own"],
                )

    rows = docs.select(row_key(f"`{doc_id}`", f"`{text}`").alias("row"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "row long, high long, low long, own binary")
    # Repeated rows give a set more than once.
    return found.join(needed, ["row", "high", "low"]).groupBy("sid").agg(F.first("own").alias("own"))


def linked(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""

    @F.arrow_udf("boolean")
    def similar(mine: pa.Array, other: pa.Array) -> pa.Array:
        def verified() -> Iterator[bool]:
            for x, y in zip(each(mine), each(other), strict=True):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                yield 100 * both >= LEAST * (len(a) + len(b) - both)

        return pa.array(verified(), pa.bool_())

    sides = [own.select(F.col("sid").alias(side), F.col("own").alias(f"own_{side}")) for side in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(similar("own_a", "own_b")).select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest reachable, for all nodes of stored links (a, b).

    Up to ``FEW_LINKS`` links, a bound of some tens of megabytes, one task joins them; more take steps of stars over the cluster.
    """
    if links.count() > FEW_LINKS:
        return written(components(links), "roots")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = root[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (x := find(a)) != (y := find(b)):
                    root[max(x, y)] = min(x, y)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])

    return written(links.select("a", "b").coalesce(1).mapInArrow(joined, "node long, root long"), "roots")


def families(pairs: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Sets that plausible pairs (a, b) connect though the links found so far don't: ``family, sid, root, n``."""
    member = connected(pairs).withColumnRenamed("root", "family")
    # Whether a root is among its nodes depends on how they were joined.
    every = member.unionByName(member.select(F.col("family").alias("node"), "family")).distinct()
    named = every.withColumnRenamed("node", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.withColumn("root", F.coalesce("root", "sid"))
    open_ = named.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("family")
    return named.join(open_, "family").join(sets.select("sid", "n"), "sid")


def across(members: DataFrame, own: DataFrame) -> DataFrame:
    """Links (a, b) between different components of a family (family, sid, root, n): enough to connect what is linked.

    A family is divided in parts of about ``PART`` shingles, large components in parts of their own. All pairs of
    parts are cells, but for two parts of one component. In a cell sets are compared in full, two that are connected by then
    are not, and only links come out: at most one for each set.
    """
    sizes = members.groupBy("family", "root").agg(F.sum("n").alias("weight"))
    large = F.col("weight") > PART
    small = sizes.filter(~large).groupBy("family").agg(F.ceil(F.sum("weight") / PART).cast("long").alias("bins"))
    placed = sizes.join(small, "family", "left").select(
        "family", "root",
        F.when(large, F.ceil(F.col("weight") / PART).cast("long")).otherwise(1).alias("pieces"),
        F.when(large, F.concat_ws(":", F.lit("c"), "root")).otherwise(F.concat_ws(":", F.lit("b"), F.pmod(F.xxhash64("root"), "bins"))).alias("bin"),
    )
    piece = F.pmod(F.xxhash64("sid"), "pieces")
    entry = members.join(placed, ["family", "root"]).select("family", "sid", "root", "bin", F.concat_ws(":", "bin", piece).alias("part"))
    parts = entry.select("family", "bin", "part").distinct()
    other = parts.select("family", F.col("bin").alias("bin2"), F.col("part").alias("part2"))
    cells = parts.join(other, "family").filter("part <= part2 and not (bin = bin2 and bin like 'c:%')").select("family", "part", "part2")
    first = cells.select("family", "part", F.col("part").alias("i"), F.col("part2").alias("j"))
    second = cells.filter("part < part2").select("family", F.col("part2").alias("part"), F.col("part").alias("i"), F.col("part2").alias("j"))
    inside = entry.join(own, "sid").join(first.unionByName(second), ["family", "part"])

    def compared(table: pa.Table) -> pa.Table:
        sid, root = table.column("sid").to_numpy(), table.column("root").to_numpy()
        n = np.array([len(x.as_py()) // 8 for x in table.column("own")])
        _, column = np.unique(np.frombuffer(b"".join(table.column("own").to_pylist()), dtype=np.uint64), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(n)])
        second = np.array(table.column("part").to_pylist()) != np.array(table.column("i").to_pylist())
        between = bool(second.any())
        _, root = np.unique(root, return_inverse=True)
        mark = np.zeros(column.max() + 1, dtype=np.int32)
        links = []
        for x in np.flatnonzero(~second) if between else range(len(sid)):
            fits = (root != root[x]) & (100 * np.minimum(n, n[x]) >= LEAST * np.maximum(n, n[x]))
            fits &= second if between else np.arange(len(sid)) > x
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            mine = column[starts[x] : starts[x + 1]]
            mark[mine] = 1
            if 2 * n[at].sum() > len(column):
                both = np.add.reduceat(mark[column], starts[:-1])[at]
            else:
                both = np.array([mark[column[starts[y] : starts[y + 1]]].sum() for y in at])
            mark[mine] = 0
            for y in at[100 * both >= LEAST * (n[at] + n[x] - both)]:
                if root[y] != root[x]:
                    links.append((sid[x], sid[y]))
                    root[root == root[y]] = root[x]
        ends = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    return inside.groupBy("family", "i", "j").applyInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``."""
    rows = written(signatures(docs, doc_id, text), "signatures")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    same = rows.filter("n > 0").groupBy("high", "low", "n").agg(F.min(least).alias("lead"), F.first("sub").alias("sub"), F.first("agree").alias("agree"))
    sets = written(same.withColumn("sid", F.monotonically_increasing_id()), "sets")

    star_pairs = buckets(sets).select(F.least("lead", "member").alias("a"), F.greatest("lead", "member").alias("b")).distinct()
    pairs = written(plausible(star_pairs, sets), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    needed = written(sets.join(ends, "sid", "left_semi").select("sid", F.col("lead.row").alias("row"), "high", "low"), "needed")
    own = written(full_sets(docs, needed, doc_id, text), "own")
    links = written(linked(pairs, own), "linked")
    roots = connected(links)
    more = written(across(written(families(pairs, roots, sets), "families"), own), "linked")
    if more.take(1):
        roots = connected(written(links.unionByName(more), "linked"))

    joined = sets.join(roots, sets["sid"] == roots["node"], "left").withColumn("root", F.coalesce("root", "sid"))
    lead = joined.groupBy("root").agg(F.min(F.struct("lead.no_id", "lead.doc_id")).alias("first"))
    named = joined.join(lead, "root").select("high", "low", joined["n"].alias("n"), F.col("first.doc_id").alias("component_id"), F.lit(True).alias("has"))
    out = rows.select("doc_id", "n", "high", "low").join(named, ["high", "low", "n"], "left")
    component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
