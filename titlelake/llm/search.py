"""Ranked search, term at a time with a limited number of accumulators.

Documents are indexed for the terms of the queries: one scan keeps, per document, its
number of terms and the counts of those that a query has. The index is split by
documents. In each block of an index part a query's terms are taken rarest first (by
documents in the whole collection). A term creates accumulators for its documents until
what the remaining terms can add at most is less than the k-th best partial score: no
document without an accumulator can then reach the first k. From there on, further terms only
update the accumulators that exist, and those exactly. Each block yields its first k per query;
Spark ranks these.

The statistics of the weights (documents, their terms, documents per term) are those of all
documents. Queries are taken in blocks of ``QUERIES``, so what is sent to the tasks is bounded.

Defined cases: a null text has no terms, nor has one of punctuation; such a document is not
counted and such a query has no result. Rows that are repeated are documents of their own, queries
that are repeated count once, and two queries of one id and different texts are ranked apart. Equal scores
are ranked by ascending id, a null id last. A score of 0 (all terms in about all documents, or none) is
no result. Texts are read in pieces of a megabyte, however long. An empty table
on either side gives an empty result, and extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titlelake.llm.common import each, written

#: Queries whose terms are sent to the tasks at once.
QUERIES = 4096
#: Documents of a block, and bytes of a text that are split at once.
BLOCK, PIECE = 1 << 15, 1 << 20

#: Bytes of a term: letters and digits of ASCII, and all beyond it.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, A-Z as a-z, in lists."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    start = 0
    while start < len(data):
        gap = GAP.search(data, start + PIECE)
        end = gap.end() if gap else len(data)
        yield TERM.findall(data, start, end)
        start = end


class Postings:
    """The postings of a block of documents, by term, with what each adds to a score per unit of weight."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, length: int):
        self.size = len(n)
        doc = np.repeat(np.arange(self.size), counts)
        by_term = np.argsort(term, kind="stable")
        doc, term, tf = doc[by_term], term[by_term], tf[by_term].astype(np.int64)
        # Python's integers, as 75 * n * n_docs may pass 64 bits.
        m = np.array([25 + 75 * x * n_docs // max(length, 1) for x in n.tolist()], dtype=np.int64)
        self.doc, self.gain = doc, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        first = np.flatnonzero(np.diff(term, prepend=-1))
        self.at = dict(zip(term[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(term)], strict=True), strict=True))
        self.most = dict(zip(term[first].tolist(), np.maximum.reduceat(self.gain, first).tolist(), strict=True)) if len(first) else {}

    def best(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` documents and their scores for terms with weights, rarest first."""
        query = [(t, w) for t, w in query if w and t in self.at]
        rest = [0]
        for t, w in reversed(query):
            rest.append(rest[-1] + w * self.most[t])
        score, alive = np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=bool)
        held: list[np.ndarray] = []
        n_held, creating = 0, True
        for left, (t, w) in zip(rest[-2::-1], query, strict=True):
            a, b = self.at[t]
            doc, gain = self.doc[a:b], self.gain[a:b]
            own = alive[doc]
            if creating:
                new = doc[~own]
                alive[new] = True
                held.append(new)
                n_held += len(new)
                score[doc] += w * gain
                if n_held >= k and left:
                    partial = score[np.concatenate(held)]
                    creating = left >= np.partition(partial, n_held - k)[n_held - k]
            else:
                score[doc[own]] += w * gain[own]
        found = np.concatenate(held) if held else np.zeros(0, dtype=np.int64)
        found = found[score[found] > 0]
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((found, -score[found]))][:k]
        return found, score[found]


def index(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """Per document with a term: ``id``, its number ``n`` of terms, and the counts ``tf`` of the terms in ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, term, tf = [], [], [], []
            for i, value in enumerate(each(batch.column(1))):
                total, own = 0, Counter()
                for piece in terms(value):
                    total += len(piece)
                    own.update(map(vocabulary.get, piece))
                own.pop(None, None)
                if total:
                    ids.append(i)
                    n.append(total)
                    term.append(np.fromiter(own.keys(), dtype="<i4", count=len(own)).tobytes())
                    tf.append(np.fromiter(own.values(), dtype="<i8", count=len(own)).tobytes())
            columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), pa.array(term, pa.binary()), pa.array(tf, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "term", "tf"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, term binary, tf binary")


def frequencies(rows: DataFrame, size: int) -> dict[int, int]:
    """In how many documents of the index each of ``size`` terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype=np.int64)
        for batch in batches:
            own += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i4"), minlength=size)
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(own[some])], names=["term", "df"])

    partial = rows.select("term").mapInArrow(run, "term int, df long")
    return {r["term"]: r["df"] for r in partial.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def arrays(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows in one array, and how many each row has."""
    values = column.to_pylist()
    together = np.frombuffer(b"".join(values), dtype=kind)
    return together, np.array([len(v) for v in values], dtype=np.int64) // together.itemsize


def first_of_blocks(rows: DataFrame, queries: list[list[tuple[int, int]]], n_docs: int, length: int, k: int) -> DataFrame:
    """``item`` (a number), ``doc_id``, ``score``: the first ``k`` of each query in each block of the index."""
    kind = rows.schema["id"].dataType

    def ranked(table: pa.Table) -> pa.RecordBatch:
        # Places in the block are in the order of the ids, so they decide ties.
        table = table.take(pc.sort_indices(table.column("id"))).combine_chunks()
        term, counts = arrays(table.column("term"), "<i4")
        tf, _ = arrays(table.column("tf"), "<i8")
        postings = Postings(table.column("n").to_numpy(), counts, term, tf, n_docs, length)
        item, place, score = [], [], []
        for i, query in enumerate(queries):
            found, own = postings.best(query, k)
            item.append(np.full(len(found), i, dtype=np.int32))
            place.append(found)
            score.append(own)
        ids = table.column("id").take(pa.array(np.concatenate(place).astype(np.int64))).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(item)), ids, pa.array(np.concatenate(score))], names=["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield ranked(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield ranked(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"item int, doc_id {kind.simpleString()}, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``k`` best documents of each query: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    rows = iter(asked.toLocalIterator())
    found = []
    while block := list(islice(rows, QUERIES)):
        counts = [Counter(t for piece in terms(r["text"]) for t in piece) for r in block]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        postings = written(index(docs, vocabulary, doc_id, text), "postings")
        n_docs, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = frequencies(postings, len(vocabulary))
        queries = [
            [(t, times * weight(n_docs, df[t])) for t, times in sorted((vocabulary[t], n) for t, n in own.items()) if t in df]
            for own in counts
        ]
        queries = [sorted(q, key=lambda x: (df[x[0]], x[0])) for q in queries]
        best = first_of_blocks(postings, queries, n_docs, length, k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        first = best.withColumn("rank", place).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found.append(first.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        kinds = [f.dataType.simpleString() for f in (asked.schema["item_id"], docs.select(doc_id).schema[0])]
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    return reduce(DataFrame.unionByName, found)
