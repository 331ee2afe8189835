"""Spelling variants by a trie of letter-group frequencies.

A word becomes a vector: how many of its letters are in each of ``GROUPS`` groups. Vectors are the paths of
a trie, one level a group. Words that differ by one inserted, deleted or replaced code point
differ by a surplus of at most one letter and a deficit of at most one, over all groups together, so a depth-first
search spends a budget of one surplus and one deficit on its way down and verifies the words in the leaves it reaches.

The trie is split by the counts of its first ``depth`` levels: each word is stored under its own
path, and asks under all paths that the budget reaches, with what is left of it. ``depth`` is the smallest that leaves
no more than ``SUBTRIE`` words under a path, as counted over all words. In a group all asking words go down the subtrie
together: a node keeps, as arrays, those whose budget lasts, with what is left; below a node of ``NODE`` words the rest of
the path is compared at once.
What a group returns per word (number of near words, best of them) is summed up; each near word has
one path, so nothing is counted twice.

Defined cases: a null text has no words; a null ``doc_id`` counts as an empty id where a code point is deleted; repeated
rows count each; of near words with equally many occurrences the smallest in code-point order is the form; a word without a near word
has null ``form`` and ``form_n``, itself as ``root`` and 0 as ``n_near``. Texts are taken whole, however long: a task
holds the distinct runs of one text, and counts are passed on from ``HELD`` words. An empty table gives an
empty result; extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import each, written

#: Least code points and least occurrences of a word.
LENGTH, TIMES = 6, 5
#: A form has at least so many times the occurrences of its variant.
RATIO = 5
#: Of the runs' hashes, one in so many deletes a code point.
DELETES = 199
#: Letter groups; the letters a to z have one each, most frequent first so that the first levels divide well.
GROUPS = 40
#: Words under a path, words of a node that are compared at once, and words that a task counts before it passes them on.
SUBTRIE, NODE, HELD = 30_000, 64, 200_000
#: Asking words that are compared with a node at once.
ASKED = 4096
#: Follows of forms, doubled each time: occurrences grow by RATIO a step, so 2**5 steps pass any 64-bit count.
DOUBLINGS = 5

#: A run of at least LENGTH letters, in Latin-1 and lower-cased; shorter ones can't become words.
RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LENGTH)
FREQUENT = "entiarhouscldgbmfwypvkzqxj"


def runs_of(text: str | None) -> Counter:
    """The long runs of a text, A-Z as a-z. What Latin-1 lacks is no letter here and parts runs."""
    found = Counter(RUN.findall((text or "").encode("latin-1", "replace").lower()))
    return Counter({run.decode("latin-1"): n for run, n in found.items()})


def group_of(letter: str) -> int:
    """The letters a to z have a group each, all others share the rest."""
    at = FREQUENT.find(letter)
    return at if at >= 0 else len(FREQUENT) + ord(letter) % (GROUPS - len(FREQUENT))


GROUP = {chr(c): group_of(chr(c)) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]}


def vector(word: str) -> bytes:
    """How many letters are in each group, a byte a count. More than 255 count as 255: that only brings words nearer."""
    counts = [0] * GROUPS
    for letter in word:
        counts[GROUP[letter]] += 1
    return bytes(min(c, 255) for c in counts)


def words_of(doc_id, runs: Counter) -> Iterator[tuple[str, int]]:
    """The words of a document by its lower-cased runs: in some a code point is deleted."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), prefix)
        if h % DELETES == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LENGTH:
            yield run, n


def vocabulary(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``word, n``: all words with their occurrences, rare ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), each(batch.column(1)), strict=True):
                for word, n in words_of(own, runs_of(value)):
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= TIMES)


def near(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def reached(counts: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """Paths within a budget of one surplus and one deficit, with what is left of either."""
    yield counts, 1, 1
    for i in range(len(counts)):
        more = (*counts[:i], counts[i] + 1, *counts[i + 1 :])
        yield more, 0, 1
        for j in range(len(counts)):
            if j != i and counts[j]:
                yield (*more[:j], more[j] - 1, *more[j + 1 :]), 0, 0
        if counts[i]:
            yield (*counts[:i], counts[i] - 1, *counts[i + 1 :]), 1, 0


def asked(depth: int):
    """Batches of (word, n, vector) to rows by path: the word as stored (``left`` -1) and as asking (what is left, in two bits)."""
    schema = pa.schema([("path", pa.binary()), ("word", pa.string()), ("n", pa.int64()), ("vector", pa.binary()), ("left", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                path, at, left = [], [], []
                part = batch.slice(start, 512)
                for i, own in enumerate(part.column(2).to_pylist()):
                    path.append(own[:depth])
                    at.append(i)
                    left.append(-1)
                    for counts, surplus, deficit in reached(tuple(own[:depth])):
                        path.append(bytes(min(c, 255) for c in counts))
                        at.append(i)
                        left.append(2 * surplus + deficit)
                at = pa.array(at, pa.int64())
                columns = [pa.array(path, pa.binary()), *(part.column(i).take(at) for i in range(3)), pa.array(left, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def ends(words: list[str]) -> np.ndarray:
    """The first and the last ``LENGTH // 2`` letters of words, as numbers."""
    k = LENGTH // 2
    data = [w.encode("latin-1") for w in words]
    return np.array([(int.from_bytes(d[:k]), int.from_bytes(d[-k:])) for d in data], dtype=np.int64).reshape(-1, 2)


class Search:
    """A depth-first search of all asking words in a subtrie at once."""

    def __init__(self, words: list[str], n: list[int], stored: np.ndarray, asking: np.ndarray, ask_words: list[str]):
        self.words, self.n, self.ask_words = words, n, ask_words
        self.stored, self.asking = stored, asking
        odd = np.int64(1) << np.arange(stored.shape[1], dtype=np.int64)
        self.stored_parity, self.asking_parity = ((v % 2).astype(np.int64) @ odd for v in (stored, asking))
        self.stored_ends, self.asking_ends = ends(words), ends(ask_words)
        self.near = np.zeros(len(ask_words), dtype=np.int64)
        self.best: list[tuple[int, str] | None] = [None] * len(ask_words)

    def descend(self, low: int, high: int, level: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """Stored words ``low`` to ``high``, in order of their vectors, agree above ``level``; ``who`` may still reach them."""
        if level == self.stored.shape[1] or high - low <= NODE:
            return self.rest(low, high, level, who, surplus, deficit)
        column = self.stored[low:high, level]
        cuts = [low, *(low + 1 + np.flatnonzero(column[1:] != column[:-1])), high]
        own = self.asking[who, level]
        for a, b in zip(cuts, cuts[1:], strict=False):
            more = self.stored[a, level] - own
            s, d = surplus - np.maximum(more, 0), deficit + np.minimum(more, 0)
            alive = (s >= 0) & (d >= 0)
            if alive.any():
                self.descend(a, b, level + 1, who[alive], s[alive], d[alive])

    def rest(self, low: int, high: int, level: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """Go down to the leaves of a small node with those whose budget lasts, and verify the words there.

        A budget of two single letters changes the parity of two groups at most, which one number tells for all groups.
        """
        for at in range(0, len(who), ASKED):
            own = who[at : at + ASKED]
            words, asks = np.nonzero(np.bitwise_count(self.stored_parity[low:high, None] ^ self.asking_parity[own]) <= 2)
            more = self.stored[low + words, level:] - self.asking[own[asks], level:]
            up = np.maximum(more, 0).sum(axis=1)
            alive = (up <= surplus[at + asks]) & (up - more.sum(axis=1) <= deficit[at + asks])
            # One edit leaves the first or the last letters as they are.
            alive &= (self.stored_ends[low + words] == self.asking_ends[own[asks]]).any(axis=1)
            for i, w in zip((low + words[alive]).tolist(), own[asks[alive]].tolist(), strict=True):
                word, n = self.words[i], self.n[i]
                if near(word, self.ask_words[w]):
                    self.near[w] += 1
                    if (best := self.best[w]) is None or (-n, word) < best:
                        self.best[w] = (-n, word)


def searched(depth: int):
    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy()
        n, words = table.column("n").to_pylist(), table.column("word").to_pylist()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.uint8).reshape(len(left), -1)[:, depth:].astype(np.int16)
        stored, asking = np.flatnonzero(left < 0), np.flatnonzero(left >= 0)
        if len(stored) and vectors.shape[1]:
            stored = stored[np.lexsort(vectors[stored].T[::-1])]
        ask = [words[i] for i in asking]
        search = Search([words[i] for i in stored], [n[i] for i in stored], vectors[stored], vectors[asking], ask)
        if len(stored) and len(asking):
            search.descend(0, len(stored), 0, np.arange(len(asking)), (left[asking] >> 1).astype(np.int16), (left[asking] & 1).astype(np.int16))
        hit = np.flatnonzero(search.near)
        return pa.table({
            "word": pa.array([ask[i] for i in hit], pa.string()),
            "n_near": pa.array(search.near[hit]),
            "form_n": pa.array([-search.best[i][0] for i in hit], pa.int64()),
            "form": pa.array([search.best[i][1] for i in hit], pa.string()),
        })

    return run


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best`` for the stored words (word, n, vector) that have near words; best is ``(-n, word)``."""
    for depth in range(3, GROUPS + 1):
        path = F.substring("vector", 1, depth)
        largest = words.groupBy(path.alias("path")).count().agg(F.max("count")).first()[0] or 0
        if largest <= SUBTRIE:
            break
    rows = words.mapInArrow(asked(depth), "path binary, word string, n long, vector binary, left int")
    found = rows.groupBy("path").applyInArrow(searched(depth), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus_n"), F.col("form").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form (word, form): the last word that following forms reaches."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All words: ``word, form, root, n, n_near, form_n``."""
    as_vector = F.udf(vector, "binary", useArrow=True)
    words = written(vocabulary(docs, doc_id, text).withColumn("vector", as_vector("word")), "words")
    best = near_words(words)
    joined = words.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.minus_n") >= RATIO * F.col("n")
    named = written(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best.word")).alias("form"),
            F.when(is_form, -F.col("best.minus_n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(named.filter("form is not null").select("word", "form"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
