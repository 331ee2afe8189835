"""Quality rules and n-gram perplexity.

Character 4-grams over a fixed alphabet of 64 classes are counted by Spark over all texts
of a language and make an interpolated modified Kneser-Ney model. A model is a few sorted
arrays: hashed n-grams with log probabilities and hashed contexts with log back-off
weights. An n-gram fits 24 bits and the hash is one to one, so a language has at most
64 ** 4 entries however large the corpus; what is counted grows with the corpus.

A document's perplexity is compared with the bands of its language: the median of log
perplexity over all documents that pass the base rules, plus or minus a number of robust
deviations, widened for short texts. Outside the band it is rejected.

Defined cases: a null or empty text has no words and fails the base rules; a null language
is a language of its own; very long texts are taken whole, in slices that overlap; repeated
rows count each; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import each, written

ORDER = 4
CLASS_BITS = 6
CLASSES = 1 << CLASS_BITS
#: Characters whose n-grams are sorted at once.
CHARS = 2_000_000
#: Width of the bands in robust deviations, and what a text of n characters adds, times 1 / sqrt(n).
WIDTH, SHORT = 5.0, 1.0
#: Least width of a band on either side, as log perplexity.
LEAST_WIDTH = 0.02
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
MIX = np.uint32(0x9E3779B1)


def character_classes() -> np.ndarray:
    """The class of each code point up to U+FFFF; 0 is the start of a text.

    Letters a to z are 1 to 26, white space 27, digits 28, marks 29 to 40, other ASCII 41;
    other letters are spread over 42 to 59, everything else over 60 to 63.
    """
    table = np.zeros(1 << 16, dtype=np.uint32)
    marks = ".,;:!?'\"()-/"
    for cp in range(1 << 16):
        c = chr(cp)
        if "a" <= c <= "z" or "A" <= c <= "Z":
            table[cp] = ord(c.lower()) - 96
        elif c.isspace():
            table[cp] = 27
        elif "0" <= c <= "9":
            table[cp] = 28
        elif c in marks:
            table[cp] = 29 + marks.index(c)
        elif cp < 128:
            table[cp] = 41
        elif unicodedata.category(c)[0] == "L":
            table[cp] = 42 + ord(c.lower()[0]) % 18
        else:
            table[cp] = 60 + cp % 4
    return table


def grams(text: str, classes: np.ndarray) -> np.ndarray:
    """One packed 4-gram for each character, the text's start padded."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.zeros(len(points) + ORDER - 1, dtype=np.uint32)
    codes[ORDER - 1 :] = classes[np.minimum(points, 0xFFFF)]
    key = codes[: len(points)].copy()
    for k in range(1, ORDER):
        key = (key << np.uint32(CLASS_BITS)) | codes[k : k + len(points)]
    return key


def hashed(key: np.ndarray) -> np.ndarray:
    """One to one on 32 bits."""
    return key.astype(np.uint32) * MIX


@dataclass
class Sorted:
    """A map from hashed keys to numbers, as sorted arrays."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Sorted:
        h = hashed(keys)
        order = np.argsort(h)
        return cls(h[order], values[order].astype(np.float32))

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and which keys there are."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.float32), np.zeros(len(keys), dtype=bool)
        h = hashed(keys)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        there = self.keys[at] == h
        return np.where(there, self.values[at], np.float32(0)), there


@dataclass
class KneserNey:
    """``grams[n]``: log probability of seen n-grams; ``backoff[n]``: by their contexts."""

    grams: list[Sorted]
    backoff: list[Sorted]
    unseen: float

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From the distinct packed n-grams of the highest order with their counts."""
        tables = {ORDER: (keys.astype(np.int64), counts.astype(np.int64))}
        for n in range(ORDER - 1, 0, -1):
            # Lower orders count the different characters seen before an n-gram.
            tables[n] = np.unique(tables[n + 1][0] & ((1 << CLASS_BITS * n) - 1), return_counts=True)
        grams, backoff = [Sorted(np.zeros(0, np.uint32), np.zeros(0, np.float32))], []
        backoff.append(grams[0])
        lower_keys, lower_p = np.zeros(1, np.int64), np.array([1.0 / CLASSES])
        uniform = 1.0 / CLASSES
        for n in range(1, ORDER + 1):
            k, c = tables[n]
            d = discounts(c)
            context, at = np.unique(k >> CLASS_BITS, return_inverse=True)
            total = np.bincount(at, weights=c)
            left = np.bincount(at, weights=d[np.minimum(c, 3)])
            gamma = left / total
            if n == 1:
                below = np.full(len(k), uniform)
            else:
                below = lower_p[np.searchsorted(lower_keys, k & ((1 << CLASS_BITS * (n - 1)) - 1))]
            p = (c - d[np.minimum(c, 3)]) / total[at] + gamma[at] * below
            grams.append(Sorted.of(k, np.log(p)))
            backoff.append(Sorted.of(context, np.log(np.maximum(gamma, 1e-9))))
            if n == 1:
                unseen = float(np.log(gamma[0] * uniform))
            lower_keys, lower_p = k, p
        return cls(grams, backoff, unseen)

    def log_probability(self, keys: np.ndarray) -> float:
        """Summed over packed n-grams: the longest that was seen, with the weights above it."""
        found, times = np.unique(keys, return_counts=True)
        out, rest = np.zeros(len(found)), np.arange(len(found))
        for n in range(ORDER, 0, -1):
            own = found[rest] & np.uint32((1 << CLASS_BITS * n) - 1)
            value, there = self.grams[n].get(own)
            out[rest[there]] += value[there]
            rest, own = rest[~there], own[~there]
            if not len(rest):
                break
            weight, _ = self.backoff[n].get(own >> np.uint32(CLASS_BITS))
            out[rest] += weight if n > 1 else self.unseen
        return float(out @ times)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and 3 or more; of tables too small to tell, fixed shares."""
    n = [int((counts == k).sum()) for k in range(5)]
    if not all(n[1:]):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    d = [0.0, *(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))]
    return np.array([min(max(x, 0.01 if k else 0.0), max(k - 0.01, 0.0)) for k, x in enumerate(d)])


def slices(text: str) -> Iterator[str]:
    """Parts of a text, each but the first led by what its first n-grams look back on."""
    for at in range(0, max(len(text), 1), CHARS):
        yield text[max(0, at - ORDER + 1) : at + CHARS]


def text_grams(text: str, classes: np.ndarray) -> Iterator[np.ndarray]:
    for k, part in enumerate(slices(text)):
        yield grams(part, classes)[ORDER - 1 if k else 0 :]


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``key``, ``n``: the packed 4-grams of all texts with their counts."""
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = character_classes()
        held: dict[str | None, list[np.ndarray]] = {}
        sizes: dict[str | None, int] = {}
        sums: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def merge(of: str | None) -> None:
            keys, n = np.unique(np.concatenate(held.pop(of)), return_counts=True)
            sizes[of] = 0
            if of in sums:
                keys, at = np.unique(np.concatenate([sums[of][0], keys]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([sums[of][1], n])).astype(np.int64)
            sums[of] = keys, n

        for batch in batches:
            for t, of in zip(*map(each, batch.columns), strict=True):
                for part in text_grams(t or "", classes):
                    held.setdefault(of, []).append(part)
                    sizes[of] = sizes.get(of, 0) + len(part)
                    if sizes[of] >= CHARS:
                        merge(of)
        for of in list(held):
            merge(of)
        for of, (keys, n) in sums.items():
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of] * len(part), pa.string()), pa.array(part.astype(np.int64)), pa.array(n[k : k + 100_000].astype(np.int64))],
                    schema=schema,
                )

    counted = docs.select(F.col(text), F.col(lang)).mapInArrow(count, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str | None, KneserNey]:
    """A model for each language, from counts over all texts.

    One language after the other comes to the driver, so it never holds the counts of two.
    """
    found = written(count_grams(docs, text, lang), "grams")
    out = {}
    for of in sorted((r["lang"] for r in found.select("lang").distinct().collect()), key=lambda x: (x is None, x)):
        own = found.filter(F.col("lang").eqNullSafe(F.lit(of).cast("string"))).select("key", "n").toArrow()
        keys, n = own.column("key").to_numpy(), own.column("n").to_numpy()
        order = np.argsort(keys)
        out[of] = KneserNey.of(keys[order], n[order])
    return out


def base(text: str | None) -> dict[str, int]:
    """The counts that the base rules look at; words are parted by ASCII white space."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    white = sum(text.count(chr(c)) for c in SPACE)
    lines = [x for x in text.split("\n") if x.strip(SPACE.decode())]
    return {
        "n_words": len(words),
        "word_chars": len(text) - white,
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated(words),
    }


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three words found more than once."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    own = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pair = own[:-2] * len(number) + own[1:-1]
    if len(number) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, n = np.unique(pair * len(number) + own[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, models: dict[str | None, KneserNey], text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows as ``row`` (a struct of all columns), with the counts, ``base_failed``,
    ``chars`` and ``log_ppl``, the mean negative log probability of a character."""
    sc = docs.sparkSession.sparkContext
    # One broadcast for each language: a task fetches those that it meets.
    parts = lambda m: ([(t.keys, t.values) for t in m.grams], [(t.keys, t.values) for t in m.backoff], m.unseen)
    shared = {of: sc.broadcast(parts(m)) for of, m in models.items()}
    kind = pa.struct([*[(c, pa.int64()) for c in COUNTS], ("chars", pa.int64()), ("log_ppl", pa.float64())])

    @F.arrow_udf(f"struct<{', '.join(f'{c}: long' for c in COUNTS)}, chars: long, log_ppl: double>")
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        classes = character_classes()
        own: dict[str | None, KneserNey] = {}
        for texts, langs in batches:
            out = []
            for t, of in zip(each(texts), each(langs), strict=True):
                if of not in own:
                    grams_, backoff, unseen = shared[of].value
                    own[of] = KneserNey([Sorted(*x) for x in grams_], [Sorted(*x) for x in backoff], unseen)
                logs = sum(own[of].log_probability(part) for part in text_grams(t, classes)) if t else 0.0
                out.append({**base(t), "chars": len(t or ""), "log_ppl": -logs / len(t) if t else None})
            yield pa.array(out, kind)

    rows = docs.select(F.struct("*").alias("row"), F.col(lang).alias("lang"), found.asNondeterministic()(F.col(text), F.col(lang)).alias("found"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("row", "lang", "found.*").withColumn("base_failed", failed)


def bands(scored: DataFrame) -> DataFrame:
    """For each language ``lower`` and ``upper`` log perplexity, from all that pass the base rules."""
    fair = scored.filter("not base_failed and log_ppl is not null")
    middle = fair.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("middle"))
    joined = fair.alias("f").join(F.broadcast(middle).alias("m"), F.col("f.lang").eqNullSafe(F.col("m.lang")))
    off = joined.select("f.lang", "middle", F.abs(F.col("log_ppl") - F.col("middle")).alias("off"))
    spread = off.groupBy("lang", "middle").agg(F.percentile_approx("off", 0.5, 10_000).alias("off"))
    width = F.greatest(F.col("off") * 1.4826 * WIDTH, F.lit(LEAST_WIDTH))
    return spread.select("lang", (F.col("middle") - width).alias("lower"), (F.col("middle") + width).alias("upper"))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with its counts, ``base_failed``, ``log_ppl``, its
    language's band and ``kept``."""
    scored = written(
        measured(docs, fit(docs, text, lang), text, lang).select(F.struct(*[f"row.{c}" for c in keep]).alias("row"), "lang", *COUNTS, "chars", "log_ppl", "base_failed"),
        "quality",
    )
    limits = written(bands(scored), "bands")
    all_rows = scored.alias("s").join(F.broadcast(limits).alias("b"), F.col("s.lang").eqNullSafe(F.col("b.lang")), "left")
    slack = SHORT / F.sqrt(F.greatest("chars", F.lit(1)))
    inside = F.col("log_ppl").between(F.col("lower") - slack, F.col("upper") + slack)
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return all_rows.select("row.*", *COUNTS, "base_failed", "log_ppl", "lower", "upper", kept.alias("kept"))
