"""Language identification by word-first backoff.

A word that any language knows is scored by its log frequency in each language. An
unseen word is scored by its character n-grams, from the longest order of which some
n-gram is known down to single characters. A text takes the language with the best mean
score over its words.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a text whose
letters no model knows takes the most frequent language with score 1 / languages; without
any labelled text everything is ``und``; ties go to the language first by name; extra
columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import each, hash_share, written

#: Labelled documents of a language that the model is fitted on, in expectation.
DOCS_PER_LANG = 5_000
#: Entries of one table (words, or n-grams of one order) of a language. An entry needs a
#: share of at least 1 / MAX_ENTRIES of the table's total, so there can't be more.
MAX_ENTRIES = 50_000
MAX_ORDER = 5
#: Score, as a negative decimal log frequency, where a language lacks the entry.
PENALTY = 7.0
#: Words whose scores a task remembers.
CACHE = 300_000

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
KIND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass
class LanguageModel:
    """``tables[0]`` has words, ``tables[n]`` the n-grams of order n: entry to scores."""

    langs: list[str]
    prior: int
    tables: list[dict[str, tuple[float, ...]]]
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def word(self, word: str) -> tuple[float, ...] | None:
        """A word's score for each language; ``None`` if not even a character is known."""
        if known := self.tables[0].get(word):
            return known
        padded = f" {word} "
        for n in range(min(MAX_ORDER, len(padded)), 0, -1):
            table = self.tables[n]
            grams = [padded[i : i + n] for i in range(len(padded) - n + 1)]
            found = [x for g in grams if g.strip() and (x := table.get(g))]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*found, strict=True))
        return None

    def remember(self, word: str) -> int:
        """The row of a new word in ``scores``; a word that no model knows is a row of zeros."""
        at = self.cache[word] = len(self.cache)
        found = self.word(word)
        self.scores[at] = (*found, 1.0) if found else 0.0
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not self.langs or not any(map(str.isalpha, "".join(words))):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs) + 1)
        for start in range(0, len(words), 20_000):
            total += self.sum(words[start : start + 20_000])
        if not total[-1]:
            return self.langs[self.prior], 1.0 / len(self.langs)
        mean = total[:-1] / total[-1]
        best = int(mean.argmin())
        return self.langs[best], float(1.0 / np.power(10.0, mean[best] - mean).sum())

    def sum(self, words: list[str]) -> np.ndarray:
        """Summed scores by language, and how many words had any."""
        if self.scores is None:
            self.scores = np.zeros((CACHE, len(self.langs) + 1))
        if len(self.cache) + len(words) > CACHE:
            self.cache.clear()
        known = self.cache.get
        rows = [known(w) for w in words]
        if None in rows:
            rows = [self.remember(w) if (at := known(w)) is None else at for w in words]
        return self.scores[rows].sum(axis=0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", by: str = "doc_id") -> LanguageModel:
    """A model from labelled texts; rows without text or language are left out.

    Words and n-grams are counted by Spark over a hash sample of ``DOCS_PER_LANG``
    documents a language. What comes to the driver has at most ``MAX_ENTRIES`` entries a
    table, ``MAX_ORDER + 1`` tables a language.
    """
    rows = labelled.select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(by).alias("by")
    ).filter("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    # One row a language, as many as the model itself has: the texts stay where they are.
    sample = rows.join(F.broadcast(sizes), "lang").filter(hash_share(F.col("by"), DOCS_PER_LANG / F.col("docs")))
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("entry"))
    counted = written(
        words.filter("entry <> ''").groupBy("lang", "entry").agg(F.count(F.lit(1)).alias("n")), "lang-words"
    )
    padded = counted.select("lang", F.concat(F.lit(" "), "entry", F.lit(" ")).alias("padded"), "n")
    grams = padded.select("lang", "padded", "n", F.explode(F.sequence(F.lit(1), F.lit(MAX_ORDER))).alias("size"))
    grams = grams.filter(F.length("padded") >= F.col("size")).select(
        "lang",
        "size",
        "n",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("padded") - F.col("size") + 1),
                lambda i: F.substring(F.col("padded"), i, F.col("size")),
            )
        ).alias("entry"),
    )
    entries = counted.select("lang", F.lit(0).alias("size"), "entry", "n").unionByName(
        grams.filter(F.trim("entry") != "").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    )
    entries = written(entries, "lang-entries")
    totals = entries.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    frequent = entries.join(F.broadcast(totals), ["lang", "size"]).filter(F.col("n") * MAX_ENTRIES >= F.col("total"))
    found = frequent.select("lang", "size", "entry", (F.col("n") / F.col("total")).alias("share")).collect()
    docs = {r["lang"]: r["docs"] for r in sizes.collect()}
    langs = sorted({r["lang"] for r in found})
    place = {lang: i for i, lang in enumerate(langs)}
    tables: list[dict] = [{} for _ in range(MAX_ORDER + 1)]
    for r in found:
        scores = tables[r["size"]].setdefault(r["entry"], [PENALTY] * len(langs))
        scores[place[r["lang"]]] = -math.log10(r["share"])
    frozen = [{k: tuple(v) for k, v in t.items()} for t in tables]
    prior = max(range(len(langs)), key=lambda i: (docs[langs[i]], -i), default=0)
    return LanguageModel(langs, prior, frozen)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows as ``row`` (a struct of all columns), with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.tables))

    @F.arrow_udf("struct<lang_pred:string, score:double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = LanguageModel(*shared.value).predict
        for batch in batches:
            yield pa.array([dict(zip(("lang_pred", "score"), predict(t), strict=True)) for t in each(batch)], KIND)

    rows = docs.select(F.struct("*").alias("row"), found.asNondeterministic()(F.col(text)).alias("found"))
    return rows.select("row", "found.*")
