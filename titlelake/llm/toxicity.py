"""Toxic spans by a linear-chain conditional random field.

Token labels come from labelled documents: a word is marked in a toxic document if far
more toxic documents have it than others do. A chain of two states, clean and toxic, is
fitted on the marked tokens: weights for words, their first and last letters, and
transitions. Forward and backward sums give each token's chance to be toxic; the document
score is a logistic model of the highest chance and of the expected number of toxic tokens.

The sums run over a whole batch of documents at once: the batch is cut into short blocks,
each block's 2 x 2 transfer matrix is multiplied out for all blocks together, and a second
pass fills in the tokens. This is exact; a document's first token cuts it off from others.

Defined cases: a null or empty text has the score of a text without toxic tokens; without
any labelled toxic document every score is 0; repeated rows are scored each; extra columns
are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import SLICE, hash_share
from titlelake.llm.learn import Adam, logistic, sigmoid

#: Labelled documents of each label that the model is fitted on, in expectation.
FIT_TOXIC, FIT_CLEAN = 600, 1_200
#: Standard errors by which a word's share among toxic documents must exceed that among others.
MARKED = 5.0
#: Documents of the sample that must have a word or affix for it to be a feature.
LEAST_DOCS = 3
AFFIX = 4
BLOCK = 64
ROUNDS = 40
CACHE = 500_000
SPAN = 0.5

WORD = re.compile(r"[^\W\d_]+")


def folded(text: str | None) -> str:
    """Lower case of the same length."""
    low = (text or "").lower()
    return low if len(low) == len(text or "") else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def named(word: str) -> tuple[str, ...]:
    """The features of a word."""
    return word, f"{word[:AFFIX]}*", f"*{word[-AFFIX:]}"


def transfer(emission: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Matrices (blocks, BLOCK, 2, 2) from one token's state to the next; identity beyond the end."""
    n = len(emission)
    m = np.broadcast_to(np.eye(2), (-(-n // BLOCK) * BLOCK, 2, 2)).copy()
    m[:n] = np.exp(moves[1:])
    m[:n][starts] = np.exp(moves[0])
    m[:n, :, 1] *= np.exp(np.clip(emission, -30, 30))[:, None]
    return m.reshape(-1, BLOCK, 2, 2)


def sums(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums at each token, scaled."""
    blocks = len(m)
    whole = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for k in range(BLOCK):
        whole = whole @ m[:, k]
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    at, after = np.empty((blocks, 2)), np.empty((blocks, 2))
    v = np.array([0.5, 0.5])
    for b in range(blocks):
        at[b] = v
        v = v @ whole[b]
        v = v / v.sum()
    v = np.array([0.5, 0.5])
    for b in range(blocks - 1, -1, -1):
        after[b] = v
        v = whole[b] @ v
        v = v / v.sum()
    forward, backward = np.empty((blocks, BLOCK, 2)), np.empty((blocks, BLOCK, 2))
    for k in range(BLOCK):
        at = np.einsum("bi,bij->bj", at, m[:, k])
        at /= at.sum(axis=1, keepdims=True)
        forward[:, k] = at
    for k in range(BLOCK - 1, -1, -1):
        backward[:, k] = after
        after = np.einsum("bij,bj->bi", m[:, k], after)
        after /= after.sum(axis=1, keepdims=True)
    return forward.reshape(-1, 2), backward.reshape(-1, 2)


def marginals(emission: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Each token's chance to be toxic. ``moves``: log weights of the start and from each state."""
    if not len(emission):
        return np.zeros(0)
    forward, backward = sums(transfer(emission, starts, moves))
    both = forward[: len(emission)] * backward[: len(emission)]
    return both[:, 1] / both.sum(axis=1)


def gathered(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: 1, the highest chance, and the log of one plus their sum."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1.0
    full = np.flatnonzero(lengths)
    if len(full):
        ends = np.cumsum(lengths[full])
        begins = ends - lengths[full]
        out[full, 1] = np.maximum.reduceat(p, begins)
        out[full, 2] = np.log1p(np.add.reduceat(p, begins))
    return out


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float
    moves: np.ndarray
    document: np.ndarray

    def __post_init__(self) -> None:
        self.cache: dict[str, float] = {}

    def emission(self, words: list[str]) -> list[float]:
        known = self.cache.get
        out = [known(w) for w in words]
        if None in out:
            if len(self.cache) > CACHE:
                self.cache.clear()
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    out[i] = self.cache[w] = self.bias + sum(self.weights.get(f, 0.0) for f in named(w))
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """Scores, and the toxic spans of each text as start:end, in code points."""
        low = [folded(t) for t in texts]
        words = [WORD.findall(t) for t in low]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        emission = np.array([x for w in words for x in self.emission(w)])
        starts = np.zeros(len(emission), dtype=bool)
        begins = np.cumsum(lengths) - lengths
        starts[begins[lengths > 0]] = True
        p = marginals(emission, starts, self.moves)
        spans = []
        for text, begin, n in zip(low, begins, lengths, strict=True):
            toxic = p[begin : begin + n] >= SPAN
            spans.append(self.spans(text, toxic) if toxic.any() else "")
        return sigmoid(gathered(p, lengths) @ self.document), spans

    @staticmethod
    def spans(text: str, toxic: np.ndarray) -> str:
        out: list[list[int]] = []
        last = -2
        for i, m in enumerate(WORD.finditer(text)):
            if toxic[i]:
                if last == i - 1:
                    out[-1][1] = m.end()
                else:
                    out.append([m.start(), m.end()])
                last = i
        return ",".join(f"{a}:{b}" for a, b in out)


def marked_words(toxic: list[set[str]], clean: list[set[str]]) -> set[str]:
    """Words that far more of the toxic documents have."""
    n1, n0 = len(toxic), max(len(clean), 1)
    c1, c0 = Counter(w for d in toxic for w in d), Counter(w for d in clean for w in d)
    out = set()
    for w, k in c1.items():
        both = (k + c0[w] + 1) / (n1 + n0 + 2)
        error = (both * (1 - both) * (1 / n1 + 1 / n0)) ** 0.5
        if k >= LEAST_DOCS and k / n1 - c0[w] / n0 > MARKED * error:
            out.add(w)
    return out


def train(texts: list[str], toxic: list[bool]) -> ToxicModel | None:
    """A model from whole labelled texts; ``None`` if none is toxic."""
    if not any(toxic):
        return None
    words = [WORD.findall(folded(t)) for t in texts]
    kinds = [set(w) for w in words]
    marked = marked_words([k for k, t in zip(kinds, toxic, strict=True) if t], [k for k, t in zip(kinds, toxic, strict=True) if not t])
    found = Counter(f for k in kinds for f in {f for w in k for f in named(w)})
    place = {f: i for i, f in enumerate(sorted(f for f, n in found.items() if n >= LEAST_DOCS))}
    none = len(place)
    rows: dict[str, list[int]] = {w: [place.get(f, none) for f in named(w)] for k in kinds for w in k}
    token = np.array([rows[w] for d in words for w in d], dtype=np.int32).reshape(-1, 3)
    label = np.array([t and w in marked for d, t in zip(words, toxic, strict=True) for w in d], dtype=float)
    lengths = np.array([len(d) for d in words], dtype=np.int64)
    starts = np.zeros(len(token), dtype=bool)
    starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    weights, moves, bias = np.zeros(none + 1), np.zeros((3, 2)), np.array([-3.0])
    state = label.astype(int)
    inner = np.flatnonzero(~starts)
    seen = np.zeros((3, 2))
    np.add.at(seen[0], state[starts], 1)
    np.add.at(seen, (1 + state[inner - 1], state[inner]), 1)
    adam = Adam([weights, moves, bias], 0.2)
    for _ in range(ROUNDS if len(token) else 0):
        emission = bias[0] + weights[token].sum(axis=1)
        m = transfer(emission, starts, moves)
        forward, backward = sums(m)
        both = forward[: len(token)] * backward[: len(token)]
        p = both[:, 1] / both.sum(axis=1)
        pairs = forward[inner - 1, :, None] * m.reshape(-1, 2, 2)[inner] * backward[inner, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        expected = np.concatenate([[[(1 - p[starts]).sum(), p[starts].sum()]], pairs.sum(axis=0)])
        slope = np.zeros(none + 1)
        for k in range(3):
            slope += np.bincount(token[:, k], weights=p - label, minlength=none + 1)
        slope += 0.1 * weights
        slope[none] = 0.0
        adam.step([slope, expected - seen + 0.1 * moves, np.array([(p - label).sum()])])
    own = {f: float(weights[i]) for f, i in place.items() if abs(weights[i]) > 1e-3}
    model = ToxicModel(own, float(bias[0]), moves, np.zeros(3))
    p = marginals(np.array([x for d in words for x in model.emission(d)]), starts, moves)
    model.document = logistic(gathered(p, lengths), np.array(toxic, dtype=float), rounds=2000, decay=1e-3)
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicModel | None:
    """A model from the labelled documents in a bounded sample by hash, in expectation
    ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` clean ones; only these reach the driver."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label")).filter("id is not null and label is not null")
    known = known.groupBy("id").agg((F.max(F.col("label").cast("int")) > 0).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic"), FIT_TOXIC / max(sizes.get(True, 0), 1)).otherwise(FIT_CLEAN / max(sizes.get(False, 0), 1))
    sample = known.filter(hash_share(F.col("id"), share))
    rows = docs.join(F.broadcast(sample), F.col(doc_id) == F.col("id")).select(F.coalesce(F.col(text), F.lit("")).alias("text"), "toxic")
    found = sorted(tuple(r) for r in rows.distinct().collect())
    return train([t for t, _ in found], [x for _, x in found])


def score(docs: DataFrame, model: ToxicModel | None, text: str = "text") -> DataFrame:
    """The rows as ``row`` (a struct of all columns), with ``score`` and toxic ``spans``."""
    parts = (model.weights, model.bias, model.moves, model.document) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    kind = pa.struct([("score", pa.float64()), ("spans", pa.string())])

    @F.arrow_udf("struct<score: double, spans: string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = ToxicModel(*shared.value) if shared.value else None
        for batch in batches:
            scores, spans = [], []
            for k in range(0, len(batch), SLICE):
                texts = batch.slice(k, SLICE).to_pylist()
                s, where = own.score(texts) if own else (np.zeros(len(texts)), [""] * len(texts))
                scores += s.tolist()
                spans += where
            columns = [pa.array(scores, pa.float64()), pa.array(spans, pa.string())]
            yield pa.StructArray.from_arrays(columns, fields=list(kind))

    rows = docs.select(F.struct("*").alias("row"), found.asNondeterministic()(F.col(text)).alias("found"))
    return rows.select("row", "found.*")
