"""Packing token sequences by vector bin packing.

Examples are placed in sequences under three limits at once: tokens, segments and tokens
that bear loss. The sequence that is open takes, of all waiting pieces that fit, the one
with the largest dot product of its demands and what the sequence has left, both as shares
of the limits. When none fits, a waiting piece is cut to fill the gap. What remains at the
end of a partition is cut into sequences whose lengths are powers of two, which need no
padding. Each partition is packed on its own, in bounded memory and without a shuffle.

Defined cases: a null or empty text gives the end token alone; a very long one is cut into
whole sequences; repeated rows are packed each; an empty table gives an empty result; extra
columns are left alone. Names of added tokens in a text become their ids if they are given
to ``pack``, and are ordinary text otherwise.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import each

#: The id that ends each document.
END = 1
#: Pieces of text whose ids a task remembers.
CACHE = 400_000
#: Pieces that wait for a place at once, at most.
WAITING = 4096
#: Sequence numbers of one partition.
PER_PARTITION = 1 << 40

OUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Encoder:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    Between two characters that aren't white space, a single space always begins a piece
    of its own in this vocabulary's pattern. Such texts are encoded word by word from
    memory; all others as a whole. The ids are the same.
    """

    def __init__(self, ranks: str, pattern: str, added: dict[str, int] | None = None):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}
        self.added = {name: np.array([i], dtype="<u4").tobytes() for name, i in (added or {}).items()}
        # Of names that begin alike the longest is meant.
        self.names = re.compile("(" + "|".join(re.escape(n) for n in sorted(self.added, key=len, reverse=True)) + ")")

    def whole(self, text: str) -> bytes:
        return np.array(self.plain(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not any(name in text for name in self.added):
            return self.ordinary(text)
        return b"".join(self.added[part] if part in self.added else self.ordinary(part) for part in self.names.split(text) if part)

    def ordinary(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if not first or first[-1].isspace():
            return self.whole(text)
        if len(self.cache) > CACHE:
            self.cache.clear()
        out = [self.cache.get(w) for w in words]
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    w = words[i]
                    if not w or w[0].isspace() or w[-1].isspace():
                        return self.whole(text)
                    out[i] = self.cache[w] = self.whole(f" {w}")
        return self.whole(first) + b"".join(out)


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file, by name, as it finds them in texts."""
    with open(vocabulary, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that depend on their surroundings")
    return {t["content"]: t["id"] for t in added}


class Packer:
    """Pieces in, rows out: ``add`` pieces, ``ready`` gives rows as sequences close."""

    def __init__(self, limits: Limits, numbers_from: int):
        self.limits, self.number = limits, numbers_from
        self.most = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64)
        self.pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens, tokens of it before the loss begins)
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray, loss_from: int) -> None:
        step = self.limits.tokens
        for start in range(0, len(ids), step):
            part = ids[start : start + step]
            self.pieces.append((doc_id, start, part, len(ids), min(max(loss_from - start, 0), len(part))))
            self.tokens += len(part)

    def ready(self, end: bool = False) -> Iterator[tuple]:
        """Close sequences while enough pieces wait to choose from; at the end, all."""
        least = 0 if end else max(self.limits.tokens * 64, 1)
        if not end and len(self.pieces) < WAITING:
            return
        n = np.array([len(p[2]) for p in self.pieces], dtype=np.int64)
        loss = n - np.array([p[4] for p in self.pieces], dtype=np.int64)
        alive = np.ones(len(n), dtype=bool)
        # Room for the rests of pieces that go back after a cut.
        spare = np.zeros(self.limits.segments + 1, dtype=np.int64)
        self.pieces += [()] * len(spare)
        n, loss, alive = np.append(n, spare), np.append(loss, spare), np.append(alive, spare > 0)
        while self.tokens > least:
            chosen = self.fill(n, loss, alive)
            yield from self.close(chosen)
        self.pieces = [p for p, a in zip(self.pieces, alive, strict=True) if a]

    def cut(self, i: int, keep: int, n: np.ndarray, loss: np.ndarray) -> tuple:
        """The first ``keep`` tokens of piece i; the rest waits on in its place."""
        doc_id, start, ids, whole, before = self.pieces[i]
        self.pieces[i] = (doc_id, start + keep, ids[keep:], whole, max(before - keep, 0))
        n[i], loss[i] = len(ids) - keep, len(ids) - keep - max(before - keep, 0)
        return doc_id, start, ids[:keep], whole, min(before, keep)

    def fill(self, n: np.ndarray, loss: np.ndarray, alive: np.ndarray) -> list[tuple]:
        left, chosen = self.most.copy(), []
        while left[0] and left[1]:
            fits = alive & (n <= left[0]) & (loss <= left[2])
            if fits.any():
                share = left / (self.most * self.most)
                value = np.where(fits, n * share[0] + share[1] + loss * share[2], -1.0)
                i = int(value.argmax())
                alive[i] = False
                piece = self.pieces[i]
            else:
                # Cut the longest piece, at the gap or where its loss would be too much.
                before = n - loss
                room = np.where(alive, np.minimum(np.minimum(n, left[0]), before + left[2]), 0)
                i = int((room * (1 << 20) + n).argmax())
                if room[i] <= 0:
                    break
                piece = self.cut(i, int(room[i]), n, loss)
            chosen.append(piece)
            size = len(piece[2])
            left -= (size, 1, size - piece[4])
            self.tokens -= size
        length = self.limits.tokens - int(left[0])
        if length == self.limits.tokens:
            return chosen
        # Not full: what goes beyond a power of two waits on.
        spare = length - (1 << (length.bit_length() - 1))
        back = []
        while spare:
            doc_id, start, ids, whole, before = chosen.pop()
            keep = max(len(ids) - spare, 0)
            if keep:
                chosen.append((doc_id, start, ids[:keep], whole, min(before, keep)))
            back.append((doc_id, start + keep, ids[keep:], whole, max(before - keep, 0)))
            spare -= len(ids) - keep
        for piece in back:
            self.tokens += len(piece[2])
            i = int(np.flatnonzero(~alive)[0])
            self.pieces[i], alive[i] = piece, True
            n[i], loss[i] = len(piece[2]), len(piece[2]) - piece[4]
        return chosen

    def close(self, chosen: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, whole, before in chosen:
            yield doc_id, start, len(ids), ids.tobytes(), whole, len(ids) - before, self.number, offset
            offset += len(ids)
        self.number += 1


def batches_of(rows: Iterator[tuple], size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch_of(held)
            held = []
    if held:
        yield batch_of(held)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=OUT)


def pack(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    limits: Limits = Limits(),
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences.

    ``ranks`` is a rank file of a byte-level vocabulary that executors can open and
    ``pattern`` its split pattern. Tokens of the column ``prompt`` come first and bear no
    loss. ``added`` has the ids of names that aren't encoded as text. Columns: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian unsigned
    32-bit numbers), ``doc_tokens``, ``loss_tokens``, ``sequence_id``, ``offset``.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(prompt), F.lit("")).alias("prompt") if prompt else F.lit("").alias("prompt"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks, pattern, added)
        packer = Packer(limits, TaskContext.get().partitionId() * PER_PARTITION)
        end = np.array([END], dtype="<u4").tobytes()

        def out() -> Iterator[tuple]:
            for batch in batches:
                for ident, body, head in zip(*map(each, batch.columns), strict=True):
                    before = encode(head) if head else b""
                    ids = np.frombuffer(before + encode(body) + end, dtype="<u4")
                    packer.add(ident, ids, len(before) // 4)
                    yield from packer.ready()
            yield from packer.ready(end=True)

        yield from batches_of(out())

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, `offset` long"
    return rows.mapInArrow(run, schema)
