"""Secrets: base patterns, and a character convolutional network over every candidate.

A candidate is a run of 16 or more token characters with a letter, and with a digit or of letters alone, that no base
span touches and that is no part of a mail address. The network sees windows over the whole
candidate with the characters around it, and the highest score counts. It is trained
on all labelled findings of all documents. Of the corpus, base spans are secrets, and again with other words
around them, so that it doesn't learn the keyword alone; mail addresses, plain words, numbers, and runs whose form says what they are
(paths, versions, dates, UUIDs, article numbers) are others. As a corpus may lack a form, ``drill`` adds findings of
all forms by rule. Training begins on a few findings and the drill; then every shard of the findings goes on from there, and the networks of
the shards are averaged. Scores are calibrated on all findings that
were held out, a fifth by hash, and the threshold of each kind of candidate keeps the demanded recall there
and, within that, lies as far from the others as it can. Base spans always stay.

Defined cases: a null or empty text has no spans; whole texts are searched, in time linear
in their length; repeated rows are searched each; without any finding in the corpus the network learns from the drill
alone; a score equal to the threshold is a secret; extra columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import SLICE, each, written
from titlelake.llm.learn import Adam, logistic, sigmoid
from titlelake.llm.spans import Span, overlaps, sha256, spelled

KINDS = ("assign", "access", "hex", "net")
NET = 3
#: Findings of either label that training begins with, before it goes on over all of them.
FIT_FINDINGS = 2_000
#: Windows that a shard trains on, those of a step beside ``STEP_DRILL`` of the drill, and the rate of the steps.
SHARD_WINDOWS, STEP_WINDOWS, STEP_DRILL, STEP_RATE = 50_000, 120, 8, 0.0003
#: Findings that a task remembers, so that it passes on few of its repeats.
REMEMBERED = 100_000
#: One of so many findings, by hash, is held out.
HELD = 5
#: Cells of a score that held-out findings are counted in, and the highest score that is told apart.
CELLS, HIGHEST = 1_000, 30
RECALL = 0.95
#: Windows of one finding, evenly spread over it, that training begins with.
FIT_WINDOWS = 16
SEED = 5

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")
# A run of token characters, or the text's end; short runs are passed over in one go.
SIGNS = "A-Za-z0-9+/_=.-"
CANDIDATE = re.compile(rf"(?:[^{SIGNS}]*+[{SIGNS}]{{1,15}}+(?![{SIGNS}]))*+[^{SIGNS}]*+([{SIGNS}]{{16,}}|\Z)")
BEFORE_AT = re.compile(r"(?<![^\s@])[^\s@]++@")
MAIL = "[A-Za-z0-9._%+-]{1,40}@[A-Za-z0-9.-]{1,40}"
OTHER = "[A-Za-z]{9,}|[0-9][0-9 ().-]{8,20}[0-9]|[A-Za-z0-9+/_.=-]{16,}"


def passing(found: str) -> re.Pattern[str]:
    """The matches of a pattern of others, as the first group, and the text's end; short words, in which none can begin, are passed over in one go."""
    return re.compile(rf"(?:[A-Za-z]{{1,8}}+\.?(?![%@{SIGNS}])[^%{SIGNS}]*+|(?!{found})[\s\S])*+({found}|\Z)")


OTHERS, OTHERS_NO_MAIL = passing(f"{MAIL}|{OTHER}"), passing(OTHER)
MIXED = re.compile("(?=[^0-9]*[0-9])[^A-Za-z]*[A-Za-z]")
# What a run is by its form: a path or dotted name of short parts, a version, a date, a UUID, an article number, words joined by signs.
PART = "[A-Za-z]{0,14}[0-9]{0,4}|[0-9]{1,4}[a-z]{0,3}"
FORMED = re.compile(
    rf"/{{0,3}}(?:{PART})(?:[/._-](?:{PART}))+/?|[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9.+-]*|(?:[A-Z]{1,6}-?)?[0-9]{4,10}(?:-[A-Z0-9]{1,8})+|[a-z]+(?:[A-Z][a-z]+)+[0-9]{0,3}"
)

#: Characters of a window of a candidate, and around the candidate; windows begin STEP apart.
INSIDE, AROUND, STEP = 40, 20, 20
CODES, EMBED, WIDE, FILTERS, DENSE = 68, 8, 5, 24, 24


def character_code(c: str) -> int:
    """0 is padding; letters, digits and some signs have a code each, all other characters the last."""
    known = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0 :=/_"
    if "0" <= c <= "9":
        return 1 + known.index("0")
    signs = "\"'+.-@\n"
    return 1 + known.index(c) if c in known else 1 + len(known) + signs.index(c) if c in signs else CODES - 1


CODE = np.array([character_code(chr(i)) for i in range(128)], dtype=np.int64)


def codes(text: str) -> list[int]:
    return [int(CODE[ord(c)]) if c < "\x80" else CODES - 1 for c in text]


def windows(text: str, start: int, end: int) -> Iterator[tuple[list[int], list[int]]]:
    """Codes of overlapping windows over the whole candidate, each with what stands around
    the candidate, padded."""
    before, after = codes(text[max(0, start - AROUND) : start]), codes(text[end : end + AROUND])
    around = [0] * (AROUND - len(before)) + before + after + [0] * (AROUND - len(after))
    last = max(start, end - INSIDE)
    for at in [*range(start, last, STEP), last]:
        inside = codes(text[at : at + INSIDE])
        yield inside + [0] * (INSIDE - len(inside)), around


def group(value: str) -> int:
    """The kind of a candidate: hexadecimal, letters and digits, or with signs."""
    return 0 if re.fullmatch("[0-9a-fA-F]+", value) else 1 if value.isalnum() else 2


def token_runs(text: str | None) -> list[tuple[int, int]]:
    """Runs of 16 or more token characters."""
    return [m.span(1) for m in CANDIDATE.finditer(text or "") if m[1]]


def base_spans(text: str | None, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """The base spans; ``runs`` are the text's token runs, if known. Each hexadecimal one lies in one of them."""
    if not text:
        return []
    spans: list[Span] = []
    low = text.lower() if (":" in text or "=" in text) else ""
    if any(k in low for k in KEYWORDS):
        spans += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    # A run goes on to its end, so asking for the length in the pattern drops the same runs.
    if "AKIA" in text:
        spans += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    return spans + [(*m.span(), 2) for run in (token_runs(text) if runs is None else runs) for m in HEX.finditer(text, *run)]


def user_ends(text: str) -> set[int]:
    """Where an ``@`` ends the user and password of a URL."""
    if "://" not in text:
        return set()
    ends = set()
    for m in BEFORE_AT.finditer(text):
        _, scheme, user = m.group().rpartition("://")
        if scheme and "?" not in user and "#" not in user:
            ends.add(m.end() - 1)
    return ends


def candidates(text: str | None, base: list[Span], runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Token runs with a letter, and with a digit or of letters alone, that no base span touches."""
    found = []
    taken, at = sorted(base), 0
    users = user_ends(text or "")
    for start, end in token_runs(text) if runs is None else runs:
        value = text[start:end]
        if not (value.isalpha() or any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            continue
        if any(text[k : k + 1] == "@" and k not in users for k in (start - 1, end) if k >= 0):
            continue  # a part of a mail address
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if not overlaps((start, end), taken[at : at + 8]):
            found.append((start, end))
    return found


class Room:
    """Arrays by name, used again and again: asking the system for their memory at each step took longer than the step."""

    def __init__(self):
        self.arrays: dict[tuple, np.ndarray] = {}

    def __call__(self, name: str | tuple, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        """An array of any content; it is valid until the name is asked for again."""
        size = int(np.prod(shape))
        if (name, dtype) not in self.arrays or self.arrays[name, dtype].size < size:
            self.arrays[name, dtype] = np.empty(size, dtype)
        return self.arrays[name, dtype][:size].reshape(shape)


@dataclass
class Network:
    """Embedding, convolution, maximum and mean over the candidate and over its context, two
    dense layers; then calibration (scale, shift) and a threshold for each kind."""

    arrays: list[np.ndarray]
    scale: np.ndarray
    thresholds: list[float]
    room: Room = field(default_factory=Room, repr=False, compare=False)

    @classmethod
    def new(cls) -> Network:
        r = np.random.default_rng(SEED)
        shapes = [(CODES, EMBED), (WIDE * EMBED, FILTERS), (FILTERS,), (WIDE * EMBED, FILTERS), (FILTERS,), (4 * FILTERS, DENSE), (DENSE,), (DENSE,), (1,)]
        arrays = [r.normal(0, (2 / s[0]) ** 0.5 if len(s) > 1 else 0.1, s) for s in shapes]
        arrays[0] = r.normal(0, 0.5, shapes[0])
        return cls(arrays, np.array([0.0, 1.0]), [0.5] * 3)

    def forward(self, inside: np.ndarray, around: np.ndarray):
        """Scores before calibration, and what the backward pass needs, valid until the next call."""
        e, k1, b1, k2, b2, w, b, v, c = self.arrays
        held = []
        pooled = []
        for i, (x, kernel, bias) in enumerate(((inside, k1, b1), (around, k2, b2))):
            n, length = x.shape
            places = length - WIDE + 1
            # The WIDE characters from a place lie side by side, so a patch is one stretch.
            line = e.take(x, axis=0).reshape(n, length * EMBED)
            patches = self.room((i, "patches"), (n, places, WIDE * EMBED), e.dtype)
            patches[...] = np.lib.stride_tricks.sliding_window_view(line, WIDE * EMBED, axis=1)[:, ::EMBED]
            patches = patches.reshape(-1, WIDE * EMBED)
            out = np.matmul(patches, kernel, out=self.room("out", (n * places, FILTERS), e.dtype))
            out += bias
            np.maximum(out, 0, out=out)
            # With places first, what runs over places takes one of them of all windows at a time.
            made = self.room((i, "made"), (places, n, FILTERS), e.dtype)
            made[...] = out.reshape(n, places, FILTERS).transpose(1, 0, 2)
            top = made.max(axis=0)
            held.append((x, patches, made, top))
            pooled += [top, made.mean(axis=0)]
        h = np.concatenate(pooled, axis=1)
        z = h @ w + b
        a = np.maximum(z, 0)
        return a @ v + c[0], (held, h, z, a)

    def slopes(self, inside: np.ndarray, around: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> list[np.ndarray]:
        e, k1, b1, k2, b2, w, b, v, c = self.arrays
        score, (held, h, z, a) = self.forward(inside, around)
        d = ((sigmoid(score) - y) * (1 / len(y) if weight is None else weight)).astype(score.dtype)
        out = [np.zeros_like(x) for x in self.arrays]
        out[7], out[8] = a.T @ d, np.array([d.sum()])
        dz = np.outer(d, v) * (z > 0)
        out[5], out[6] = h.T @ dz, dz.sum(axis=0)
        dh = dz @ w.T
        for i, (x, patches, made, most) in enumerate(held):
            top, mean = (dh[:, k * FILTERS : (k + 1) * FILTERS] for k in (2 * i, 2 * i + 1))
            (n, length), places = x.shape, len(made)
            active = np.greater(made, 0, out=self.room("active", made.shape, np.dtype(bool)))
            g = np.multiply(active, mean / places, out=self.room("g", made.shape, made.dtype))
            # The maximum's slope goes to the first place that reaches it.
            reached = np.equal(made, most, out=active)
            reached &= most > 0
            hits = np.flatnonzero(reached)
            first = np.full(most.size, made.size)
            np.minimum.at(first, hits % most.size, hits)
            hit = np.flatnonzero(first < made.size)
            g.reshape(-1)[first[hit]] += top.ravel()[hit]
            flat = self.room("out", (n * places, FILTERS), g.dtype)
            flat.reshape(n, places, FILTERS)[...] = g.transpose(1, 0, 2)
            out[1 + 2 * i] = patches.T @ flat
            out[2 + 2 * i] = flat.sum(axis=0)
            back = np.matmul(flat, (k1, k2)[i].T, out=self.room("back", (n * places, WIDE * EMBED), g.dtype))
            per_place = self.room("per place", (n, length * EMBED), g.dtype)
            per_place.fill(0)
            part = self.room("part", (n * places, EMBED), g.dtype)
            for k in range(WIDE):
                part[...] = back[:, k * EMBED : (k + 1) * EMBED]
                per_place[:, k * EMBED : (k + places) * EMBED] += part.reshape(n, -1)
            per_place = np.ascontiguousarray(per_place.reshape(-1, EMBED).T)
            code = x.ravel().astype(np.intp)
            for j in range(EMBED):
                out[0][:, j] += np.bincount(code, weights=per_place[j], minlength=CODES)
        return out

    def probability(self, parts: list[tuple[list[int], list[int]]]) -> np.ndarray:
        inside, around = (np.array(x) for x in zip(*parts, strict=True))
        return sigmoid(self.scale[0] + self.scale[1] * self.forward(inside, around)[0])

    def best(self, text: str, places: list[tuple[int, int]]) -> np.ndarray:
        """The highest probability of each candidate's windows, 512 windows at a time."""
        p = np.zeros(len(places))
        every = ((i, w) for i, (a, b) in enumerate(places) for w in windows(text, a, b))
        while part := list(islice(every, 512)):
            np.maximum.at(p, [i for i, _ in part], self.probability([w for _, w in part]))
        return p


def spread(own: list) -> list:
    """At most ``FIT_WINDOWS`` windows, evenly spread."""
    if len(own) <= FIT_WINDOWS:
        return own
    return [own[i * (len(own) - 1) // (FIT_WINDOWS - 1)] for i in range(FIT_WINDOWS)]


def examples(secrets: list[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> tuple[list, list[int], list[float], list[int]]:
    """Windows and the finding of each; labels and kinds of the findings. Each secret also
    comes with the context of another finding."""
    r = np.random.default_rng(SEED)
    parts, of, y, kinds = [], [], [], []

    def add(own: list, label: float, kind: int) -> None:
        parts.extend(own)
        of.extend([len(y)] * len(own))
        y.append(label)
        kinds.append(kind)

    for text, a, b in secrets:
        own, kind = spread(list(windows(text, a, b))), group(text[a:b])
        add(own, 1.0, kind)
        if others:
            text2, a2, b2 = others[int(r.integers(len(others)))]
            around = next(windows(text2, a2, b2))[1]
            add([(inside, around) for inside, _ in own], 1.0, kind)
    for text, a, b in others:
        add(spread(list(windows(text, a, b))), 0.0, group(text[a:b]))
    return parts, of, y, kinds


LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Words of the drill, and what stands before its findings.
WORDS = (
    "report summary archive index image release version linux windows build final draft update backup config server client "
    "module package table chapter section project customer invoice product blue large photo video music letter contract "
    "annual monthly year north south garden window market winter summer station bridge river mountain library museum"
).split()
SYLLABLES = (
    "schaft fahrt dampf stein ville tion ment ness kraft haupt grund stadt berg burg land wirt ship graph logy scope tele "
    "inter trans super counter under over ation ically ement ability zuschuss versicherung gesell straf recht schul ungs keits"
).split()
LEADS = ["", "see ", "at ", "Bearer ", "key: ", "use ", "url=", "file ", "(", "id ", '"', "from https://host.example", "the ", "header x-auth: "]


def drill(n: int = 1_200, seed: int = 29) -> Iterator[tuple[str, int, int, bool]]:
    """``n`` secrets and ``n`` others of many forms by a seeded rule: text, start, end, whether it is a secret."""
    r = np.random.default_rng(seed)

    def chars(alphabet: str, low: int, high: int) -> str:
        return "".join(r.choice(list(alphabet), int(r.integers(low, high))))

    def word() -> str:
        made = "".join(chars("bcdfglmnprstvw", 1, 2) + chars("aeiou", 1, 2) for _ in range(int(r.integers(2, 5))))
        return str(r.choice(WORDS)) if r.random() < 0.7 else made

    def compound() -> str:
        parts = [str(r.choice(SYLLABLES)) if r.random() < 0.7 else chars(LETTERS, 1, 3) + chars("aeiou", 1, 2) for _ in range(int(r.integers(3, 7)))]
        return "".join(parts).title() if r.random() < 0.4 else "".join(parts)

    def joined(sign: str, low: int, high: int) -> str:
        return sign.join(word() if r.random() < 0.8 else chars("0123456789", 1, 5) for _ in range(int(r.integers(low, high))))

    both, digits = LETTERS + LETTERS.upper(), "0123456789"
    secrets = [
        lambda: chars(both + digits, 16, 44), lambda: chars(both + digits + "+/", 20, 60) + "=" * int(r.integers(0, 3)),
        lambda: chars(both + digits + "-_", 20, 50), lambda: chars("0123456789ABCDEF", 18, 64), lambda: chars(both, 18, 40),
        lambda: f"{chars(LETTERS, 2, 5)}_{chars(both + digits, 24, 40)}", lambda: f"sk-{chars(LETTERS, 3, 6)}-{chars(both + digits, 20, 40)}",
        lambda: f"eyJ{chars(both + digits, 18, 34)}.eyJ{chars(both + digits, 24, 60)}.{chars(both + digits + '-_', 30, 44)}",
        lambda: f"/{word()}/{word()}/{chars(both + digits, 20, 40)}", lambda: f"{word()}?{word()}={chars(both + digits, 20, 36)}".replace("?", "/"),
        lambda: chars(LETTERS + digits, 20, 40), lambda: chars(LETTERS.upper() + digits, 16, 32),
    ]
    others = [
        lambda: joined("/", 3, 7) + "." + chars(LETTERS, 2, 5), lambda: "/" + joined("/", 3, 7), lambda: joined("-", 3, 7), lambda: joined("_", 3, 7), lambda: joined(".", 3, 6),
        lambda: f"{word()}-{r.integers(0, 20)}.{r.integers(0, 50)}.{r.integers(0, 99)}-{word()}-{r.choice(['x86_64', 'amd64', 'rc1', 'beta2'])}.{r.choice(['tar.gz', 'zip', 'deb'])}",
        lambda: f"//{word()}.example.com/{r.integers(1990, 2030)}/{r.integers(1, 13):02d}/{r.integers(1, 29):02d}/{joined('-', 3, 6)}",
        lambda: f"{r.integers(1990, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}T{r.integers(0, 24):02d}.{r.integers(0, 60):02d}.{r.integers(0, 60):02d}Z",
        lambda: f"{chars(LETTERS.upper(), 2, 5)}-{r.integers(2000, 2030)}-{r.integers(0, 10**8):08d}-{word().upper()}", lambda: f"{chars(LETTERS.upper(), 2, 4)}-{chars(digits, 5, 10)}-{chars(LETTERS.upper(), 1, 3)}{chars(digits, 1, 4)}",
        lambda: "-".join(chars("0123456789abcdef", k, k + 1) for k in (8, 4, 4, 4, 12)), lambda: "".join(word() for _ in range(int(r.integers(3, 6)))),
        lambda: word() + "".join(word().title() for _ in range(int(r.integers(2, 5)))) + chars(digits, 0, 4), lambda: f"{joined('.', 2, 4)}.{word()}{r.integers(0, 99)}",
        lambda: "".join(word() for _ in range(3)) + chars(digits, 1, 5), compound, compound,
        lambda: f"{joined('.', 2, 5)}." + "".join(word().title() for _ in range(int(r.integers(1, 4)))), lambda: f"{compound()}-{compound()}", lambda: f"{joined('_', 2, 5)}_{r.integers(1, 10**6)}",
    ]
    for forms, secret in ((secrets, True), (others, False)):
        for i in range(n):
            value, lead = forms[i % len(forms)](), str(r.choice(LEADS))
            value += "x" * (16 - len(value))
            yield f"{lead}{value} {word()}", len(lead), len(lead) + len(value), secret


def train(secrets: list[tuple[str, int, int]], others: list[tuple[str, int, int]], rounds: int = 9) -> Network:
    """A network from labelled findings (text, start, end) and the drill, a fifth held out to calibrate."""
    drilled = list(drill())
    own_secrets = secrets + [d[:3] for d in drilled if d[3]]
    own_others = others + [d[:3] for d in drilled if not d[3]]
    parts, finding, labels, kinds = examples(own_secrets, own_others)
    inside, around = (np.array(x) for x in zip(*parts, strict=True))
    of, y, kind = np.array(finding), np.array(labels), np.array(kinds)
    r = np.random.default_rng(SEED)
    held = r.random(len(y)) < 0.2
    # Each secret is there twice; findings of the corpus are held out by hash, as in all that follows.
    held[: 2 * len(secrets)] = np.repeat([held_out(hashed(*f)) for f in secrets], 2)
    held[2 * len(own_secrets) : 2 * len(own_secrets) + len(others)] = [held_out(hashed(*f)) for f in others]
    net = Network.new()
    adam = Adam(net.arrays, 0.004)
    own = np.flatnonzero(~held[of])
    for step in range(rounds):
        adam.rate = 0.004 if step < rounds * 2 // 3 else 0.001
        r.shuffle(own)
        for k in range(0, len(own), 128):
            at = own[k : k + 128]
            adam.step(net.slopes(inside[at], around[at], y[of[at]]))
    # A finding's score is the highest of its windows, as in the search.
    highest_of = np.full(len(y), -np.inf)
    np.maximum.at(highest_of, of[held[of]], net.forward(inside[held[of]], around[held[of]])[0])
    score = highest_of[held]
    net.scale = logistic(np.stack([np.ones(len(score)), score], axis=1), y[held], rate=0.3, decay=1e-3)
    p = sigmoid(net.scale[0] + net.scale[1] * score)
    net.thresholds = [threshold(p[(y[held] == 1) & (kind[held] == g)], p[(y[held] == 0) & (kind[held] == g)]) for g in range(3)]
    # Without the room for all held out at once.
    return Network(net.arrays, net.scale, net.thresholds)


def hashed(text: str, start: int, end: int) -> int:
    """A finding's number, of 63 bits; the same as :func:`number`."""
    return xxhash.xxh64_intdigest(f"{start}:{end}:{text}".encode("utf-8", "surrogatepass"), 42) >> 1


def number() -> Column:
    """The number of a finding by its columns ``text``, ``start`` and ``end``."""
    return F.shiftrightunsigned(F.xxhash64(F.concat_ws(":", "start", "end", "text")), 1)


def held_out(number):
    """Whether the finding of a number (or column of numbers) is held out."""
    return number % HELD == 0


def share(values: np.ndarray, weights: np.ndarray, part: float) -> float:
    """The first value, in order, at which more than a part of the weight is reached."""
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(weights[order])
    return float(values[order][min(np.searchsorted(reached, part * reached[-1], "right"), len(values) - 1)])


def threshold(secrets: np.ndarray, others: np.ndarray, secret_weights: np.ndarray | None = None, other_weights: np.ndarray | None = None) -> float:
    """The threshold of a kind by the held-out probabilities of its secrets and others, each of weight 1 unless weights are given.

    The highest one that RECALL of the secrets reach; if nearly all others lie below it, halfway (as log odds) between the two,
    so that neither is close.
    """
    if not len(secrets):
        return float(others.max(initial=0.5))
    highest = float(np.sort(secrets)[int((1 - RECALL) * len(secrets))]) if secret_weights is None else share(secrets, secret_weights, 1 - RECALL)
    if not len(others):
        return min(highest, 0.5)
    below = float(np.quantile(others, 0.995)) if other_weights is None else share(others, other_weights, 0.995)
    if below >= highest:
        return highest
    low, high = (np.log(x / (1 - x)) for x in np.clip([below, highest], 1e-6, 1 - 1e-6))
    return float(1 / (1 + np.exp(-(low + high) / 2)))


def values(text: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """The secret values of base spans: for an assignment the part after the sign."""
    for a, b, kind in spans:
        if kind == 0 and (m := ASSIGN.match(text, a)):
            a = m.start(2)
        yield a, b


def labelled(text: str | None) -> Iterator[tuple[int, int, bool]]:
    """Findings of a text whose label is known: the values of base spans, and what is no secret by its form."""
    if not text:
        return
    base = base_spans(text)
    for a, b in values(text, base):
        yield a, b, True
    taken, at = sorted(base), 0
    for m in (OTHERS if "@" in text else OTHERS_NO_MAIL).finditer(text):
        if not (value := m[1]):
            continue
        # A mixed run that has no known form is a candidate of unknown label.
        if not value.isalpha() and MIXED.match(value) and "@" not in value and not FORMED.fullmatch(value):
            continue
        while at < len(taken) and taken[at][1] <= m.start(1):
            at += 1
        if not taken or not overlaps(m.span(1), taken[at : at + 8]):
            yield *m.span(1), False


class Findings:
    """Windows of many findings, as arrays: a window is a finding's number and a place in all texts together."""

    def __init__(self, texts: list[str], starts: list[int], ends: list[int]):
        whole = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.codes = np.append(CODE, CODES - 1).astype(np.uint8)[np.minimum(whole, 128)]
        self.stop = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.first = self.stop - [len(t) for t in texts]
        self.start, self.end = self.first + starts, self.first + ends
        last = np.maximum(self.start, self.end - INSIDE)
        self.windows = -(-(last - self.start) // STEP) + 1
        self.of = np.repeat(np.arange(len(texts)), self.windows)
        nth = np.arange(len(self.of)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        self.at = np.minimum(self.start[self.of] + nth * STEP, last[self.of])

    def _cut(self, at: np.ndarray, length: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """``length`` codes from each place, padding where they are outside ``low`` to ``high``."""
        places = at[:, None] + np.arange(length)
        known = (places >= low[:, None]) & (places < high[:, None])
        return np.where(known, self.codes[np.clip(places, 0, len(self.codes) - 1)], 0)

    def inside(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        return self._cut(at, INSIDE, self.first[of], self.stop[of])

    def around(self, of: np.ndarray) -> np.ndarray:
        before = self._cut(self.start[of] - AROUND, AROUND, self.first[of], self.start[of])
        return np.concatenate([before, self._cut(self.end[of], AROUND, self.end[of], self.stop[of])], axis=1)


    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """What is inside each window and around each finding, cut 4,096 at a time."""
        insides, arounds = np.empty((len(self.of), INSIDE), np.uint8), np.empty((len(self.start), 2 * AROUND), np.uint8)
        for k in range(0, len(insides), 4096):
            insides[k : k + 4096] = self.inside(self.at[k : k + 4096], self.of[k : k + 4096])
        for k in range(0, len(arounds), 4096):
            arounds[k : k + 4096] = self.around(np.arange(k, min(k + 4096, len(arounds))))
        return insides, arounds


def halves(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weights, scaled so that each label has a half of one."""
    out = np.zeros(len(y))
    for label in (0.0, 1.0):
        own = (y == label) & (weight > 0)
        if own.any():
            out[own] = weight[own] / weight[own].sum() / 2
    return out


def go_on(net: Network, found: Findings, secret: np.ndarray, drilled: tuple[Findings, np.ndarray]) -> Network:
    """A network after one pass over the windows of all findings given, with some of the drill in each step.

    Each secret also comes with the context of another finding. Corpus and drill have half the weight of a step each, and
    so have the labels in either; a finding's windows share its weight.
    """
    r = np.random.default_rng(SEED)
    # All arrays are parts of one, so that a step changes one.
    whole = np.concatenate([a.astype(np.float32).ravel() for a in net.arrays])
    parts = np.split(whole, np.cumsum([a.size for a in net.arrays])[:-1])
    net = Network([part.reshape(a.shape) for part, a in zip(parts, net.arrays, strict=True)], net.scale, net.thresholds)
    adam = Adam([whole], STEP_RATE)
    drill_found, drill_secret = drilled
    others = np.flatnonzero(~secret)
    # Windows by number; those of secrets again, with the context of another finding.
    again = np.flatnonzero(secret[found.of]) if len(others) else np.zeros(0, np.int64)
    window = np.concatenate([np.arange(len(found.of)), again])
    context = np.concatenate([found.of, others[r.integers(len(others), size=len(secret))][found.of[again]] if len(others) else again])
    order = r.permutation(len(window))
    drill_order = r.permutation(len(drill_found.of))
    (insides, arounds), (drill_insides, drill_arounds) = found.all(), drill_found.all()
    for step, k in enumerate(range(0, len(order), STEP_WINDOWS)):
        w, c = window[order[k : k + STEP_WINDOWS]], context[order[k : k + STEP_WINDOWS]]
        d = drill_order[np.arange(step * STEP_DRILL, (step + 1) * STEP_DRILL) % len(drill_order)]
        of, drill_of = found.of[w], drill_found.of[d]
        inside = np.concatenate([insides[w], drill_insides[d]])
        around = np.concatenate([arounds[c], drill_arounds[drill_of]])
        y, drill_y = secret[of].astype(float), drill_secret[drill_of].astype(float)
        weight = np.concatenate([halves(y, 1 / found.windows[of]), halves(drill_y, 1 / drill_found.windows[drill_of])]) / 2
        adam.step([np.concatenate([a.ravel() for a in net.slopes(inside, around, np.concatenate([y, drill_y]), weight)])])
    return net


def highest(net: Network, found: Findings) -> np.ndarray:
    """The highest score of each finding's windows before calibration, 512 windows at a time."""
    out = np.full(len(found.start), -np.inf)
    for k in range(0, len(found.of), 512):
        of = found.of[k : k + 512]
        np.maximum.at(out, of, net.forward(found.inside(found.at[k : k + 512], of), found.around(of))[0])
    return out


def drill_findings(seed: int) -> tuple[Findings, np.ndarray]:
    texts, starts, ends, secret = zip(*drill(seed=seed), strict=True)
    return Findings(list(texts), list(starts), list(ends)), np.array(secret)


def _findings(table: pa.Table | pa.RecordBatch) -> Findings:
    return Findings(*(table.column(c).to_pylist() for c in ("text", "start", "end")))


def learn(found: DataFrame, net: Network) -> Network:
    """A network that goes on from another over all distinct findings (text, start, end, secret) but those held out.

    Findings are divided in shards by hash. Each shard makes one pass, and the arrays of
    all shards are averaged by their windows, in whole numbers, so that the order of the sums doesn't count.
    """
    own = found.filter(~held_out(number()))
    # Distinct windows, nearly; the count is the same however the findings are dealt out.
    last = F.ceil(F.greatest(F.lit(0), F.col("end") - F.col("start") - INSIDE) / STEP)
    windows_ = own.select(number().alias("at"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("nth"))
    n = windows_.agg(F.approx_count_distinct(F.xxhash64("at", "nth"))).first()[0]
    if not n:
        return net
    shards = -(-n // SHARD_WINDOWS)
    shared = found.sparkSession.sparkContext.broadcast((net.arrays, net.scale, net.thresholds, drill_findings(31)))
    schema = pa.schema([("n", pa.int64()), ("arrays", pa.list_(pa.int64()))])

    def shard(table: pa.Table) -> pa.Table:
        *start, drilled = shared.value
        columns = ["text", "start", "end", "secret"]
        table = table.group_by(columns, use_threads=False).aggregate([]).sort_by([(c, "ascending") for c in columns])
        rows = _findings(table)
        after = go_on(Network(*start), rows, np.array(table.column("secret").to_pylist()), drilled)
        flat = np.concatenate([a.ravel() for a in after.arrays]).astype(np.float64)
        return pa.table([[len(rows.of)], [np.round(flat * 2.0**32).astype(np.int64)]], schema=schema)

    parts = own.withColumn("shard", (F.shiftright(number(), 8) % shards).cast("int")).groupBy("shard").applyInArrow(shard, "n long, arrays array<long>")
    places = parts.select("n", F.posexplode("arrays").alias("place", "value"))
    total = F.sum(F.col("n").cast("decimal(12,0)") * F.col("value").cast("decimal(18,0)"))
    sums = {r["place"]: float(r["total"]) / float(r["n"]) / 2.0**32 for r in places.groupBy("place").agg(total.alias("total"), F.sum("n").alias("n")).collect()}
    flat, arrays = np.array([sums[i] for i in range(len(sums))]), []
    for a in net.arrays:
        arrays.append(flat[: a.size].reshape(a.shape))
        flat = flat[a.size :]
    return Network(arrays, net.scale, net.thresholds)


def calibrated(found: DataFrame, net: Network) -> Network:
    """The network with scale and thresholds by all findings that were held out, and a drill of their own.

    Scores are counted in cells, so only these counts travel. Corpus and drill have the same weight, whatever their number.
    """
    # Scored as in the search, with half the bytes.
    net = Network([a.astype(np.float32) for a in net.arrays], net.scale, net.thresholds)
    shared = found.sparkSession.sparkContext.broadcast((net.arrays, net.scale, net.thresholds))
    names = ("kind", "secret", "cell", "n")

    def cells(rows: Findings, kinds: list[int], secret: list[bool], own: Network) -> Counter:
        cell = np.round(np.clip(highest(own, rows), -HIGHEST, HIGHEST) * CELLS).astype(int)
        return Counter(zip(kinds, map(bool, secret), cell.tolist(), strict=True))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Network(*shared.value), Counter()
        for batch in batches:
            for k in range(0, len(batch), 2048):
                part = batch.slice(k, 2048)
                kinds = [group(t[a:b]) for t, a, b in zip(*(part.column(c).to_pylist() for c in ("text", "start", "end")), strict=True)]
                counts += cells(_findings(part), kinds, part.column("secret").to_pylist(), own)
        columns = zip(*((*key, n) for key, n in sorted(counts.items())), strict=True) if counts else [[]] * 4
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    held = found.filter(held_out(number())).distinct().mapInArrow(counted, "kind long, secret boolean, cell long, n long")
    corpus = [tuple(r) for r in held.groupBy(*names[:3]).agg(F.sum("n").alias("n")).orderBy(*names[:3]).collect()]
    texts, starts, ends, secret = zip(*drill(seed=37), strict=True)
    kinds = [group(t[a:b]) for t, a, b in zip(texts, starts, ends, strict=True)]
    drilled = [(*key, n) for key, n in sorted(cells(Findings(list(texts), list(starts), list(ends)), kinds, list(secret), net).items())]
    sources = [np.array(rows, dtype=float).reshape(-1, 4) for rows in (corpus, drilled)]

    rows = np.concatenate(sources)
    score, y = rows[:, 2] / CELLS, rows[:, 1]
    weight = np.concatenate([halves(own[:, 1], own[:, 3]) for own in sources])
    scale = logistic(np.stack([np.ones(len(score)), score], axis=1), y, rate=0.3, decay=1e-3, weight=weight / weight.sum())
    p = sigmoid(scale[0] + scale[1] * score)
    kind, thresholds = rows[:, 0], []
    for g in range(3):
        # Within a kind, corpus and drill count alike for either label.
        own = np.concatenate([halves(of[:, 1], of[:, 3] * (of[:, 0] == g)) for of in sources])
        secrets, others = ((kind == g) & (y == label) for label in (1, 0))
        thresholds.append(threshold(p[secrets], p[others], own[secrets], own[others]))
    return Network(net.arrays, scale, thresholds)


def fit(docs: DataFrame, text: str = "text") -> Network | None:
    """A network from all distinct findings of all documents, and the drill. Only the findings' surroundings travel.

    Training begins in the driver with the ``FIT_FINDINGS`` of either label that come first by hash; then it goes on over all
    findings in shards, and scale and thresholds come from all findings held out.
    """
    schema = pa.schema([("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.bool_())])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            column = batch.column(0)
            for k in range(0, len(column), SLICE):
                rows = []
                for t in column.slice(k, SLICE).to_pylist():
                    for a, b, secret in labelled(t):
                        low = max(0, a - AROUND)
                        row = (t[low : b + AROUND], a - low, b - low, secret)
                        if row not in seen:
                            seen.add(row)
                            rows.append(row)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = docs.select(F.col(f"`{text}`")).mapInArrow(every, "text string, start long, end long, secret boolean")
    # Stored, as it is read for each label and each step. Few repeats are left; each step drops those.
    found = written(found, "findings")

    def first(secret: bool) -> list[tuple[str, int, int]]:
        own = found.filter(F.col("secret") == secret).withColumn("at", number())
        last = own.select("at").distinct().orderBy("at").limit(FIT_FINDINGS).agg(F.max("at")).first()[0]
        rows = own.filter(F.col("at") <= F.lit(last)).distinct().orderBy("at", "text", "start", "end").limit(FIT_FINDINGS)
        return [(r["text"], r["start"], r["end"]) for r in rows.collect()]

    net = train(first(True), first(False))
    # As in ``find``, there may be no network.
    return calibrated(found, learn(found, net)) if net else None


def find(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The rows as ``row`` (a struct of all columns), with the base spans' counts and
    digest, and all ``spans``."""
    shared = docs.sparkSession.sparkContext.broadcast((net.arrays, net.scale, net.thresholds) if net else None)
    counts = [f"n_{k}" for k in KINDS[:NET]]
    kind = pa.struct([*[(c, pa.int64()) for c in counts], ("base_sha256", pa.string()), ("spans", pa.string())])

    @F.arrow_udf(f"struct<{', '.join(f'{c}: long' for c in counts)}, base_sha256: string, spans: string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Network(*shared.value) if shared.value else None
        for batch in batches:
            out = []
            for t in each(batch):
                runs = token_runs(t)
                base = base_spans(t, runs)
                more: list[Span] = []
                places = candidates(t, base, runs) if own else []
                if places:
                    more += [(a, b, NET) for (a, b), x in zip(places, own.best(t, places), strict=True) if x >= own.thresholds[group(t[a:b])]]
                row = {c: sum(k == i for *_, k in base) for i, c in enumerate(counts)}
                out.append(row | {"base_sha256": sha256(spelled(base, KINDS)), "spans": spelled(base + more, KINDS)})
            yield pa.array(out, kind)

    rows = docs.select(F.struct("*").alias("row"), found.asNondeterministic()(F.col(f"`{text}`")).alias("found"))
    return rows.select("row", *[f"found.{c}" for c in counts], "found.base_sha256", "found.spans")
