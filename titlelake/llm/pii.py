"""Personal data by weak supervision.

Candidates are the base patterns' spans and looser ones of three forms: number groups, spelled-out mail
addresses, names after a first name. Labelers (shapes, a gazetteer, context words, what adjoins) vote
for, against or not at all. Spark counts the vote patterns over all candidates of the
corpus. Expectation-maximisation on these counts estimates each labeler's accuracy, the chance that a vote it
casts is right, and how many candidates of each form are personal data. Not voting says nothing about the
truth. Base spans are anchors: they are known to be true, and by them the labelers of the context are measured as well.

A logistic span classifier is trained on the probabilities of distinct loose candidates, from features of the span, its
context and the votes, and decides on the loose candidates. As a corpus may lack a form altogether, ``drill`` adds spans
of every form in every kind of context; they get their labels from the same estimate and take no part in it. Base spans always stay.

Defined cases: a null or empty text has no spans; whole texts are searched, in time linear
in their length; repeated rows are searched each; without candidates the labelers keep the accuracies they are
assumed to have at first; a score of exactly 0 adds no span; extra columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import each, hash_share, written
from titlelake.llm.learn import logistic
from titlelake.llm.spans import Span, masked, overlaps, sha256, spelled

#: Distinct candidates, taken by hash, that the classifier is fitted on.
FIT_ON = 20_000
KINDS = ("email", "ip", "card", "phone", "weak")
WEAK = 4
CONTEXT = 32
HASHED = 64

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No digit stands before: a run of digits is tried once, from its start.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBERS = re.compile(r"\(?[0-9][0-9(). /-]{5,24}[0-9]")
SPELLED_AT = re.compile(r"[A-Za-z0-9._-]{1,40} ?[(\[]at[)\]] ?[A-Za-z0-9.-]{1,60}(?: ?[(\[]dot[)\]] ?[A-Za-z]{2,10})?", re.I)

# Common first names, and words that speak for or against personal data.
FIRST_NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph "
    "Thomas Christopher Daniel Matthew Anthony Sarah Karen Nancy Peter Hans Anna Maria Jose Juan Carlos Pierre "
    "Jean Marie Sophie Claire Klaus Wolfgang Ursula Carmen Lucia Javier Ana Laura Paul Julia Emma Louis".split()
)
# Only the first name is consumed, so that each one followed by a capitalised word is tried.
FULL_NAME = re.compile(rf"\b(?:{'|'.join(sorted(FIRST_NAMES))})(?=( [A-Z][a-z]{{2,20}})\b)")
FOR = re.compile(
    r"\b(?:tel|telephone|phone|call|called|mobile|cell|fax|ssn|social|contact|reach|e-?mail|write|iban|name|named|mr|mrs|ms|dr|dear|"
    r"passport|patient|signed|regards|sincerely|whatsapp|text)\b", re.I)
AGAINST = re.compile(
    r"\b(?:version|pages?|isbn|issn|order|price|total|figure|table|section|chapter|doi|rfc|invoice|part|item|sku|model|serial|build|"
    r"ticket|published|dated|article|ref|reference|batch)\b|(?<![$€£#])[$€£#]\s?$", re.I)
UNIT = re.compile(r"\s?(?:%|usd|eur|dollars?|euros?|[€$£]|kg|km|mm|cm|mb|gb|pages?|items?|bytes?|years?)\b|\s?[%€$£]", re.I)
# Words that make a name of a place or an institution of a first name.
PLACES = frozenset(
    "Street Road Avenue Lane Square Park School College University Hospital County Bridge Church Island River "
    "Airport Day Award Prize Cup Hotel Station Foundation Museum Library Act Bay Beach Hall House".split()
)

SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}")
DECIMAL = re.compile(r"[0-9]+(?:[. ][0-9]{3})*(?:\.[0-9]+)?")
#: Votes on a candidate, in the order of :func:`votes`; what an accuracy is taken for at first, and as how many votes that counts.
LABELERS, ACCURACY, AS_VOTES = 9, 0.85, 20.0
CONTEXT_VOTE = 4
#: Forms of candidates (grouped like a telephone or security number, other numbers, mail addresses, names) with the share that is
#: taken for true at first, counted as AS_VOTES candidates; base spans are all true.
SHARES = {"g": 0.55, "n": 0.1, "m": 0.8, "f": 0.75}
BASE = "b"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each ``@`` outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        # Where a try fails, the next address can't begin before this sign.
        last = found.end() if found else at + 1
        if found:
            yield start, last, 0
        at = text.find("@", last)


def base_spans(text: str | None) -> list[Span]:
    if not text:
        return []
    spans = list(emails(text))
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            spans.append((*m.span(), 1))
    for m in DIGITS.finditer(text):
        if 14 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            spans.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(only_digits(m.group())) <= 15:
                spans.append((*m.span(), 3))
    return spans


def candidates(text: str | None) -> Iterator[tuple[Span, bool]]:
    """Spans with whether they are base; looser ones don't touch base ones."""
    if not text:
        return
    base = base_spans(text)
    for span in base:
        yield span, True
    loose = [(*m.span(), WEAK) for m in NUMBERS.finditer(text)]
    if "at)" in (low := text.lower()) or "at]" in low:
        loose += [(*m.span(), WEAK) for m in SPELLED_AT.finditer(text)]
    loose += [(m.start(), m.end(1), WEAK) for m in FULL_NAME.finditer(text)]
    taken = sorted(base)
    at = 0
    for span in sorted(loose):
        while at < len(taken) and taken[at][1] <= span[0]:
            at += 1
        if not overlaps(span[:2], taken[at : at + 4]):
            yield span, False


def form(found: str) -> str:
    """The form of a loose candidate, see SHARES."""
    if SPELLED_AT.fullmatch(found):
        return "m"
    if found[0] not in "(0123456789":
        return "f"
    return "g" if SSN.fullmatch(found) or LOCAL_PHONE.fullmatch(found) else "n"


def context(before: str) -> str:
    """The vote of the nearest context word."""
    last = {vote: max((m.end() for m in pattern.finditer(before)), default=-1) for vote, pattern in (("+", FOR), ("-", AGAINST))}
    return "0" if last["+"] == last["-"] else max(last, key=last.get)


def votes(text: str, span: Span) -> str:
    """The form, then one character for each labeler: ``+`` for, ``-`` against, ``0`` no vote.

    What all candidates of a form have in common, as the shape of a telephone number, is in the form's share and no vote.
    """
    a, b, kind = span
    found, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT // 2]
    if kind != WEAK:
        return BASE + "0" * CONTEXT_VOTE + context(before) + "0" * (LABELERS - CONTEXT_VOTE - 1)
    own = form(found)
    digits = only_digits(found)
    number = own in "gn"
    ssn = SSN.fullmatch(found)
    joined = (before[-1:].isalnum() or before[-1:] in set("_-/+=") or after[:1].isalnum() or after[:1] in set("_/+=")) if before or after else False
    steps = {ord(y) - ord(x) for x, y in zip(digits, digits[1:], strict=False)}
    return own + "".join([
        "-" if ssn and (digits[:3] in ("000", "666") or digits[0] == "9") else "0",
        "+" if own == "m" and re.search(r"[(\[]dot[)\]]", found, re.I) else "0",
        "-" if own == "f" and found.split(" ")[-1] in PLACES else "0",
        "-" if number and (DATE.fullmatch(found) or own == "n" and DECIMAL.fullmatch(found)) else "0",
        context(before),
        "-" if number and not 9 <= len(digits) <= 15 else "0",
        "-" if number and UNIT.match(after) else "0",
        "-" if number and len(steps) == 1 and steps <= {0, 1, -1} else "0",
        "-" if joined else "0",
    ])


#: Numbers that describe a span, before the votes (for and against by labeler) and the hashed words around.
SHAPE = 15
FEATURES = SHAPE + 2 * LABELERS + HASHED


def features(text: str, span: Span) -> list[float]:
    a, b, _ = span
    found, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT // 2]
    n = max(len(found), 1)
    digits = only_digits(found)
    voted = votes(text, span)
    own = [
        1.0, min(n, 40) / 40, len(digits) / n, sum(c.isalpha() for c in found) / n, sum(c in " -.()" for c in found) / n,
        float("(" in found), found.count(".") / 4, found.count("-") / 4, float(luhn(digits)) if len(digits) >= 12 else 0.0,
        float(len(digits) in range(10, 16)), float(9 <= len(digits)), *(float(voted[0] == f) for f in SHARES),
    ]
    cast = [float(v == sign) for sign in "+-" for v in voted[1:]]
    hashed = [0.0] * HASHED
    for word in re.findall(r"\w+", f"{before} {after}".lower()):
        hashed[zlib.crc32(word.encode()) % HASHED] = 1.0
    return own + cast + hashed


@dataclass
class Reliability:
    """``accuracy[l]``: how often a vote of labeler l is right; ``share[f]``: how much of a form is personal data."""

    accuracy: np.ndarray
    share: dict[str, float]

    def probability(self, pattern: str) -> float:
        """That a candidate with such votes is personal data."""
        if pattern[0] == BASE:
            return 1.0
        odds = np.log(self.accuracy / (1 - self.accuracy))
        p = self.share[pattern[0]]
        score = np.log(p / (1 - p)) + sum(odds[i] * {"+": 1, "-": -1, "0": 0}[v] for i, v in enumerate(pattern[1:]))
        return float(1 / (1 + np.exp(-score)))


def reliabilities(counts: dict[str, int], rounds: int = 100) -> Reliability:
    """Expectation-maximisation from how often each vote pattern occurs.

    What is assumed at first stays in as ``AS_VOTES`` votes or candidates, so that a labeler that hardly votes keeps it
    and no class dies out; an accuracy is at least a half, as a labeler's sign is known.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    sign = np.array([[{"+": 1, "-": -1, "0": 0}[v] for v in p[1:]] for p in patterns], dtype=float).reshape(-1, LABELERS)
    model = Reliability(np.full(LABELERS, ACCURACY), dict(SHARES))
    for _ in range(rounds):
        true = np.array([model.probability(p) for p in patterns])
        right = (n * true) @ (sign > 0) + (n * (1 - true)) @ (sign < 0)
        cast = n @ (sign != 0)
        accuracy = np.clip((ACCURACY * AS_VOTES + right) / (AS_VOTES + cast), 0.55, 0.98)
        share = {}
        for f, first in SHARES.items():
            own = np.array([p[0] == f for p in patterns], dtype=bool)
            share[f] = float(np.clip((first * AS_VOTES + (n * true)[own].sum()) / (AS_VOTES + n[own].sum()), 0.02, 0.98))
        model = Reliability(accuracy, share)
    return model


# What the drill puts together.
LAST_NAMES = "Johnson Smith Miller Weber Garcia Dubois Rossi Novak Larsen Walker".split()
LEADS = {
    "+": ["call me on ", "my phone is ", "tel: ", "Contact ", "Dear ", "mobile ", "SSN ", "e-mail ", "Mrs ", "fax no. ", "signed, ", "please write to "],
    "-": ["order ", "page ", "price $", "table ", "invoice ", "article ", "total: ", "version ", "part no. ", "see section "],
    "0": ["", "then ", "we saw ", "it was ", "and ", "about ", "the ", "with "],
}
TAILS = ["", " today", ".", ", thanks", " and so on", "%", " kg", " EUR", "x7", "-B"]


def drill(rounds: int = 6) -> Iterator[tuple[str, Span]]:
    """Spans of each form after each lead, with some tail, by a seeded rule."""
    r = np.random.default_rng(23)

    def number(*sizes: int) -> list[str]:
        return ["".join(map(str, r.integers(0, 10, k))) for k in sizes]

    forms = [
        lambda: "{}-{}-{}".format(*number(3, 2, 4)), lambda: "({}) {}-{}".format(*number(3, 3, 4)), lambda: "{}.{}.{}".format(*number(3, 3, 4)),
        lambda: "{}-{}-{}".format(*number(3, 3, 4)), lambda: f"{r.integers(1900, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}",
        lambda: f"{r.integers(1, 29)}/{r.integers(1, 13)}/{r.integers(1900, 2030)}", lambda: number(int(r.integers(7, 19)))[0], lambda: "{} {}".format(*number(4, 4)),
        lambda: f"{r.integers(1000, 99999)}.{r.integers(10, 99)}", lambda: "{}-{}-{}-{}".format(*number(3, 1, 4, 5)),
        lambda: f"{r.choice(LAST_NAMES).lower()} (at) mail (dot) org", lambda: f"{r.choice(LAST_NAMES).lower()}[at]example.com",
        lambda: f"{r.choice(sorted(FIRST_NAMES))} {r.choice(LAST_NAMES)}", lambda: f"{r.choice(sorted(FIRST_NAMES))} {r.choice(sorted(PLACES))}",
    ]
    for _ in range(rounds):
        for value in forms:
            for leads in LEADS.values():
                for lead in leads:
                    text = f"so {lead}{value()}{r.choice(TAILS)}"
                    yield from ((text, span) for span, sure in candidates(text) if not sure)


@dataclass
class SpanModel:
    reliability: Reliability | None
    weights: np.ndarray | None

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and those that the classifier adds."""
        base, more = [], []
        for span, sure in candidates(text):
            if sure:
                base.append(span)
            elif self.weights is not None and float(self.weights @ features(text, span)) > 0:
                more.append(span)
        return base, more


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Reliabilities from all candidates of the corpus, a classifier from ``FIT_ON`` loose ones and the drill.

    The sample is of distinct candidates, so that one repeated in many copies can't fill
    it. To the driver come the counts of the vote patterns, of which there are some hundred at most, and the sample.
    """
    schema = pa.schema([("votes", pa.string()), ("features", pa.list_(pa.float32()))])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ((votes(t, s), None if sure else features(t, s)) for t in each(batch.column(0)) for s, sure in candidates(t))
            while part := list(islice(found, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    voted = written(docs.select(F.col(f"`{text}`")).mapInArrow(vote, "votes string, features array<float>"), "votes")
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = reliabilities(counts)
    key = F.xxhash64("features", "votes")
    loose = voted.filter("features is not null")
    different = loose.agg(F.approx_count_distinct(key)).first()[0]
    # Somewhat more than are taken, as the count is an estimate.
    near = loose.withColumn("key", key).filter(hash_share(F.col("key"), F.lit(1.5 * FIT_ON / max(different, 1)))).distinct()
    sample = [(r["features"], r["votes"]) for r in near.orderBy("key", "votes").limit(FIT_ON).collect()]
    return SpanModel(model, classifier(sample, model))


def classifier(sample: list[tuple[list[float], str]], model: Reliability) -> np.ndarray:
    """Weights fitted on sampled candidates (features, votes) and the drill, labelled by the model."""
    own = sample + [(features(t, s), votes(t, s)) for t, s in drill()]
    return logistic(np.array([x for x, _ in own]), np.array([model.probability(v) for _, v in own]))


def find(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """The rows as ``row`` (a struct of all columns), with the base spans' counts and
    digest, all ``spans``, and ``redacted``, the text with each span replaced by its kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    counts = [f"n_{k}" for k in KINDS[:WEAK]]
    kind = pa.struct([*[(c, pa.int64()) for c in counts], ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])

    @F.arrow_udf(f"struct<{', '.join(f'{c}: long' for c in counts)}, base_sha256: string, spans: string, redacted: string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = SpanModel(None, shared.value)
        for batch in batches:
            out = []
            for t in each(batch):
                base, more = own.spans(t)
                row = {c: sum(k == i for *_, k in base) for i, c in enumerate(counts)}
                row |= {"base_sha256": sha256(spelled(base, KINDS)), "spans": spelled(base + more, KINDS)}
                # Only changed texts travel back.
                row["redacted"] = masked(t, base + more, KINDS) if base or more else None
                out.append(row)
            yield pa.array(out, kind)

    rows = docs.select(F.struct("*").alias("row"), found.asNondeterministic()(F.col(f"`{text}`")).alias("found"))
    return rows.select("row", *[f"found.{c}" for c in counts], "found.base_sha256", "found.spans", F.coalesce("found.redacted", f"row.`{text}`").alias("redacted"))


def redacted(docs: DataFrame, model: SpanModel, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """All rows with personal data in the text replaced by its kind; lengths are kept true."""
    rows = find(docs, model, text)
    changed = ~F.col("redacted").eqNullSafe(F.col(f"row.`{text}`"))
    own = {
        text: F.col("redacted"),
        chars: F.when(changed, F.length("redacted").cast("long")).otherwise(F.col(f"row.`{chars}`"))
        if chars in docs.columns
        else None,
    }
    return rows.select(*[(own[c] if c in own else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
