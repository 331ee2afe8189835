"""Text expressions: null tokens, matching, ids, years, JSON text, URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a dump spells a missing value.
NULL_TOKENS = ["\\N", ""]

# Characters a URL component keeps as they are but `url_encode` escapes.
URL_KEEPS = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def clean(value: Column) -> Column:
    """Null for a missing-value token, else the text unchanged."""
    return F.when(~value.isin(NULL_TOKENS), value)


def scrub(value: Column) -> Column:
    """Tabs and newlines become spaces."""
    return F.translate(value, "\t\n", "  ")


def filled(value: Column) -> Column:
    """Null for empty text."""
    return F.nullif(value, F.lit(""))


def norm(value: Column) -> Column:
    return F.lower(F.trim(value))


def like(pattern: str) -> str:
    """A pattern in which a backslash before an ordinary character means that character."""
    return re.sub(r"\\(.)", lambda m: m.group() if m.group(1) in "%_\\" else m.group(1), pattern, flags=re.S)


def contains_ci(value: Column, query: str, literal: bool = False) -> Column:
    """Case-insensitive containment.

    ``%`` and ``_`` in the query act as wildcards unless ``literal`` is set; a backslash takes the
    next character as it is, at the end of the query the wildcard that is appended.
    """
    if literal:
        return F.contains(F.lower(value), F.lit(query.lower()))
    return value.ilike(like(f"%{query}%"))


def prefix_ci(value: Column, query: str, literal: bool = False) -> Column:
    """Case-insensitive prefix test, with the wildcard rule of :func:`contains_ci`."""
    if literal:
        return F.startswith(F.lower(value), F.lit(query.lower()))
    return value.ilike(like(f"{query}%"))


def is_local(identifier: Column, prefix: str) -> Column:
    """Ids of this catalogue start with ``tt`` (titles) or ``nm`` (people)."""
    return F.coalesce(identifier.startswith(prefix), F.lit(False))


def year_of(date_text: Column) -> Column:
    """Year from the first four characters of a date text, null if there is none."""
    return F.when(F.length(date_text) >= 4, F.substring(date_text, 1, 4).try_cast("int"))


def shorten(value: Column, length: int = 160) -> Column:
    return F.substring(F.coalesce(value, F.lit("")), 1, length)


def first_of_json(value: Column) -> Column:
    """First element of a JSON array text; null for empty, missing or broken arrays."""
    return F.get(F.from_json(value, "array<string>"), F.lit(0))


def url_component(value: Column) -> Column:
    """Percent-encoding of one URL component (a space becomes ``%20``)."""
    encoded = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for escaped, plain in URL_KEEPS.items():
        encoded = F.replace(encoded, F.lit(escaped), F.lit(plain))
    return encoded
