"""Spans of a text: (start, end, kind number), in code points, end exclusive."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[int, int, int]


def spelled(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by kind, joined by commas."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def sha256(spelling: str) -> str:
    return hashlib.sha256(spelling.encode()).hexdigest()


def overlaps(span: tuple[int, int], taken: list[Span]) -> bool:
    return any(a < span[1] and span[0] < b for a, b, _ in taken)


def masked(text: str, spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in sorted(spans):
        if a >= at:
            out += (text[at:a], f"[{kinds[k].upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])
