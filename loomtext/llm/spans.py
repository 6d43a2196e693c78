"""Spans found in texts and their digests."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, str]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then by kind as listed."""
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered(spans, kinds))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()
