"""Local alignment of word sequences, many pairs at a time."""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -1


def best_local(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of one item against several passages (word ids), and where in each the best alignment ends (exclusive).

    One row of the table is computed for all passages together; the gap along a row is a running maximum.
    """
    k, width = len(passages), max(map(len, passages), default=0)
    best, end = np.zeros(k, np.int64), np.zeros(k, np.int64)
    if not width or not len(item):
        return best, end
    table = np.full((k, width), -1, np.int32)
    for i, p in enumerate(passages):
        table[i, : len(p)] = p
    ramp = np.arange(width, dtype=np.int32) * -GAP
    before = np.zeros((k, width + 1), np.int32)
    rows = np.arange(k)
    for w in item.tolist():
        now = before[:, :-1] + np.where(table == w, MATCH, MISMATCH).astype(np.int32)
        np.maximum(now, before[:, 1:] + GAP, out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        before[:, 1:] = now
        at = now.argmax(axis=1)
        top = now[rows, at]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
    return best, end


def banded(item: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int, int]:
    """(score, matched words, start, end) of the best local alignment of item[i] with text[i + diagonal + c], |c| <= band; the end is exclusive."""
    size = 2 * band + 1
    score, matched, start = [0] * size, [0] * size, [0] * size
    best = (0, 0, 0, 0)
    n = len(text)
    for i, w in enumerate(item.tolist()):
        s2, m2, b2 = [0] * size, [0] * size, [0] * size
        for c in range(size):
            j = i + diagonal + c - band
            if not 0 <= j < n:
                continue
            same = text[j] == w
            options = [(score[c] + (MATCH if same else MISMATCH), matched[c] + same, start[c] if score[c] else j)]
            if c + 1 < size and score[c + 1]:
                options.append((score[c + 1] + GAP, matched[c + 1], start[c + 1]))
            if c and s2[c - 1]:
                options.append((s2[c - 1] + GAP, m2[c - 1], b2[c - 1]))
            top = max(options, key=lambda o: (o[0], o[1]))
            if top[0] > 0:
                s2[c], m2[c], b2[c] = top
                if (top[0], top[1]) > best[:2]:
                    best = (int(top[0]), int(top[1]), top[2], j + 1)
        score, matched, start = s2, m2, b2
    return best
