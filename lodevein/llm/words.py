"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

from lodevein.llm.blocks import mix

#: Bytes that are hashed together: their arrays fit a core's cache.
SEGMENT = 1 << 16

#: The six ASCII white-space characters end a word.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Words end at any ASCII character that is no letter or digit.
PUNCTUATION = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127) for c in range(256)])

_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _SAME.copy()
_LOWER[65:91] += np.uint64(32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


_POWER, _BACK = _powers(_BASE, SEGMENT), _powers(_INVERSE, SEGMENT)


def word_spans(raw: np.ndarray, starts: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes begin and end; ``starts`` says where texts begin in ``raw``, and last where it ends."""
    inside = ~breaks[raw]
    first, last = inside.copy(), inside.copy()
    new = np.zeros(len(raw) + 1, bool)
    new[starts] = True
    first[1:] &= ~inside[:-1] | new[1:-1]
    last[:-1] &= ~inside[1:] | new[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray | None = None, breaks: np.ndarray = SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 bytes in order, A-Z as a-z if ``fold``, and where the words of each text begin (one entry more than texts).

    ``starts`` says where texts begin in ``raw``, and last where it ends; ``breaks`` tells which bytes end a word.
    """
    starts = np.array([0, len(raw)]) if starts is None else starts
    begins, ends = word_spans(raw, starts, breaks)
    letters = _LOWER if fold else _SAME
    out = np.empty(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        lo = int(begins[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        n = int(ends[to - 1]) - lo
        power, back = (_POWER, _BACK) if n <= SEGMENT else (_powers(_BASE, n), _powers(_INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[raw[lo : lo + n]] * power[:n], out=sums[1:])
        s, e = begins[at:to] - lo, ends[at:to] - lo
        # A word's polynomial must not depend on its place: divide by the power at its start.
        out[at:to] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        at = to
    return out, np.searchsorted(begins, starts)
