"""Restricted recompression of word sequences.

Two rounds name runs of equal symbols and then pairs of unequal ones. A round
only makes symbols of up to ``CAPS[r]`` words, so whether a word range is one
symbol is settled by few words around it: a round changes, near the edge of
equal passages, up to CAPS[r] words by runs that go on outside and up to
CAPS[r] - 1 by a pair with the symbol outside. With the caps 2 and 3 this comes
to REACH = 8 words. Equal passages thus have equal symbols from 8 words inside
their edges on, wherever they stand.

The high-level symbol of a border between two symbols is the name of the 16
words around it. Among the borders that are safe in a window of 35 words, the
one of the least name stands for the window: equal windows have equal high-level
symbols at equal places.
"""

from __future__ import annotations

import numpy as np

from crewlens.llm.wordseq import BASES, Words, mix, range_names

CAPS = (2, 3)
REACH = 8
_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def _name_runs(name, start, size, doc, cap, salt):
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(name)))
    joined = (count > 1) & (count * size[head] <= cap)
    keep = new | ~np.repeat(joined, count)
    name, size = name.copy(), size.copy()
    at = head[joined]
    name[at] = mix(name[at] * BASES[1] + count[joined].astype(_U) + salt)
    size[at] *= count[joined]
    return name[keep], start[keep], size[keep], doc[keep]


def _name_pairs(name, start, size, doc, cap, salt):
    left = (mix(name ^ salt) >> _U(63)) == 0
    pair = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1]) & (size[:-1] + size[1:] <= cap)
    at = np.flatnonzero(pair)
    name, size = name.copy(), size.copy()
    name[at] = mix(name[at] * BASES[0] + mix(name[at + 1] + salt))
    size[at] += size[at + 1]
    keep = np.ones(len(name), bool)
    keep[at + 1] = False
    return name[keep], start[keep], size[keep], doc[keep]


def borders(words: Words) -> np.ndarray:
    """The word numbers at which a symbol of the last round begins."""
    name, start = words.name, np.arange(len(words.name))
    size, doc = np.ones(len(name), np.int64), words.doc
    for r, cap in enumerate(CAPS):
        if len(name) < 2:
            break
        name, start, size, doc = _name_runs(name, start, size, doc, cap, _U(2 * r + 11))
        if len(name) > 1:
            name, start, size, doc = _name_pairs(name, start, size, doc, cap, _U(2 * r + 12))
    return start


def _least_in(value: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the first least value among the next ``width``."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, span = np.arange(len(value)), 1
    while span * 2 <= width:
        a, b = place[: len(place) - span], place[span:]
        place = np.where(value[b] < value[a], b, a)
        span *= 2
    a, b = place[:n], place[width - span : width - span + n]
    return np.where(value[b] < value[a], b, a)


def symbol_names(words: Words, at: np.ndarray) -> np.ndarray:
    """The high-level name of each border."""
    return range_names(words.name, at - REACH, at + REACH, BASES[0]) >> _U(1)


def window_symbols(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words, the border that stands for each, and its high-level name."""
    n = len(words.name)
    safe = width - 2 * REACH + 1
    empty = np.zeros(0, np.int64)
    if safe < CAPS[-1]:
        raise ValueError(f"windows need {2 * REACH + CAPS[-1] - 1} words or more")
    if n < width:
        return empty, empty, np.zeros(0, _U)
    key = np.full(n + 1, _NONE, _U)
    at = borders(words)
    at = at[(at >= REACH) & (at + REACH <= n)]
    at = at[words.doc[at - REACH] == words.doc[at + REACH - 1]]
    key[at] = symbol_names(words, at)
    start = np.flatnonzero(words.doc[: n - width + 1] == words.doc[width - 1 :])
    best = _least_in(key[REACH:], safe)[start] + REACH
    return start, best, key[best]
