"""Vectorised word sequences over batches of whole texts.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts of a batch are laid end to end with a
line feed between them, so that one numpy pass finds the words of all of them.
A word's name is the sum of a mixed number for each of its bytes and the byte's
place in the word, which prefix sums give for every word at once. A polynomial
over the bytes modulo 2**64 wouldn't do: long words such as those of Thue and
Morse have equal ones whatever the base. Names choose candidates; where equality
decides a result, ``distinct_words`` compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd multipliers of the two independent name families.
BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    key = (int(base), inverse)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        step = _U(pow(int(base), -1, 1 << 64)) if inverse else base
        row = np.full(max(n, 1), step, _U)
        row[0] = 1
        _POWERS[key] = have = np.multiply.accumulate(row)
    return have[:n]


def range_names(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A 64-bit name of values[s:e] for each pair: equal ranges, equal names."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    back = _powers(base, len(values) + 1, inverse=True)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(_U) * BASES[1])


def _parts(size: np.ndarray, limit: int = 1 << 20) -> Iterator[slice]:
    """Runs of words of about ``limit`` bytes together, or of one longer word."""
    total = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + limit, side="right")))
        yield slice(i, j)
        i = j


def _places(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes of all words, laid end to end: where each word begins, each byte's place in its word and in the data."""
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(before, size)
    return before, place, place + np.repeat(start, size)


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word data[s:e]; starts rise and words don't overlap."""
    size, names = end - start, np.zeros(len(start), _U)
    for part in _parts(size):
        n = size[part]
        before, place, at = _places(start[part], n)
        value = mix((data[at].astype(_U) + (place.astype(_U) << _U(8)) + _U(1)) * BASES[0])
        names[part] = mix(np.add.reduceat(value, before) + n.astype(_U) * BASES[1])
    return names


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of a first word for each distinct one, and each word's distinct one: equal means equal bytes.

    Words of one name are compared with the first of them, byte by byte; those that differ stand alone.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, of = np.unique(word_names(data, start, end), return_index=True, return_inverse=True)
    like = first[of]
    size = end - start
    other = size != size[like]
    same = np.flatnonzero(~other & (like != np.arange(len(start))))
    for part in _parts(size[same]):
        some = same[part]
        before, place, at = _places(start[some], size[some])
        differs = data[at] != data[place + np.repeat(start[like[some]], size[some])]
        other[some] = np.logical_or.reduceat(differs, before)
    alone = np.flatnonzero(other)
    of[alone] = len(first) + np.arange(len(alone))
    return np.concatenate((first, alone)), of


@dataclass
class Words:
    """Words of a batch: byte range, name and text number of each; the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    name: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def find_words(texts: list[bytes]) -> Words:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    text_end = np.cumsum(sizes)
    first = np.searchsorted(start, np.concatenate(([0], text_end)))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    name = word_names(data, start, end)
    return Words(data, start, end, name, doc, first)


def by_size(rows: Iterator[tuple], size_of, limit: int = 4 << 20) -> Iterator[list[tuple]]:
    """Runs of rows whose sizes come to the limit or, for one large row, exceed it."""
    part, total = [], 0
    for row in rows:
        n = size_of(row)
        if part and total + n > limit:
            yield part
            part, total = [], 0
        part.append(row)
        total += n
    if part:
        yield part
