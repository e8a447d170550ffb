"""A minimal acyclic transducer from frequent words to token ids.

Words with a common ending share the states of that ending. An edge carries how
many words come before those behind it; the sum along a word's path is the
word's number, and that number's entry in a flat list holds its ids. States are
laid out by row displacement: an edge stands at ``base[state] + byte`` and names
its state. The arrays form one file, which workers memory-map and all share.
"""

from __future__ import annotations

import json
import mmap
from collections.abc import Iterable

import numpy as np

_NAMES = ("base", "final", "owner", "target", "before", "first", "ids")


def _minimal_states(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """States of the minimal automaton of sorted words; state 0 is the start."""
    edges, final = [{}], [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) of the last word

    def close(depth: int) -> None:
        while len(path) > depth:
            parent, byte = path.pop()
            state = edges[parent][byte]
            key = (final[state], tuple(edges[state].items()))
            edges[parent][byte] = known.setdefault(key, state)

    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[same:]:
            edges.append({})
            final.append(False)
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        last = word
    close(0)
    return edges, final


#: Places tried at once for a state's edges.
_SPAN = 4096


def _longer(owner, target, before, free):
    return (np.concatenate((x, np.full(len(x), fill, x.dtype))) for x, fill in ((owner, -1), (target, 0), (before, 0), (free, True)))


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The transducer of (word, ids) pairs, in the form that ``Lexicon`` maps."""
    table = dict(entries)
    words = sorted(w for w in table if w)
    edges, final = _minimal_states(words)
    number, order, stack = {}, [], [0]
    number[0] = 0
    while stack:
        state = stack.pop()
        order.append(state)
        for after in edges[state].values():
            if after not in number:
                number[after] = len(number)
                stack.append(after)
    count: dict[int, int] = {}
    todo = [(0, False)]
    while todo:
        state, ready = todo.pop()
        if ready:
            count[state] = final[state] + sum(count[t] for t in edges[state].values())
        elif state not in count:
            todo.append((state, True))
            todo.extend((t, False) for t in edges[state].values() if t not in count)
    slots = _SPAN + 1024 + 2 * sum(len(edges[s]) for s in order)
    owner, target, before = np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
    free = np.ones(slots, bool)
    base, low, single = np.zeros(len(order), np.int32), 0, 256
    for state in sorted(order, key=lambda s: -len(edges[s])):
        labels = list(edges[state])
        if not labels:
            continue
        if len(labels) == 1:
            while not free[single]:
                single += 1
                if single + 1 >= len(free):
                    owner, target, before, free = _longer(owner, target, before, free)
            at = single - labels[0]
        else:
            at = low
            while True:
                fits = np.logical_and.reduce([free[at + x : at + x + _SPAN] for x in labels])
                if fits.any():
                    at += int(np.argmax(fits))
                    break
                at += _SPAN
                # Few gaps are left below: those go to states of one edge.
                low = at
                if len(free) < at + 256 + 2 * _SPAN:
                    owner, target, before, free = _longer(owner, target, before, free)
        base[number[state]] = at
        seen = int(final[state])
        for byte, after in edges[state].items():
            owner[at + byte], target[at + byte], before[at + byte], free[at + byte] = number[state], number[after], seen, False
            seen += count[after]
    ends = np.zeros(len(number), np.uint8)
    for state in order:
        ends[number[state]] = final[state]
    first = np.zeros(len(words) + 1, np.int64)
    first[1:] = np.cumsum([len(table[w]) for w in words])
    ids = np.fromiter((i for w in words for i in table[w]), np.int32, int(first[-1]))
    arrays = dict(zip(_NAMES, (base, ends, owner, target, before, first, ids), strict=True))
    head = json.dumps([[k, str(a.dtype), len(a)] for k, a in arrays.items()]).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() for a in arrays.values())


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = 8 + int.from_bytes(data[:8], "little")
        for name, kind, n in json.loads(data[8:at]):
            array = np.frombuffer(data, np.dtype(kind), n, at)
            setattr(self, name, array)
            at += array.nbytes

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word data[start:end], or -1. All words step through the states together."""
        found = np.full(len(start), -1, np.int64)
        live, state, number, at = np.arange(len(start)), np.zeros(len(start), np.int32), np.zeros(len(start), np.int64), start
        last = len(self.owner) - 1
        while len(live):
            slot = np.minimum(self.base[state] + data[at], last)
            ok = self.owner[slot] == state
            live, slot = live[ok], slot[ok]
            number, state, at = number[ok] + self.before[slot], self.target[slot], at[ok] + 1
            done = at == end[live]
            if done.any():
                hit = done & (self.final[state] > 0)
                found[live[hit]] = number[hit]
                live, state, number, at = live[~done], state[~done], number[~done], at[~done]
        return found
