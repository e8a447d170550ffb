"""Substring dedup by recompression.

A word goes if a window of ``width`` consecutive words covers it whose words
also begin anywhere else. ``recompression`` gives each window a high-level
symbol that equal windows share:

1. Count the symbols' names over all texts. A symbol that stands once has no
   window that repeats; only its place goes on. Counting combines before the
   shuffle, so that a passage in any share of the documents makes no large group.
2. The windows that one symbol stands for cover a range of words. Ranges of
   shared symbols are compared by a cryptographic digest of 128 bits (BLAKE2b)
   of their words: in ranges that stand more than once every window repeats.
3. Where a symbol has several ranges, their windows are verified one by one, by
   the same digest: those of ranges that stand once, and of one of each others.
   Windows that stand once go on, again as places.
4. Each text is read with its places: all other windows repeat.

Names of words and symbols are hashes and may be equal by chance; that only
makes a candidate more for steps 2 and 3, which look at the words. Steps 2 to 4
join on a number given to each row and share one shuffle of texts. Every row
gets its result, whatever its doc_id; repeated rows count as repeated passages.
Null texts have no words. A task holds a block of some MB or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlens.llm.recompression import symbol_names, window_symbols
from crewlens.llm.shared import as_bytes, stored
from crewlens.llm.wordseq import IS_SPACE, Words, by_size, find_words

WIDTH = 35


def _batches(batches: Iterator[pa.RecordBatch], wanted=lambda r: True) -> Iterator[tuple[list[tuple], Words]]:
    """Wanted rows (text first) in parts of some MB, with their words."""
    for batch in batches:
        for part in by_size(filter(wanted, zip(*(c.to_pylist() for c in batch.columns), strict=True)), lambda r: len(r[0])):
            yield part, find_words([r[0] for r in part])


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.diff(values, prepend=values[:1] - 1)) if len(values) else np.zeros(0, np.int64)


def _symbols(width: int):
    def run(batches):
        for part, words in _batches(batches):
            _, at, name = window_symbols(words, width)
            one = _heads(at)
            at, name = at[one], name[one]
            doc = words.doc[at]
            key = np.array([r[1] for r in part], np.int64)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(key), pa.array((at - words.first[doc]).astype(np.int32))], names=["name", "id", "at"])

    return run


def _windows_of(words: Words, width: int, places: list, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose symbol stands at one of the places, or at none of them, and those symbols' places."""
    start, at, _ = window_symbols(words, width)
    known = np.zeros(len(words.name) + 1, bool)
    for doc, some in enumerate(places):
        if some:
            known[words.first[doc] + np.asarray(some)] = True
    stays = known[at] == inside
    return start[stays], at[stays]


def digests(words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a digest of each range of words start to end, joined by a space."""
    size = words.end - words.start
    begin = np.cumsum(size + 1) - (size + 1)
    plain = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    letter = np.ones(len(plain), bool)
    letter[begin + size] = False
    plain[letter] = words.data[~IS_SPACE[words.data]]
    view, digest = memoryview(plain), hashlib.blake2b
    found = [digest(view[s:e], digest_size=16).digest() for s, e in zip(begin[start].tolist(), (begin + size)[end - 1].tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first row for each distinct combination, and how often each stands."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _ranges(width: int):
    """A row for each range of the windows of a symbol that isn't lone."""

    def run(batches):
        for part, words in _batches(batches):
            start, at = _windows_of(words, width, [r[3] for r in part], False)
            head = _heads(at)
            low, high = start[head], start[np.append(head[1:], len(start)) - 1] if len(head) else start[:0]
            at = at[head]
            half = digests(words, low, high + width)
            # Ranges agree if their words and their symbol's place in them do.
            shape = ((at - low) * 4096 + (high - low)).astype(np.int32)
            one, count = _distinct(half[:, 0], half[:, 1], shape)
            doc = words.doc[at[one]]
            name = symbol_names(words, at[one])
            columns = [pa.array(half[one, 0]), pa.array(half[one, 1]), pa.array(shape[one]), pa.array(name.view(np.int64)), pa.array(np.array([r[1] for r in part], np.int64)[doc]), pa.array((at[one] - words.first[doc]).astype(np.int32)), pa.array(count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "shape", "name", "id", "at", "n"])

    return run


def _windows(width: int):
    """A row for each window of the symbols at the given places; those of a range that repeats count twice."""

    def run(batches):
        for part, words in _batches(batches, lambda r: r[3]):
            start, at = _windows_of(words, width, [r[3] for r in part], True)
            twice = np.zeros(len(words.name) + 1, bool)
            for doc, row in enumerate(part):
                if row[4]:
                    twice[words.first[doc] + np.asarray(row[4])] = True
            half = digests(words, start, start + width)
            weight = 1 + twice[at].astype(np.int64)
            one, count = _distinct(half[:, 0], half[:, 1], weight)
            start, count = start[one], count * weight[one]
            doc = words.doc[start]
            columns = [pa.array(half[one, 0]), pa.array(half[one, 1]), pa.array(np.array([r[1] for r in part], np.int64)[doc]), pa.array((start - words.first[doc]).astype(np.int32)), pa.array(count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "id", "at", "n"])

    return run


def _kept(width: int):
    def run(batches):
        for part, words in _batches(batches):
            start, _ = _windows_of(words, width, [r[3] for r in part], False)
            again = np.zeros(len(words.name) + 1, np.int64)
            again[start] = 1
            for doc, row in enumerate(part):
                if row[4]:
                    again[words.first[doc] + np.asarray(row[4])] = 0
            start = np.flatnonzero(again)
            cover = np.zeros(len(words.name) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + width, -1)
            gone = np.cumsum(cover[:-1]) > 0
            data = words.data.tobytes()
            kept = []
            for doc in range(len(part)):
                a, b = words.first[doc], words.first[doc + 1]
                stay = a + np.flatnonzero(~gone[a:b])
                kept.append(b" ".join([data[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[words.first[1:]] - total[words.first[:-1]]
            columns = [pa.array([r[2] for r in part], pa.int64()), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) and kept_sha256 of each row."""
    docs = docs.select(as_bytes(F.col("text")).alias("text"), F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"))
    docs = stored(docs, "texts")
    # With each count, the place of one of those counted: the only one where the count is 1.
    counted = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.min("at").alias("at"))
    symbols = docs.select("text", "id").mapInArrow(_symbols(width), "name long, id long, at int").withColumn("n", F.lit(1))
    once = counted(symbols, "name").where("n = 1").select("id", "at")

    def read(places: DataFrame, names: list[str]) -> DataFrame:
        """Texts with the places of each kind. All reads have the same columns and join, so that one shuffle of texts serves them."""
        lists = places.groupBy("id").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("at"))).alias(c) for k, c in enumerate(names))).withColumnRenamed("id", "of")
        return docs.join(lists, docs.id == lists.of, "left").select("text", "id", "doc_id", *names)

    kind = lambda df, k: df.select("id", "at", F.lit(k).alias("kind"))
    ranges = read(kind(once, 0), ["lone"]).mapInArrow(_ranges(width), "high long, low long, shape int, name long, id long, at int, n int")
    first = F.min(F.struct("id", "at")).alias("first")
    ranges = ranges.groupBy("high", "low", "shape").agg(F.min("name").alias("name"), F.sum("n").alias("n"), first)
    # Symbols of several ranges: they differ in their words, or in the symbol's place.
    digest = F.struct("high", "low", "shape")
    # The condition always holds; with it both uses of ``ranges`` need the same columns, and one shuffle serves them.
    several = ranges.where("n > 0 and first.id >= 0").groupBy("name").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select(F.col("name").alias("of"))
    asked = ranges.join(several, F.col("name") == F.col("of"), "left_semi")
    asked = asked.select("first.id", "first.at", F.explode(F.when(F.col("n") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("kind"))
    windows = read(asked, ["asked", "twice"]).mapInArrow(_windows(width), "high long, low long, id long, at int, n int")
    windows = counted(windows, "high", "low").where("n = 1").select("id", "at")
    done = read(kind(once, 0).union(kind(windows, 1)), ["symbols", "windows"]).mapInArrow(_kept(width), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
    return done
