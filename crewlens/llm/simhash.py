"""SimHash near-dedup by tiled exact comparison.

Fingerprints are compared pair by pair, exclusive-or and bit count in numpy,
tile against tile. A fingerprint's tile is named by the population counts of its
four 16-bit quarters. Counts of two fingerprints differ, summed over quarters,
by no more than their differing bits, so that tile pairs beyond the radius are
never formed: a tile meets 41 of some thousands of tiles in use. Large tiles are
cut by hash, so that a task holds at most two blocks of rows. No pair leaves its
task: each comparison returns a spanning forest, a row for a linked fingerprint
at most.

Rows out of order, repeated rows and documents with equal texts are harmless:
links are between distinct fingerprints. An empty table gives an empty result; a
null text counts as empty; documents without words have fingerprint zero. Rows
are told apart by doc_id and text, so that doc_id may be null or repeat; a null
doc_id comes after all others. A task holds each text whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.llm.components import components, local_roots
from crewlens.llm.shared import as_bytes, fresh, row_key, stored

SEED = 42
#: Fingerprints of one side that a comparing task holds.
BLOCK = 4096
_PART = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit number.

    Words of the ASCII-lower-cased text, shingles of ``shingle`` words joined by
    a space with repeats, XXH64 of each; a bit is set if it is in over half of them.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = list(itertools.accumulate(map(len, words), lambda a, w: a + w + 1))
    counts = np.zeros(64, np.int64)
    digest, starts, last = xxhash.xxh64_intdigest, [0, *(e + 1 for e in ends)], min(shingle, len(words)) - 1
    for i in range(0, n, _PART):
        k = min(_PART, n - i)
        found = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[i : i + k], ends[last + i : last + i + k], strict=True)), np.uint64, k)
        counts += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (a hash of doc_id and text) and fp (signed 64-bit) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], names=["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), as_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key binary, fp long")


def _cell(fp: Column, quarter: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 16 * quarter).bitwiseAND(F.lit(0xFFFF)))


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Steps between quarters' counts within the radius: of a step and its opposite one, and none at all."""
    steps = itertools.product(range(-radius, radius + 1), repeat=4)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]


def _compare(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, probe = pdf["fp"].to_numpy(), pdf["probe"].to_numpy()
        node, at = np.unique(fp, return_inverse=True)
        fp = fp.view(np.uint64)  # bits of a signed number are counted without its sign
        label = np.arange(len(node))
        own, other = np.flatnonzero(~probe), np.flatnonzero(probe)
        step = max(1, (1 << 20) // max(1, len(other)))
        for i in range(0, len(own), step):
            a = own[i : i + step]
            near = np.bitwise_count(fp[a][:, None] ^ fp[other][None, :]) <= radius
            x, y = np.nonzero(near)
            if len(x):
                label = local_roots(len(node), at[a[x]], at[other[y]], label)
        moved = label != np.arange(len(node))
        return pd.DataFrame({"a": node[moved], "b": node[label[moved]]})

    return run


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links a-b between distinct fingerprints that join whatever lies within ``radius`` bits, directly or by steps.

    ``fps`` has one row for each distinct fp.
    """
    fps = fps.select("fp", sum((F.shiftleft(_cell(F.col("fp"), q) + radius, 5 * q) for q in range(4)), F.lit(0)).alias("cell"))
    steps = F.array(*(F.lit(sum(d << (5 * q) for q, d in enumerate(s))) for s in _offsets(radius)))
    near = lambda: F.explode(F.transform(steps, lambda d: F.col("cell") + d)).alias("cell")
    # At most 17**4 = 83,521 cells exist, so this table may be broadcast whatever the input's size.
    cells = stored(fps.groupBy("cell").agg(F.count("*").alias("n")).coalesce(1), "cells")
    probes = cells.select(near(), "n").groupBy("cell").agg(F.sum("n").alias("probes"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    grid = F.broadcast(cells.join(probes, "cell").select("cell", blocks("n").alias("tiles"), blocks("probes").alias("blocks")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = fps.join(grid, "cell").select("cell", F.pmod(F.xxhash64("fp"), "tiles").cast("int").alias("tile"), every("blocks").alias("block"), "fp", F.lit(False).alias("probe"))
    probe = fps.select(near(), "fp").join(grid, "cell")
    probe = probe.select("cell", every("tiles").alias("tile"), F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"), "fp", F.lit(True).alias("probe"))
    return own.union(probe).groupBy("cell", "tile", "block").applyInPandas(_compare(radius), "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, key, fp, root (the least fp of the group) and component_id, the least doc_id of the documents reachable by links, for each row of ``docs``."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    near = components(near_links(each.select("fp"), radius))
    roots = each.join(near, each.fp == near.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id")
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "of")
    named = roots.join(least, roots.root == least.of).select(F.col("fp").alias("print"), "root", "component_id")
    return prints.join(named, prints.fp == named.print).select("doc_id", "key", "fp", "root", "component_id")


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``groups`` (doc_id, key, root), of its least doc_id; all their columns. Of rows equal in doc_id and text any one stays."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    own, other = fresh(docs, "key"), fresh(docs, "key kept")
    kept = groups.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.key").alias(other))
    rows = docs.withColumn(own, row_key(F.col("doc_id"), F.col("text")))
    rows = rows.join(kept, F.col(own) == F.col(other), "left_semi").dropDuplicates([own])
    return rows.select(*docs.columns)


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row of ``docs`` for each group, of its least doc_id; all their columns. Of rows equal in doc_id and text any one stays."""
    return keep_first(docs, simhash_groups(docs, radius, shingle))
