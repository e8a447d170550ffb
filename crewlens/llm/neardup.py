"""Near-dedup of documents by shingles of five words: whatever has a Jaccard similarity of 0.8 or more is one group.

A document is its set of shingles; documents of equal sets are one node. A node
has 128 SimHash bits in two halves. All nodes whose set sizes allow the
similarity are compared, half by half, in numpy, tile against tile: sizes are
cut into levels of a factor of 1.25, and a level meets itself and the next one.
Halves up to ``HALF`` and together up to ``WHOLE`` differing bits are candidates,
about 9.7 and 19.4 being expected at a similarity of 0.8. So few bits let pairs
of half that similarity pass and don't tell which of a thousand near copies is
the nearest. What passes is therefore estimated more closely, still in the task:
shingles fall into ``BINS`` bins, a node keeps a byte of the least in each, and
the share of equal bytes estimates the similarity. Pairs estimated four standard
deviations below 0.8 go. Each candidate pair is then verified on the sets
themselves, so that no pair below 0.8 links anything. Bits and bins are
sketches: a similar pair is missed where it strays some four standard deviations
from what is expected.

Pairs inside a group need no verifying once the group is known. Two rounds verify
few candidates of each node: that of the least number, which makes a star of a
group of near copies, and the nearest one, both only outside the node's group so
far. A last round verifies every candidate pair between groups that remain, so
that nothing is lost.

The number of compared pairs grows with the square of the nodes of a level, that
of verified ones with the nodes, and with the pairs between groups that are near
each other but not similar. Null texts count as empty; documents without words
are one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlens.llm.components import components
from crewlens.llm.shared import as_bytes, row_key, stored
from crewlens.llm.simhash import keep_first
from crewlens.llm.wordseq import BASES, by_size, find_words, mix, range_names

SHINGLE = 5
HALF, WHOLE = 24, 40
BINS = 256
#: Nodes of one side that a comparing task holds, and pairs that it compares at once.
BLOCK = 1 << 15
_PAIRS = 1 << 20
#: Pairs whose bins are compared at once.
_CLOSE = 1 << 15
#: Sets below this size have a similarity of 0.8 to themselves only.
_LEAST = 4
_PART = 1 << 15
_SALTS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and name of each distinct shingle of the ASCII-lower-cased texts, by text and name; of fewer than five words all are one."""
    words = find_words([t.lower() for t in texts])
    n = np.diff(words.first)
    n = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), n)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + words.first[:-1][doc]
    name = range_names(words.name, start, np.minimum(start + SHINGLE, words.first[1:][doc]), BASES[0])
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    return doc[new], name[new]


def _majority(doc: np.ndarray, name: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its names have."""
    counts = np.zeros((len(n), 64), np.int64)
    for i in range(0, len(doc), _PART):
        bits = np.unpackbits(name[i : i + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = doc[i : i + _PART]
        runs = np.flatnonzero(np.diff(of, prepend=-1))
        counts[of[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]


def _nodes(doc: np.ndarray, name: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A name of each text's set of shingles."""
    total = np.zeros(len(n) + 1, np.uint64)
    np.cumsum(np.bincount(doc, minlength=len(n)), out=(ends := np.zeros(len(n) + 1, np.int64))[1:])
    sums = np.zeros(len(doc) + 1, np.uint64)
    np.cumsum(mix(name ^ _SALTS[1]), out=sums[1:])
    total = sums[ends[1:]] - sums[ends[:-1]]
    return mix(total + n.astype(np.uint64) * BASES[1]).view(np.int64)


def _bins(doc: np.ndarray, name: np.ndarray, texts: int) -> np.ndarray:
    """For each text a byte of the least name of each bin, 0 where a bin has none. Names rise within a text."""
    found = np.zeros(texts * BINS, np.uint8)
    spot, first = np.unique(doc * BINS + (name % np.uint64(BINS)).astype(np.int64), return_index=True)
    found[spot] = 1 + (mix(name[first]) % np.uint64(255)).astype(np.uint8)
    return found.reshape(texts, BINS)


def estimated(bins: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimated similarity of each pair of rows, and whether it may be 0.8 within four standard deviations.

    Each bin draws one of the shingles of both sets without putting it back: small sets are drawn nearly whole.
    """
    share, fits = np.zeros(len(x)), np.zeros(len(x), bool)
    for i in range(0, len(x), _CLOSE):
        part = slice(i, i + _CLOSE)
        a, b = bins[x[part]], bins[y[part]]
        drawn = np.maximum(np.count_nonzero(a | b, axis=1), 1)
        share[part] = np.count_nonzero((a == b) & (a > 0), axis=1) / drawn
        union = np.maximum((n[x[part]] + n[y[part]]) / 1.8, drawn + 1)
        fits[part] = share[part] >= 0.8 - 4 * np.sqrt(0.8 * 0.2 / drawn * (union - drawn) / (union - 1))
    return share, fits


def _rows(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[tuple]]:
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return by_size(rows, lambda r: len(r[text]), 1 << 20)


def word_prints(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of doc_id and text), node (a name of the set of shingles), n (its size) the two halves of its SimHash and its bins, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches, 2):
            doc, name = _shingles([r[2] for r in rows])
            n = np.bincount(doc, minlength=len(rows))
            halves = [_majority(doc, name, n), _majority(doc, mix(name ^ _SALTS[0]), n)]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())] + [pa.array(c, pa.int64()) for c in (_nodes(doc, name, n), n, *halves)]
            columns.append(pa.array([b.tobytes() for b in _bins(doc, name, len(rows))], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "node", "n", "half", "other", "bins"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), as_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key binary, node long, n long, half long, other long, bins binary")


def _sets(texts: DataFrame) -> DataFrame:
    """node and its set of shingles for each row of a table of texts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches, 0):
            doc, name = _shingles([r[0] for r in rows])
            n = np.bincount(doc, minlength=len(rows))
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(name.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(doc, name, n)), sets], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _compare(every: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Candidate pairs between groups: all of them, or of each node the one of the least number and the nearest one."""
        pdf = pdf.sort_values("node")
        probe = pdf["probe"].to_numpy()
        own, other = np.flatnonzero(~probe), np.flatnonzero(probe)
        same = bool(pdf["same"].iloc[0])
        other = own if same else other
        half, rest, n, node, group = (pdf[c].to_numpy() for c in ("half", "other", "n", "node", "cluster"))
        half, rest = half.view(np.uint64), rest.view(np.uint64)
        bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, BINS)
        step = max(1, _PAIRS // max(1, len(other)))
        met, left, right = np.zeros(len(pdf), bool), [node[:0]], [node[:0]]
        for i in range(0, len(own), step):
            a = own[i : i + step]
            # Of a tile with itself, only what comes after.
            others = other[i:] if same else other
            count = np.bitwise_count(half[a][:, None] ^ half[others][None, :])
            x, y = np.nonzero(count <= HALF)
            bits = count[x, y].astype(np.int64)
            x, y = a[x], others[y]
            more = np.bitwise_count(rest[x] ^ rest[y])
            fits = (more <= HALF) & (bits + more <= WHOLE) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])) & (group[x] != group[y])
            if same:
                fits &= x < y
            x, y = x[fits], y[fits]
            share, fits = estimated(bins, n, x, y)
            x, y, share = x[fits], y[fits], share[fits]
            if not every and len(x):
                # x rises, so that the first pair of a y is that of its least x.
                _, first = np.unique(y, return_index=True)
                first = first[~met[y[first]]]
                met[y] = True
                order = np.lexsort((-share, x))
                nearest = order[np.flatnonzero(np.diff(x[order], prepend=-1))]
                chosen = np.union1d(first, nearest)
                x, y = x[chosen], y[chosen]
            left.append(node[x])
            right.append(node[y])
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    return run


def candidates(nodes: DataFrame, every: bool = True) -> DataFrame:
    """Pairs a-b of nodes of different clusters whose sizes, bits and bins allow the similarity: each once, or few of each node."""
    nodes = nodes.where(F.col("n") >= _LEAST).withColumn("level", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
    # Levels of a factor: a few dozen rows whatever the input's size.
    levels = nodes.groupBy("level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("tiles"))
    levels = stored(levels.coalesce(1), "levels")
    beside = lambda step, name: levels.select((F.col("level") - step).alias("level"), F.col("tiles").alias(name))
    grid = levels.join(beside(1, "above"), "level", "left").join(beside(-1, "below"), "level", "left").na.fill(0)
    placed = nodes.join(F.broadcast(grid), "level").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    spot = lambda level, up, i, j, probe, same: F.struct(level.alias("level"), F.lit(up).alias("up"), i.alias("i"), j.alias("j"), F.lit(probe).alias("probe"), same.alias("same"))
    none = F.expr("cast(array() as array<int>)")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    level, tile, no = F.col("level"), F.col("tile"), F.lit(False)
    spots = F.concat(
        F.transform(F.sequence(tile, F.col("tiles") - 1), lambda j: spot(level, False, tile, j, False, j == tile)),
        F.transform(upto(tile), lambda i: spot(level, False, i, tile, True, no)),
        F.transform(upto(F.col("above")), lambda j: spot(level, True, tile, j, False, no)),
        F.transform(upto(F.col("below")), lambda i: spot(level - 1, True, i, tile, True, no)),
    )
    rows = placed.select(F.explode(spots).alias("s"), "node", "n", "half", "other", "bins", "cluster").select("s.*", "node", "n", "half", "other", "bins", "cluster")
    return rows.groupBy("level", "up", "i", "j").applyInPandas(_compare(every), "a long, b long")


def _sets_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of shingles of all nodes that stand in pairs."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    keys = nodes.join(wanted, "node", "left_semi").select(F.col("key").alias("key wanted"))
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), as_bytes(F.col("text")).alias("text"))
    texts = texts.join(keys, F.col("key") == F.col("key wanted"), "left_semi").dropDuplicates(["key"]).select("text")
    return stored(_sets(texts), "sets")


def similar_links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Links a-b that join whatever nodes have sets of a Jaccard similarity of 0.8 or more, directly or by steps."""
    nodes = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("half").alias("half"), F.first("other").alias("other"), F.first("bins").alias("bins"), F.min("key").alias("key"))
    nodes, links, sets = stored(nodes, "nodes"), None, None
    for every in (False, False, True):
        if links is None:
            grouped = nodes.withColumn("cluster", F.col("node"))
        else:
            near = components(links).withColumnRenamed("node", "of")
            grouped = nodes.join(near, F.col("node") == F.col("of"), "left").select(nodes["*"], F.coalesce("root", "node").alias("cluster"))
        pairs = stored(candidates(grouped, every), "candidates")
        # Whoever has a candidate at all has one in the first round.
        sets = sets or _sets_of(docs, nodes, pairs)
        side = lambda p: sets.select(F.col("node").alias(p), F.col("shingles").alias(f"of {p}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        # i / (m + n - i) >= 4 / 5
        good = both.where(9 * F.size(F.array_intersect("of a", "of b")) >= 4 * (F.size("of a") + F.size("of b"))).select("a", "b")
        good = stored(good, "similar")
        links = good if links is None else links.union(good)
    return links


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, key and root (a node that stands for the group) for each row of ``docs``."""
    prints = stored(word_prints(docs), "prints")
    near = components(similar_links(docs, prints)).withColumnRenamed("node", "of")
    return prints.join(near, F.col("node") == F.col("of"), "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group, of its least doc_id; all their columns. Of rows equal in doc_id and text any one stays."""
    return keep_first(docs, near_groups(docs))
