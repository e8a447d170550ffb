"""Centroid clustering over dictionaries of subvectors, in exact integers.

Vectors are laid in chunks of rows. In a chunk, each block of neighbouring
dimensions is dictionary-encoded without loss: its distinct subvectors, and a
code for each row. A round computes the squared distances of a chunk's distinct
subvectors to every centroid once, and a row's distances are sums of partial
ones by its codes; the update weighs the dictionary's subvectors by how often a
cluster has each code. The chunks are a stored table that each round reads;
only k x dim sums leave the tasks, added in Spark, so that no round shuffles rows.
Dictionaries belong to chunks because their size over all rows has no bound.

Components count as floor(scale * x). Vectors take part that have ``dim``
components, none null, non-finite or non-finite when scaled. Each row counts, repeated ones too; a null vec_id
is hashed as an empty one, and rows of one hash are ordered by their components.
Fewer rows than k give as many centroids as rows, none an empty table. Distances and
sums are exact; where one doesn't fit 64 bits, it is given as 2**63 - 1. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlens.llm.knn import finite
from crewlens.llm.shared import stored

#: Rows of a chunk (codes have 16 bits), dimensions of a block.
CHUNK, WIDTH = 1 << 16, 2
_MOST = (1 << 63) - 1
_LIMB = 31


@dataclass
class Chunk:
    """Ids, codes of each block and row, and the distinct subvectors of each block."""

    ids: pa.Array
    codes: np.ndarray
    words: list[np.ndarray]


def encode_block(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a block, and each row's place among them."""
    code = np.zeros(len(block), np.int64)
    for column in block.T:
        _, own = np.unique(column, return_inverse=True)
        _, first, code = np.unique(code * (int(own.max()) + 1) + own, return_index=True, return_inverse=True)
    return block[first], code


def _chunks(scale: float, dim: int, width: int, rows: int):
    """From vectors to encoded chunks: floor(scale * x) is exact as a double."""

    def packed(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.floor(np.concatenate(parts) * scale)
        found = [encode_block(x[:, i : i + width]) for i in range(0, dim, width)]
        codes = np.array([c for _, c in found], np.uint16).tobytes()
        words = np.concatenate([w.ravel() for w, _ in found])
        columns = [pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([codes], pa.binary()), pa.array([[len(w) for w, _ in found]], pa.list_(pa.int32())), pa.array([words], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "codes", "sizes", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                some = batch.slice(i, rows)
                if held and held + some.num_rows > rows:
                    yield packed(ids, parts)
                    ids, parts, held = [], [], 0
                ids.append(some.column(0))
                parts.append(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                held += some.num_rows
        if held:
            yield packed(ids, parts)

    return run


def _read(batches: Iterator[pa.RecordBatch], dim: int, width: int) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, codes, sizes, words = (batch.column(c)[i] for c in ("ids", "codes", "sizes", "words"))
            ids = ids.values
            widths = [min(width, dim - d) for d in range(0, dim, width)]
            ends = np.cumsum([n * w for n, w in zip(sizes.as_py(), widths, strict=True)])
            parts = np.split(words.values.to_numpy(zero_copy_only=False), ends[:-1])
            yield Chunk(ids, np.frombuffer(codes.as_py(), np.uint16).reshape(len(widths), len(ids)), [p.reshape(-1, w) for p, w in zip(parts, widths, strict=True)])


def _whole(x: np.ndarray, most: float) -> np.ndarray:
    """Integers of 64 bits where values up to ``most`` allow sums of squares, else Python's."""
    return x.astype(np.int64) if most < 1 << 24 else np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)


def nearest(chunk: Chunk, centroids: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each row's nearest centroid, the smaller number of equally near ones, its distance, and the words as integers."""
    most = max([abs(c) for row in centroids for c in row] + [float(np.abs(w).max(initial=0)) for w in chunk.words])
    centre = np.array(centroids, object if most >= 1 << 24 else np.int64)
    words = [_whole(w, most) for w in chunk.words]
    total = 0
    for b, (word, code) in enumerate(zip(words, chunk.codes, strict=True)):
        off = word[:, None, :] - centre[None, :, b * width : b * width + word.shape[1]]
        total = total + (off * off).sum(axis=2)[code]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster], words


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Digits to the base 2**31; the last is -1 for a negative number. They add up in any order."""
    place = 0
    while value not in (0, -1):
        value, low = divmod(value, 1 << _LIMB)
        yield place, low
        place += 1
    if value:
        yield place, value


def _sums(centroids: list[list[int]], dim: int, width: int):
    """Each cluster's count (at -1) and sums by dimension over a task's chunks, in limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dim + 1) for _ in centroids]
        for chunk in _read(batches, dim, width):
            cluster, _, words = nearest(chunk, centroids, width)
            for k, n in enumerate(np.bincount(cluster, minlength=len(centroids)).tolist()):
                total[k][dim] += n
            for b, (word, code) in enumerate(zip(words, chunk.codes, strict=True)):
                times = np.bincount(cluster * len(word) + code, minlength=len(centroids) * len(word)).reshape(len(centroids), -1)
                for k, row in enumerate((times.astype(word.dtype) @ word).tolist()):
                    for i, value in enumerate(row):
                        total[k][b * width + i] += value
        rows = [(k, d if d < dim else -1, limb, value) for k, row in enumerate(total) for d, v in enumerate(row) for limb, value in _limbs(v)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "place", "limb", "value"])

    return run


def _moved(chunks: DataFrame, centroids: list[list[int]], dim: int, width: int) -> list[list[int]]:
    """Floors of the means; a cluster without rows keeps its centroid. k x (dim + 1) sums reach the driver."""
    parts = chunks.mapInArrow(_sums(centroids, dim, width), "cluster int, place int, limb int, value long")
    total = [[0] * (dim + 1) for _ in centroids]
    for r in parts.groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect():
        total[r.cluster][r.place] += r.value << (_LIMB * r.limb)
    return [[s // row[dim] for s in row[:dim]] if row[dim] else old for row, old in zip(total, centroids, strict=True)]


def _assigned(centroids: list[list[int]], dim: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _read(batches, dim, width):
            cluster, distance, _ = nearest(chunk, centroids, width)
            yield pa.RecordBatch.from_arrays([chunk.ids, pa.array(cluster, pa.int32()), pa.array(np.minimum(distance, _MOST).astype(np.int64))], names=["vec_id", "cluster", "distance"])

    return run


def centroid_clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    The first centroids are the k vectors of least sha256("1:" + vec_id), in that order.
    """
    vector = F.col("embedding").cast("array<double>")
    usable = (F.size("vector") == dim) & finite(F.transform("vector", lambda x: x * scale))
    known = rows.select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector")).where(usable)
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = known.orderBy(hashed, "vector").limit(k).select("vector").collect()
    centroids = [[int(np.floor(x * scale)) for x in r[0]] for r in first]
    chunks = stored(known.mapInArrow(_chunks(scale, dim, width, CHUNK), "ids array<long>, codes binary, sizes array<int>, words array<double>"), "subvectors")
    for _ in range(rounds if centroids else 0):
        centroids = _moved(chunks, centroids, dim, width)
    found = stored(chunks.mapInArrow(_assigned(centroids, dim, width), "vec_id long, cluster int, distance long"), "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = {r.cluster: int(r.n) for r in found.groupBy("cluster").agg(exact.alias("n")).collect()}
    table = [(i, min(sums[i], _MOST), min(sum(sums.values()), _MOST), name) for i, name in enumerate(names) if i in sums]
    # One row for each of the k clusters.
    told = rows.sparkSession.createDataFrame(table, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), F.col("cluster") == F.col("c")).drop("c")
