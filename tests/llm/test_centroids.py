"""Centroid clustering against a plain version in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from crewlens.llm import subvectors

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, c string, distance int, ids int"


def rows(seed=3, n=300, dim=6, size=1.0):
    rng = np.random.default_rng(seed)
    out = [(i, [float(x) * size for x in rng.normal(size=dim).round(1)]) for i in range(n)]
    out += [(7000 + i, out[3][1]) for i in range(60)] + [out[5], out[5], (None, out[9][1]), (None, out[10][1]), (5, out[11][1])]
    out += [(900, None), (901, [None] * dim), (902, [float("nan")] * dim), (903, [0.0] * dim), (904, [1.0] * (dim - 1)), (905, []), (906, [float("inf")] * dim), (907, [1.0] * (dim + 1)), (908, [1e307] * dim)]
    return [(*r, 1, 2, "c", 3, 4) for r in out]


def plain(data, k, rounds, dim, scale=64.0):
    kept = [(i, v) for i, v, *_ in data if v is not None and len(v) == dim and all(x is not None and math.isfinite(x * scale) for x in v)]
    kept = [(i, tuple(math.floor(x * scale) for x in v), v) for i, v in kept]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    centres = [r[1] for r in first]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (away(v, centres[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(nearest(v), []).append(v)
        centres = [tuple(sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)) if c in groups else centres[c] for c in range(len(centres))]
    found = [(i, nearest(v), away(v, centres[nearest(v)])) for i, v, _ in kept]
    sums = {}
    for _, c, d in found:
        sums[c] = sums.get(c, 0) + d
    most = (1 << 63) - 1
    return [(i, c, min(d, most), min(sums[c], most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found]


@pytest.mark.parametrize(("k", "width", "chunk", "size"), [(16, 2, 1 << 16, 1.0), (16, 4, 50, 1.0), (5, 1, 7, 3e6), (16, 2, 64, 1e250), (500, 2, 40, 1.0)])
def test_clusters(spark, monkeypatch, k, width, chunk, size):
    monkeypatch.setattr(subvectors, "CHUNK", chunk)
    data = rows(size=size)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = subvectors.centroid_clusters(df, k=k, rounds=3, dim=6, width=width)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, plain(data, k, 3, 6)))


def test_few_and_none(spark):
    data = [(1, [0.5] * 6, 1, 2, "c", 3, 4)]
    one = subvectors.centroid_clusters(spark.createDataFrame(data, SCHEMA), dim=6)
    assert [tuple(r) for r in one.collect()] == plain(data, 16, 3, 6)
    assert subvectors.centroid_clusters(spark.createDataFrame([], SCHEMA), dim=6).count() == 0


def test_dictionaries_lose_nothing():
    block = np.floor(np.random.default_rng(1).normal(size=(400, 3)) * 3)
    words, code = subvectors.encode_block(block)
    assert (words[code] == block).all() and len(words) == len(set(map(tuple, block)))


def test_limbs_add_up():
    for values in ([5, -5], [-1], [2**70, -(2**69), 3], [-(2**31), 2**31 - 1, -7], [0]):
        assert sum(v << (31 * p) for x in values for p, v in subvectors._limbs(x)) == sum(values)
