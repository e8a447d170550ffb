"""The vector operators against brute-force versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crewlens.llm import graphdedup, knn
from crewlens.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, id int, times int, dim string, part int"


def rows(seed=2, n=260):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.normal(size=8)
        if i % 3 == 0 and i:
            v = np.array(out[i - 1][1]) + rng.normal(size=8) * 0.02
        if i % 10 == 0 and i:
            v = np.array(out[i - 1][1])
        out.append((i, [float(np.float32(x)) for x in v], i // 3 % 3))
    out += [(900, None, 1), (901, [None] * 8, 1), (902, [float("nan")] * 8, 1), (903, [0.0] * 8, 1), (904, [1.0] * 8, None), (905, [1.0, 2.0], 1), (906, [1.0, 2.0], 1), (907, [], 1), (908, [float("inf")] * 8, 2), out[5], out[5]]
    return [(*r, 1, 2, "d", 3) for r in out]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def usable(v, zero):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


@pytest.mark.parametrize("shard", [2048, 20])
def test_near_vectors(spark, vectors, monkeypatch, shard):
    monkeypatch.setattr(graphdedup, "SHARD", shard)
    monkeypatch.setattr(graphdedup, "PART", 64)
    data = rows()
    links = {i: set() for i in range(len(data))}
    for i, a in enumerate(data):
        for j, b in enumerate(data[:i]):
            if usable(a[1], False) and usable(b[1], False) and a[2] is not None and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    found = graphdedup.near_vectors(vectors)
    got = sorted((r.vec_id, r.n_links) for r in found.collect())
    expected = sorted((data[i][0], len(links[i])) for i in links)
    assert [g[0] for g in got] == [e[0] for e in expected]
    total = sum(e[1] for e in expected)
    assert all(g[1] <= e[1] for g, e in zip(got, expected, strict=True)) and sum(g[1] for g in got) >= 0.9 * total
    # Components of all true links: the least vec_id, and one kept vector of each.
    least = {i: data[i][0] for i in links}
    for _ in links:
        least = {i: min([least[i], *(least[j] for j in links[i])]) for i in links}
    audited = graphdedup.audited(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id")).collect()
    assert sorted((r.vec_id, r.component_id) for r in audited) == sorted((data[i][0], least[i]) for i in links)
    assert {r.component_id for r in audited} == {r.vec_id for r in audited if r.kept} and all(r.recall >= 0.9 for r in audited)
    empty = vectors.where("vec_id < 0")
    assert graphdedup.near_vectors(empty).count() == 0 and graphdedup.audited(empty).count() == 0


def test_audit_where_an_id_has_several_vectors(spark):
    """The audit compares a vector with its own links, whichever id it has; without links it tells nothing."""
    rng = np.random.default_rng(5)
    near = [(i % 80, [float(x) for x in np.eye(8)[i % 4] + rng.normal(size=8) * (0.01 if i < 80 else 2.0)], 0) for i in range(160)]
    got = graphdedup.audited(spark.createDataFrame(near, "vec_id long, embedding array<double>, label int")).collect()
    unit = np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in near])
    n = ((unit @ unit.T) >= 0.98).sum(axis=1) - 1
    assert sorted((r.vec_id, r.n_links) for r in got) == sorted((r[0], int(k)) for r, k in zip(near, n, strict=True)) and {r.recall for r in got} == {1.0}
    apart = [(i, [float(x) for x in np.eye(8)[i]], 0) for i in range(8)]
    assert {r.recall for r in graphdedup.audited(spark.createDataFrame(apart, "vec_id long, embedding array<double>, label int")).collect()} == {None}


def test_vectors_of_one_id(spark):
    """Null ids, and an id of two vectors."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (None, [0.01, 1.0], 0), (5, [0.0, 1.0], 0)]
    got = graphdedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == [("1", 1, 1), ("1", 2, 1), ("2", 1, 1), ("5", 2, 1), ("None", 2, 1)]


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "QUERIES", 5)
    more = [(None, *rows()[7][1:]), (40, *rows()[8][1:]), rows()[40]]
    data = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in rows() + more if usable(r[1], True)]
    expected = []
    for i, (q, v) in enumerate(data):
        if q is not None and q % 20 == 0:
            near = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), c is None, c or 0) for j, (c, w) in enumerate(data) if j != i and len(w) == len(v))
            expected += [(q, k + 1, None if none else c, -s) for k, (s, none, c) in enumerate(near[:20])]
    asked = vectors.union(spark.createDataFrame(more, SCHEMA))
    got = knn.top_k(asked, F.col("vec_id") % 20 == 0)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected))
    assert knn.top_k(vectors.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_large_scores(spark):
    df = spark.createDataFrame([(0, [3e7, -2e7]), (1, [1e7, 5.0]), (2, [2.5e7, 1e7])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in knn.top_k(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()]
    v = [[int(math.floor(64 * x)) for x in r] for r in ([3e7, -2e7], [1e7, 5.0], [2.5e7, 1e7])]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert got == [(0, 1, 2, min(dot(v[0], v[2]), 2**63 - 1)), (0, 2, 1, min(dot(v[0], v[1]), 2**63 - 1))]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(500, i) for i in range(300, 400)] + [(i, i + 1) for i in range(600, 640)] + [(7, 7)]
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in root} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
