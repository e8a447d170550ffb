"""Near-dedup by five-word shingles against plain sets."""

import random

import numpy as np

import corpus_pipeline as P
from crewlens.llm import neardup

from ..conftest import SMALL
from .data import frame


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_kept(rows):
    """doc_ids of the least of each group of texts that a similarity of 0.8 joins."""
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if b < a and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(d) for d in root}


def near_copies(n=150, seed=5):
    rng = random.Random(seed)
    line = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    rows = [line(rng.choice((1, 5, 8, 9, 12, 60, 90, 200))) for _ in range(n)]
    for words in rows[: n // 2] * 2:
        words = list(words)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append(words + line(rng.randrange(3)))
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, ""), (901, " \n"), (902, None), (903, "W1 w2"), (904, "w1  w2")]


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = near_copies()
    kept = P.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SMALL)
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) < len(rows) - 40 and set(got) == plain_kept(rows)


def test_odd_rows(spark):
    docs = frame(spark)
    kept = P.distinct(spark, docs, SMALL)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) == len({shingles(t) for _, t in got}) and None in {d for d, _ in got}
    assert P.distinct(spark, docs.where("false"), SMALL).count() == 0


def test_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in P.distinct(spark, docs, SMALL).collect()}
    assert kept == plain_kept([(r.doc_id, r.text) for r in docs.collect()]) and not {145, 177} & kept


def test_large_group_verifies_few_pairs(spark, monkeypatch):
    """A group of near copies is one star: about two pairs of each are verified, none is left for the last round."""
    rng, rounds, real = random.Random(3), [], neardup.candidates
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    rows = [(i, " ".join([*base[: i % 150], f"x{i}", *base[i % 150 + 1 :]])) for i in range(300)]
    monkeypatch.setattr(neardup, "candidates", lambda nodes, every=True: rounds.append(real(nodes, every)) or rounds[-1])
    assert P.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).count() == 1
    counts = [pairs.count() for pairs in rounds]
    assert counts[0] <= 2 * len(rows) and counts[1:] == [0, 0]


def test_estimates():
    """Pairs of a similarity of 0.8 or more are never dropped; of half that they are, unless the sets are tiny."""
    rng = np.random.default_rng(1)
    for size in (5, 20, 90, 450, 3000):
        for share, stays in ((0.8, True), (0.9, True), (0.4, False)):
            sets = []
            for _ in range(100):
                union = rng.integers(0, 2**63, size, dtype=np.uint64)
                both = int(np.ceil(share * size))
                half = (size - both) // 2
                sets += [np.sort(union[: both + half]), np.sort(np.concatenate((union[:both], union[both + half :])))]
            n = np.array([len(s) for s in sets])
            bins = neardup._bins(np.repeat(np.arange(200), n), np.concatenate(sets), 200)
            _, fits = neardup.estimated(bins, n, np.arange(0, 200, 2), np.arange(1, 200, 2))
            assert fits.all() if stays else size == 5 or not fits.any()


def test_estimates_without_shingles():
    bins = neardup._bins(np.zeros(0, np.int64), np.zeros(0, np.uint64), 2)
    assert bins.shape == (2, neardup.BINS) and not bins.any()
    share, _ = neardup.estimated(bins, np.zeros(2, np.int64), np.array([0]), np.array([1]))
    assert share.tolist() == [0]
