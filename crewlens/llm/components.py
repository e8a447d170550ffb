"""Connected components of link tables, by alternating stars.

Every round points the neighbours of a node to the least of them. A round is
two grouped minima, which Spark combines before the shuffle, and two equi-joins,
whose skewed partitions AQE splits; a node with any number of links is no
problem. The links shrink to stars around the least node of each component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlens.llm.shared import drop_stored, stored


def local_roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least node that each of n nodes reaches by links a-b; ``label`` holds roots found before."""
    label = np.arange(n) if label is None else label
    a, b = label[a], label[b]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _sum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of each node that is not its own root.

    ``links`` has columns a and b of one orderable type, in any direction, with
    repeats; self-links and nulls link nothing. An empty table gives an empty one.
    """
    kind = links.schema["a"].dataType
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stored(links, "links")
    before = None
    while (now := _sum(links)) != before and now[0]:
        before = now
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
        after = stored(small.union(least).distinct(), "links")
        drop_stored(links)
        links = after
    return links.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root"))
