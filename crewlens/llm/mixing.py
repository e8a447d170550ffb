"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are dealt by hash to ``SLOTS`` blocks. A source with a
target below its size takes that many words of permuted blocks; a larger target
takes every block and the rest from a second permutation. The blocks that a
source takes are its exact quota. A binary tree over the output shards splits
the quotas: a node draws from a multivariate hypergeometric law how many blocks
of each source go left, so that every shard gets its share of a random mixture
and the sums stay exact. A shard then takes the next blocks of each source's
permutation, disjoint from all others, and sorts its documents by a hash.

The last block of a permutation is only taken in part: enough further blocks to
hold ``FINE`` documents are searched for documents that fill the rest, and one
document is cut, so that a source's words come to its target exactly.

Nothing here needs all sources in one task. Their order is a two-pass rank; the
share of the uncapped is found by repeated sums over the sources; the tree first
splits the sums of groups of ``GROUP`` sources, then each group's among its own
sources, which is the same law. A source has at most 2 x SLOTS block rows.

Null and empty texts have size 0 and are never taken; a null source is a source
and comes last. Rows are told apart by SHA-256 of doc_id, source and text, so
that doc_id may be null or repeat; of equal rows, the first ones are taken once
more than the others. Ties in size or hash are broken by that key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlens.llm.shared import WORD, fresh, row_key, stored

SLOTS = 4096
FINE = 512
SHARDS = 16
GROUP = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
#: Parts of a shard, each sorted by a hash.
LOTS = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, part (its place by code point, null last) and target: share x all sizes by weight.

    Whoever is above limit x size stops there, and the rest is shared again,
    until no one is above. sizes: source, source_size, a row for each source.
    """
    spark, null = sizes.sparkSession, F.col("source").isNull()
    # Places in two passes: within ranges of sources, then behind the ranges before. Strings of Spark compare by UTF-8 bytes, which is by code point.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(sizes.repartitionByRange(n, null, "source").withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select(F.col("range").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(null, "source")) - 1
    # A row for each range, as many as there are partitions.
    placed = ranges.join(F.broadcast(before), F.col("range") == F.col("of")).select("source", "source_size", (F.col("before") + place).alias("part"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod("part", F.lit(len(WEIGHTS))).cast("int"))
    placed = stored(placed.withColumn("weight", weight), "weights")
    size, level = F.col("source_size").cast("double"), -1.0
    total = placed.agg(F.sum(size)).first()[0] or 0.0
    while True:
        # The sources below the level found so far share what the others leave; the level only rises.
        over = limit * size < level * F.col("weight")
        row = placed.agg(F.coalesce(F.sum(F.when(over, limit * size)), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        found = (share * total - row.taken) / row.free if row.free else level
        if found <= level:
            break
        level = found
    return stored(placed.select("source", "source_size", "part", F.least(limit * size, F.lit(level) * F.col("weight")).alias("target")), "targets")


def _draw(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Blocks of one source in the order drawn: full ones, then the few that fill the rest."""
        pdf = pdf.sort_values("slot").reset_index(drop=True)
        size, target = int(pdf["words"].sum()), float(pdf["target"].iloc[0])
        rng, out, rest = np.random.default_rng([seed, int(pdf["part"].iloc[0])]), [], int(target)
        for epoch in range(int(LIMIT)):
            drawn = pdf.iloc[rng.permutation(len(pdf))]
            if rest >= size:
                out.append(drawn.assign(epoch=epoch, fill=-1))
                rest -= size
                continue
            before = drawn["words"].cumsum()
            whole = int((before <= rest).sum())
            out.append(drawn.iloc[:whole].assign(epoch=epoch, fill=-1))
            rest -= int(before.iloc[whole - 1]) if whole else 0
            more = drawn.iloc[whole:]
            more = more.iloc[: int((more["docs"].cumsum() < FINE).sum()) + 1]
            if rest:
                out.append(more.assign(epoch=epoch, fill=rest))
            break
        found = pd.concat(out)
        return found.assign(place=np.arange(len(found)))[["source", "part", "slot", "epoch", "fill", "place"]]

    return run


def even(total: int, shards: int) -> np.ndarray:
    """Sizes of shards that differ by one at most."""
    return np.diff(total * np.arange(shards + 1) // shards)


def split_quotas(quota: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """quota[source] dealt to shards of the given sizes: a row for each shard. A node halves the shards it has."""
    if len(sizes) == 1:
        return quota[None, :]
    left = len(sizes) // 2
    half = int(sizes[:left].sum())
    go = np.array([half]) if len(quota) == 1 else rng.multivariate_hypergeometric(quota, half, method="marginals")
    return np.vstack([split_quotas(go, sizes[:left], rng), split_quotas(quota - go, sizes[left:], rng)])


def _upper(seed: int, shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The tree over sums of groups: how many blocks of each group a shard gets."""
        pdf = pdf.sort_values("group").reset_index(drop=True)
        quota = pdf["n"].to_numpy(np.int64)
        parts = split_quotas(quota, even(int(quota.sum()), shards), np.random.default_rng([seed, 1 << 20]))
        return pd.DataFrame({"group": pdf["group"], "sizes": list(parts.T)})

    return run


def _lower(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The tree over one group's sources, with the shards' sizes that the upper tree drew."""
        pdf = pdf.sort_values("part").reset_index(drop=True)
        rng = np.random.default_rng([seed, 1 << 21, int(pdf["group"].iloc[0])])
        parts = split_quotas(pdf["n"].to_numpy(np.int64), np.asarray(pdf["sizes"].iloc[0], np.int64), rng)
        return pd.DataFrame({"part": pdf["part"], "ends": list(np.cumsum(parts, axis=0).T)})

    return run


def shard_ends(drawn: DataFrame, seed: int, shards: int) -> DataFrame:
    """part and ends of each source: shard s takes its blocks from ends[s - 1] to ends[s] in the order drawn."""
    quotas = drawn.groupBy("part").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("part") / GROUP))
    groups = quotas.groupBy("group").agg(F.sum("n").alias("n")).groupBy().applyInPandas(_upper(seed, shards), "group long, sizes array<long>")
    return quotas.join(groups, "group").groupBy("group").applyInPandas(_lower(seed), "part long, ends array<long>")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the documents of a source's last blocks, those that fill the rest: each that still fits, in hashed order, and a part of one more."""
    pdf = pdf.sort_values(["toss", "key"]).reset_index(drop=True)
    rest, words = int(pdf["fill"].iloc[0]), np.zeros(len(pdf), np.int64)
    for i, n in enumerate(pdf["size"].tolist()):
        if n <= rest:
            words[i], rest = n, rest - n
    left = np.flatnonzero(words < pdf["size"])
    if rest and len(left):
        words[left[0]] = rest
    return pdf.assign(words=words)[words > 0].drop(columns=["toss", "fill"])


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The documents with key, doc_id, size, source_size and target; and what each shard takes of them.

    The second table has a row for each time that a document is taken: key,
    size, words (size, or fewer for one cut document of a source), epoch,
    shard and place, the order within the shard.
    """
    key = row_key(F.col("doc_id"), F.col("source"), F.col("text"))
    sized = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    sized = stored(sized.withColumn("slot", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(SLOTS)).cast("int")), "sizes")
    slots = stored(sized.groupBy("source", "slot").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "slots")
    sources = source_targets(slots.groupBy("source").agg(F.sum("words").alias("source_size")))

    named = sources.select(F.col("source").alias("of"), "part", "target", "source_size")
    same = F.col("source").eqNullSafe(F.col("of"))
    drawn = slots.join(named, same).drop("of", "source_size").groupBy("part").applyInPandas(_draw(seed), "source string, part long, slot int, epoch int, fill long, place int")
    drawn = stored(drawn, "blocks")
    dealt = drawn.join(shard_ends(drawn, seed, shards), "part")
    dealt = dealt.select(F.col("source").alias("of"), F.col("slot").alias("at"), "epoch", "fill", F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("shard"))
    found = sized.join(dealt, same & (F.col("slot") == F.col("at")))
    columns = ["key", "size", "epoch", "shard"]
    # Only documents of a source's last blocks: FINE of them, and those of one block more.
    part = found.where("fill >= 0").select("source", *columns, "fill", F.xxhash64("key", F.lit(seed + 1)).alias("toss"))
    filled = part.groupBy("source").applyInPandas(_fill, "source string, key binary, size long, epoch int, shard int, words long").select(*columns, "words")
    taken = found.where("fill < 0 and size > 0").select(*columns, F.col("size").alias("words")).union(filled)
    whole = sized.join(named, same).select("key", "doc_id", "size", "source_size", "target")
    return whole, stored(taken.withColumn("place", F.xxhash64("key", "epoch", F.lit(seed + 2))), "shards")


def shard_order(taken: DataFrame) -> DataFrame:
    """What is taken, each shard's rows in LOTS partitions, shuffled within them."""
    return taken.repartition("shard", F.pmod("place", F.lit(LOTS))).sortWithinPartitions("shard", "place")


def taken_words(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and shards (where they go) of each document, gathered from what the shards take."""
    whole, taken = mix(docs, shards, seed)
    rows = whole.groupBy("key", "doc_id", "size", "source_size", "target").agg(F.count("*").alias("rows"))
    words = taken.groupBy(F.col("key").alias("of")).agg(F.sum("words").alias("words"), F.array_sort(F.collect_set("shard")).alias("shards"))
    out = rows.join(words, F.col("key") == F.col("of"), "left").withColumn("words", F.coalesce("words", F.lit(0)))
    # Of equal rows, the first ones have one time more than the others, and the next one what is cut.
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).withColumn("times", F.expr("if(size = 0, 0, words div greatest(size, 1))"))
    taken = F.expr("(times div rows + cast(row <= times % rows as int)) * size + if(row = times % rows + 1, words - times * size, 0)")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.coalesce("shards", F.expr("cast(array() as array<int>)")).alias("shards"))


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the shards take them whole, with all their columns, shard by shard and shuffled in each.

    Texts stay whole: the one document of a source that would be cut is left out.
    """
    _, taken = mix(docs, shards, seed)
    own, of, shard, place = (fresh(docs, c) for c in ("key", "of", "shard", "place"))
    # Equal rows are interchangeable, so one of them stands for all.
    one = docs.withColumn(own, row_key(F.col("doc_id"), F.col("source"), F.col("text"))).dropDuplicates([own])
    times = taken.where("words = size").select(F.col("key").alias(of), F.col("shard").alias(shard), F.col("place").alias(place))
    out = one.join(times, F.col(own) == F.col(of))
    out = out.repartition(shard, F.pmod(F.col(place), F.lit(LOTS))).sortWithinPartitions(shard, place)
    return out.select(*docs.columns)
