"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors of a label become one, with a multiplicity.
2. Some vectors of a label, chosen by hash, are its cluster centres; they grow
   with the root of its vectors. Every vector joins the nearest cluster and all
   whose centres are nearly as near: within ``SLACK`` in cosine. Shards thus
   overlap where they meet; a shard of more than ``SHARD`` vectors is cut by hash.
3. Each shard links its vectors to near ones, pruned robustly: a neighbour goes
   if a nearer one lies much closer to it. The lists of a vector from all its
   shards are united into one flat graph.
4. Every vector searches the shards of its clusters: greedily from the medoid
   with a beam, then on through all neighbours inside the range. What is found
   is verified by cosine in double precision.
5. ``audited`` measures recall: the links of ``queries`` vectors against all
   vectors in blocks. As every link is verified, counts of links tell the share.

Pairs of vectors that share several shards count in one of them only; no pair
leaves its task: a search returns, for each vector, how many others it links
with, and a spanning forest of the links.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null label, link with nothing; vectors of different length neither.
Distinct vectors are numbered, so that a vec_id may be null or stand for several
vectors; repeated rows are vectors of their own that link with each other.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.llm.components import components, local_roots
from crewlens.llm.shared import stored

COSINE = 0.98
#: Centres of a label: the root of its vectors over SPREAD, from FEWEST on; overlap of clusters; vectors of a shard, and of a task that assigns clusters.
SPREAD, FEWEST, SLACK, SHARD, PART = 4, 16, 0.1, 2048, 1 << 15
#: Neighbours of a vector, candidates to choose them from (near ones and chance ones), relaxation of the pruning, width of the beam.
DEGREE, NEAR, CHANCE, RELAX, BEAM = 16, 48, 8, 1.2, 16
_SEED = 11
#: Pairs handled at once in the range search.
_STEP = 1 << 15


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(key: tuple, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """The clusters of each vector, in order."""
    if not len(rows):
        return rows.assign(clusters=[])
    x, centres, clusters = _unit(rows["vector"]), _unit(pivots.sort_values("id")["vector"]).T, []
    for i in range(0, len(x), 1024):
        near = x[i : i + 1024] @ centres
        near = near >= near.max(axis=1, keepdims=True) - SLACK
        clusters += [np.flatnonzero(r) for r in near]
    return rows.drop(columns="part").assign(clusters=clusters)


def _padded(lists: list, fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=1)), fill, np.int64)
    for row, values in zip(out, lists, strict=True):
        row[: len(values)] = values
    return out


def robust_prune(similar: np.ndarray, candidates: np.ndarray) -> list[np.ndarray]:
    """For each row of candidates (of each node), up to DEGREE of them, no one much closer to a chosen one than to the node."""
    n, m = candidates.shape
    own = np.arange(n)[:, None]
    far = np.sqrt(np.maximum(0.0, 2 - 2 * similar[own, candidates]))
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    open_ = candidates != own
    open_[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    chosen = np.zeros((n, m), bool)
    rows = np.arange(n)
    for _ in range(DEGREE):
        first = np.argmax(open_, axis=1)
        some = open_[rows, first]
        if not some.any():
            break
        r, f = rows[some], first[some]
        chosen[r, f] = True
        between = np.sqrt(np.maximum(0.0, 2 - 2 * similar[candidates[r, f][:, None], candidates[r]]))
        open_[r] &= RELAX * between > far[r]
        open_[r, f] = False
    return [c[k] for c, k in zip(candidates, chosen, strict=True)]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pruned neighbours of a shard's vectors."""
    pdf = pdf.sort_values("id").reset_index(drop=True)
    x, ids, n = _unit(pdf["vector"]), pdf["id"].to_numpy(), len(pdf)
    similar = x @ x.T
    near = np.argpartition(-similar, min(NEAR, n - 1), axis=1)[:, : NEAR + 1]
    chance = np.random.default_rng(_SEED).integers(0, n, (n, CHANCE))
    lists = robust_prune(similar, np.concatenate((near, chance), axis=1))
    # Links hold in both directions, so that a vector can be reached from its neighbours, up to 2 x DEGREE a vector, its own first.
    a = np.repeat(np.arange(n), [len(k) for k in lists])
    b = np.concatenate(lists)
    pair, first = np.unique(np.concatenate((a * n + b, b * n + a)), return_index=True)
    back = first >= len(a)
    a, b = np.divmod(pair, n)
    order = np.lexsort((-similar[a, b], back, a))
    a, b = a[order], b[order]
    few = np.arange(len(a)) - np.searchsorted(a, a) < 2 * DEGREE
    a, b = a[few], b[few]
    cut = np.split(ids[b], np.searchsorted(a, np.arange(1, n)))
    return pd.DataFrame({"id": ids, "neighbours": cut})


def greedy_search(queries: np.ndarray, x: np.ndarray, table: np.ndarray, start: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with a similarity of ``cosine`` or more: all queries walk the graph together.

    ``table`` holds each node's neighbours, filled up with the node itself.
    """
    nq, n, width = len(queries), len(x), min(BEAM, len(x))
    beam = np.full((nq, width), -1, np.int64)
    score = np.full((nq, width), -np.inf)
    done = np.ones((nq, width), bool)
    beam[:, 0], score[:, 0], done[:, 0] = start, queries @ x[start], False
    seen = np.zeros((nq, n), bool)
    seen[:, start] = True
    live = np.arange(nq)
    while len(live):
        waiting = np.where(done[live], -np.inf, score[live])
        best = np.argmax(waiting, axis=1)
        go = waiting[np.arange(len(live)), best] > -np.inf
        live, best = live[go], best[go]
        if not len(live):
            break
        done[live, best] = True
        near = table[beam[live, best]]
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        value = np.where(new, np.einsum("qd,qkd->qk", queries[live], x[near]), -np.inf)
        both = np.concatenate((score[live], value), axis=1)
        keep = np.argpartition(-both, width - 1, axis=1)[:, :width]
        score[live] = np.take_along_axis(both, keep, 1)
        beam[live] = np.take_along_axis(np.concatenate((beam[live], near), axis=1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate((done[live], ~new), axis=1), keep, 1)
    # The range grows from what the beam holds through neighbours inside it.
    q, node = np.nonzero(score >= cosine)
    node = beam[q, node]
    inside = np.zeros((nq, n), bool)
    inside[q, node] = True
    tried, asked = inside.copy(), np.zeros((nq, n), bool)
    while len(q):
        for i in range(0, len(q), _STEP):
            asked[q[i : i + _STEP, None], table[node[i : i + _STEP]]] = True
        asked &= ~tried
        tried |= asked
        a, b = np.nonzero(asked)
        asked[a, b] = False
        hit = [np.einsum("pd,pd->p", queries[a[i : i + _STEP]], x[b[i : i + _STEP]]) >= cosine for i in range(0, len(a), _STEP)]
        hit = np.concatenate(hit) if hit else np.zeros(0, bool)
        q, node = a[hit], b[hit]
        inside[q, node] = True
    return np.nonzero(inside)


def _search(cosine: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the vectors of two parts of a shard, found in the graph of the second part."""
        _, _, cluster, left, right = key
        base = pdf[pdf["base"]].sort_values("id").reset_index(drop=True)
        own = base if left == right else pdf[~pdf["base"]].sort_values("id").reset_index(drop=True)
        none = pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        if not len(base) or not len(own):
            return none
        ids, n = base["id"].to_numpy(), len(base)
        x, queries = _unit(base["vector"]), _unit(own["vector"])
        lists = base["neighbours"].tolist()
        size = np.fromiter(map(len, lists), np.int64, n)
        flat = np.concatenate(lists) if size.sum() else np.zeros(0, np.int64)
        at = np.searchsorted(ids, flat)
        here = (at < n) & (ids[np.minimum(at, n - 1)] == flat)
        row, at = np.repeat(np.arange(n), size)[here], at[here]
        order = np.argsort(row, kind="stable")
        row, at = row[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        table = np.repeat(np.arange(n)[:, None], max(1, int(place.max(initial=0)) + 1), axis=1)
        table[row, place] = at
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        found_q, found_b = [], []
        for i in range(0, len(own), 1024):
            q, b = greedy_search(queries[i : i + 1024], x, table, medoid, cosine - 1e-9)
            found_q.append(q + i)
            found_b.append(b)
        q, b = np.concatenate(found_q), np.concatenate(found_b)
        if left == right:
            q, b = np.minimum(q, b), np.maximum(q, b)
            q, b = np.divmod(np.unique((q * n + b)[q != b]), n)
        exact = np.concatenate([np.einsum("pd,pd->p", queries[q[i : i + (_STEP)]], x[b[i : i + (_STEP)]]) for i in range(0, len(q), _STEP)] or [np.zeros(0)])
        q, b = q[exact >= cosine], b[exact >= cosine]
        # A pair counts in the first cluster that its vectors share.
        mine, other = _padded(own["clusters"].tolist(), -1), _padded(base["clusters"].tolist(), -2)
        count = np.zeros(len(q), bool)
        for i in range(0, len(q), _STEP):
            a, o = mine[q[i : i + (_STEP)]], other[b[i : i + (_STEP)]]
            both = (a[:, :, None] == o[:, None, :]).any(axis=2)
            count[i : i + (_STEP)] = np.where(both, a, np.iinfo(np.int64).max).min(axis=1) == cluster
        times = (own["times"].to_numpy(), base["times"].to_numpy())
        if left == right:
            node, roots = ids, local_roots(n, q, b)
            links = np.zeros(n, np.int64)
            np.add.at(links, q[count], times[1][b[count]])
            np.add.at(links, b[count], times[0][q[count]])
        else:
            node = np.concatenate((own["id"].to_numpy(), ids))
            roots = local_roots(len(node), q, b + len(own))
            links = np.zeros(len(node), np.int64)
            np.add.at(links, q[count], times[1][b[count]])
            np.add.at(links, b[count] + len(own), times[0][q[count]])
        out = pd.DataFrame({"id": node, "links": links, "root": node[roots]})
        return out[(out["links"] > 0) | (out["id"] != out["root"])]

    return run


def vectors(rows: DataFrame) -> DataFrame:
    """Usable vectors: id (vec_id), label, dim and vector."""
    out = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("label"), F.col("embedding").alias("vector")).where(usable(F.col("vector")) & F.col("label").isNotNull())
    return out.select("id", "label", F.size("vector").alias("dim"), "vector")


def _shards(distinct: DataFrame) -> DataFrame:
    """A row for each vector and cluster it belongs to, with the part of the shard."""
    kind, label = distinct.schema["vector"].dataType.simpleString(), distinct.schema["label"].dataType.simpleString()
    count = distinct.groupBy("label", "dim").agg(F.count("*").alias("n"))
    # Of n vectors about FEWEST or more: those whose hashes leave a small rest, and one at least. Every part of PART vectors of the label gets them.
    parts = F.ceil(F.col("n") / PART).cast("int")
    toss = F.xxhash64("id", F.lit(_SEED))
    wanted = F.greatest(F.lit(FEWEST), F.ceil(F.sqrt("n") / SPREAD)).cast("long")
    chance = distinct.join(count, ["label", "dim"]).where(F.pmod(toss, F.col("n")) < wanted).select("id")
    one = distinct.groupBy("label", "dim").agg(F.min_by("id", F.struct(toss, "id")).alias("id")).select("id")
    few = chance.union(one).distinct().withColumnRenamed("id", "of")
    pivots = distinct.join(few, F.col("id") == F.col("of")).select("id", "label", "dim", "vector")
    pivots = pivots.join(count, ["label", "dim"]).select("id", "label", "dim", "vector", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = distinct.join(count, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    rows = rows.select("id", "label", "dim", "times", "vector", "part")
    by = ["label", "dim", "part"]
    schema = f"id long, label {label}, dim int, times long, vector {kind}, clusters array<int>"
    pivots = stored(pivots, "pivots")
    near = rows.groupBy(*by).cogroup(pivots.groupBy(*by)).applyInPandas(_assign, schema)
    near = stored(near, "assigned").withColumn("cluster", F.explode("clusters"))
    sizes = near.groupBy("label", "dim", "cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    return near.join(sizes, ["label", "dim", "cluster"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), "parts").cast("int"))


def linked(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """of_label, of_vector, n_links and component_id of each distinct usable vector, stored: how many other rows one of its rows links with, and the least vec_id reached."""
    distinct = vectors(rows).groupBy("label", "dim", "vector").agg(F.min("id").alias("first"), F.count("*").alias("times"))
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("id"), "first", "label", "dim", "vector", "times"), "vectors")
    shards = stored(_shards(distinct.drop("first")), "shards")
    where = ["label", "dim", "cluster", "part"]
    graph = shards.groupBy(*where).applyInPandas(_build, "id long, neighbours array<long>")
    flat = graph.groupBy(F.col("id").alias("node")).agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    full = shards.join(flat, F.col("id") == F.col("node")).drop("node")
    fields = ["label", "dim", "cluster", "left", "right", "base", "id", "times", "clusters", "vector", "neighbours"]
    base = full.withColumn("left", F.explode(F.sequence(F.lit(0), F.col("part")))).withColumn("right", F.col("part")).withColumn("base", F.lit(True)).select(*fields)
    asks = shards.where("part + 1 < parts").withColumn("right", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1))).withColumn("left", F.col("part"))
    asks = asks.withColumn("base", F.lit(False)).withColumn("neighbours", F.lit(None).cast("array<bigint>")).select(*fields)
    found = base.union(asks).groupBy("label", "dim", "cluster", "left", "right").applyInPandas(_search(cosine), "id long, links long, root long")
    found = stored(found, "found")
    links = found.groupBy(F.col("id").alias("of")).agg(F.sum("links").alias("links"))
    groups = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    each = distinct.join(links, F.col("id") == F.col("of"), "left").join(groups, F.col("id") == F.col("node"), "left")
    each = each.select(F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), "first", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "id").alias("group"))
    least = each.groupBy(F.col("group").alias("of_group")).agg(F.min("first").alias("component_id"))
    each = each.join(least, F.col("group") == F.col("of_group"))
    return stored(each.select("of_label", "of_vector", "n_links", "component_id"), "linked")


def _named(rows: DataFrame, each: DataFrame) -> DataFrame:
    named = vectors(rows).join(each, (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector"))).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = rows.where(~usable(F.col("embedding")) | F.col("label").isNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return named.union(alone)


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links and component_id of each row of ``rows``: how many others it links with, and the least vec_id it reaches."""
    return _named(rows, linked(rows, cosine))


def audited(rows: DataFrame, cosine: float = COSINE, least: float = 0.9) -> DataFrame:
    """``near_vectors`` with a column ``recall``, measured on this run: null where no audited vector has a link. Below ``least`` a warning is given."""
    each = linked(rows, cosine)
    recall = audit_recall(rows, each, cosine)
    if recall is not None and recall < least:
        warnings.warn(f"the graph finds {recall:.3f} of the links only: widen SLACK, DEGREE or BEAM", stacklevel=2)
    return _named(rows, each).withColumn("recall", F.lit(recall).cast("double"))


def audit_recall(rows: DataFrame, each: DataFrame, cosine: float = COSINE, queries: int = 256) -> float | None:
    """The share of the links of ``queries`` distinct vectors (those of the least hashes) that ``linked`` counts, against all rows in blocks; null without a link."""
    asked = each.select(F.col("of_label").alias("label"), F.col("of_vector").alias("vector"), "n_links").orderBy(F.xxhash64("of_label", "of_vector", F.lit(29)), "of_label", "of_vector").limit(queries).toPandas()
    dims = asked["vector"].map(len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.to_pandas()
            total = np.zeros(len(asked), np.int64)
            for key, own in part.groupby(["label", "dim"]):
                mine = np.flatnonzero((asked["label"] == key[0]) & (dims == key[1]))
                if len(mine):
                    total[mine] += (_unit(asked["vector"].iloc[mine]) @ _unit(own["vector"]).T >= cosine).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked))), pa.array(total)], names=["at", "n"])

    true = vectors(rows).select("label", "dim", "vector").mapInArrow(run, "at long, n long").groupBy("at").agg((F.sum("n") - 1).alias("n")).toPandas()
    n = true["n"].to_numpy(np.int64)
    return float(np.minimum(n, asked["n_links"].to_numpy()[true["at"]]).sum() / n.sum()) if n.sum() else None
