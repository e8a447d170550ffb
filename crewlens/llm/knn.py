"""Exact top-k search by a Voronoi join.

Vectors are grouped by their nearest pivot; the pivots, chosen by hash, grow with
the root of the rows. A group's summary is its radius and its longest vector:
q.x = q.p + q.(x - p) is at most q.p + |q| r, and at most |q| |x|, for all its members.
A first join solves each query inside a block of its own group, which gives a
score that its k best reach. The second join sends a group's blocks only to the
query blocks with a query whose bound reaches that score, ties included, solves
there, and ranks what the blocks return.

The data decide how much is spared: well clustered vectors meet few groups, and
vectors spread evenly meet all. Blocks bound every task.

Components count as floor(scale * x). Vectors that are null or hold null or
non-finite components take no part; vectors of different length don't meet. Rows
are told apart by a number given to each: a query's candidates are all rows but
its own, also those that repeat it or share its vec_id. Ties go to the smaller
vec_id, a null one last. Each row with an asking vec_id is a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.llm.shared import stored

#: Pivots are the root of the rows over SPREAD, from FEWEST to MOST; rows of a block, queries of a block.
SPREAD, FEWEST, MOST, BLOCK, QUERIES = 8, 12, 4096, 4096, 1024
_EXACT = float(1 << 53)
_LEAST = np.iinfo(np.int64).min


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, np.float64) for r in rows])


def scores(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where that is exact, else by Python's integers, cut to 64 bits."""
    size = max(1, queries.shape[1])
    if np.abs(queries).max(initial=0) * np.abs(x).max(initial=0) * size < _EXACT:
        return (queries @ x.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in r] for r in m], object) for m in (queries, x))
    return np.clip(a @ b.T, _LEAST, np.iinfo(np.int64).max).astype(np.int64)


def best(queries: np.ndarray, own: np.ndarray, x: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k candidates of each query with a score of its floor or more: query, candidate (both by place) and score.

    own and rows: the rows' numbers. Candidates are in the order in which ties fall.
    """
    out = []
    for i in range(0, len(queries), 256):
        found = scores(queries[i : i + 256], x)
        mine = own[i : i + 256, None] == rows[None, :]
        least = floor[i : i + 256]
        if len(rows) > k:
            least = np.maximum(least, np.partition(np.where(mine, _LEAST, found), len(rows) - k, axis=1)[:, len(rows) - k])
        q, c = np.nonzero((found >= least[:, None]) & ~mine)
        value = found[q, c]
        order = np.lexsort((c, -value.astype(object) if (value == _LEAST).any() else -value, q))
        q, c, value = q[order], c[order], value[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((q[keep] + i, c[keep], value[keep]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _grouped(scale: float, pivots: dict[int, np.ndarray]):
    def run(batches):
        for pdf in batches:
            part = np.full(len(pdf), -1, np.int32)
            far, long = np.zeros(len(pdf)), np.zeros(len(pdf))
            for dim, centre in pivots.items():
                rows = np.flatnonzero(pdf["dim"] == dim)
                if len(rows):
                    x = np.floor(_matrix(pdf["vector"].iloc[rows]) * scale)
                    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)))
                    part[rows] = d.argmin(axis=1)
                    far[rows] = np.sqrt(((x - centre[part[rows]]) ** 2).sum(1))
                    long[rows] = np.sqrt((x**2).sum(1))
            yield pdf.assign(part=part, far=far, long=long)

    return run


def _sides(pdf: pd.DataFrame, scale: float):
    pdf = pdf.sort_values(["id", "row"], na_position="last")
    own, base = pdf[~pdf["base"]], pdf[pdf["base"]]
    return [np.floor(_matrix(s["vector"]) * scale) if len(s) else None for s in (own, base)], own, base


def _first(scale: float, k: int):
    """The score that each query's k best reach in one block of its own group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (q, x), own, base = _sides(pdf, scale)
        if q is None:
            return pd.DataFrame({"row": [], "floor": []}).astype("int64")
        floor = np.full(len(own), _LEAST)
        if x is not None:
            of, _, value = best(q, own["row"].to_numpy(), x, base["row"].to_numpy(), k, floor)
            last = np.flatnonzero(np.arange(len(of)) - np.searchsorted(of, of) == k - 1)
            floor[of[last]] = value[last]
        return pd.DataFrame({"row": own["row"], "floor": floor})

    return run


def _needed(scale: float, pivots: dict[int, np.ndarray], reach: dict[tuple[int, int], tuple[float, float]]):
    """A row for each query and group that may hold one of its k best."""

    def run(batches):
        for pdf in batches:
            out = []
            for dim, rows in pdf.groupby("dim"):
                groups = sorted(g for d, g in reach if d == dim)
                q = np.floor(_matrix(rows["vector"]) * scale)
                for g in groups:
                    if g < 0:
                        out.append(rows.assign(group=g))
                        continue
                    far, long = reach[dim, g]
                    size = np.linalg.norm(q, axis=1)
                    most = np.minimum(q @ pivots[dim][g] + size * far, size * long)
                    # Rounding errors must not lose a tie.
                    out.append(rows[most * (1 + 1e-9 * np.sign(most)) + 1e-3 >= rows["floor"].to_numpy(float)].assign(group=g))
            yield pd.concat(out) if out else pdf.iloc[:0].assign(group=0)

    return run


def _solve(scale: float, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (q, x), own, base = _sides(pdf, scale)
        if q is None or x is None:
            return pd.DataFrame({c: [] for c in ("query_row", "query_id", "row", "vec_id", "score")}).astype("Int64")
        of, at, value = best(q, own["row"].to_numpy(), x, base["row"].to_numpy(), k, own["floor"].to_numpy())
        names = own["id"].astype("Int64").to_numpy(), base["id"].astype("Int64").to_numpy()
        ids = [pd.array(n[i], "Int64") for n, i in zip(names, (of, at), strict=True)]
        return pd.DataFrame({"query_row": own["row"].to_numpy()[of], "query_id": ids[0], "row": base["row"].to_numpy()[at], "vec_id": ids[1], "score": value})

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best; ``is_query`` is a condition on vec_id."""
    kind = rows.schema["embedding"].dataType.simpleString()
    known = rows.select(F.coalesce(is_query, F.lit(False)).alias("asks"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    known = known.where(finite(F.col("vector"))).withColumn("dim", F.size("vector")).withColumn("row", F.monotonically_increasing_id())
    known = stored(known, "vectors")
    n = min(MOST, max(FEWEST, int(np.sqrt(known.count()) / SPREAD)))
    # At most MOST rows: those of the least hashes.
    few = known.orderBy(F.xxhash64("row", F.lit(7)), "row").limit(n).select("vector").collect()
    chosen = [np.floor(np.asarray(r[0], np.float64) * scale) for r in few]
    pivots = {d: np.array([c for c in chosen if len(c) == d]) for d in {len(c) for c in chosen} if d}
    fields = f"asks boolean, id long, vector {kind}, dim int, row long"
    placed = stored(known.mapInPandas(_grouped(scale, pivots), f"{fields}, part int, far double, long double"), "placed")
    # A summary for each pivot, and one group more for each length that no pivot has.
    groups = placed.groupBy("dim", "part").agg(F.max("far").alias("far"), F.max("long").alias("long"), F.count("*").alias("n"), F.count_if("asks").alias("asks"))
    blocks = groups.select(F.col("dim").alias("of_dim"), F.col("part").alias("of_part"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("asks") / QUERIES)).cast("int").alias("lots"))
    reach = {(r.dim, r.part): (r.far, r.long) for r in groups.where("part >= 0").select("dim", "part", "far", "long").collect()}
    placed = placed.join(blocks, (F.col("dim") == F.col("of_dim")) & (F.col("part") == F.col("of_part"))).drop("of_dim", "of_part")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), "blocks").cast("int")).withColumn("lot", F.pmod(F.xxhash64("row", F.lit(2)), "lots").cast("int"))
    asks, every = placed.where("asks"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda df, base, *more: df.select(*more, F.lit(base).alias("base"), "row", "id", "vector")
    near = side(placed.where("block = 0").withColumn("lot", every("lots")), True, "dim", "part", "lot").union(side(asks, False, "dim", "part", "lot"))
    floors = near.groupBy("dim", "part", "lot").applyInPandas(_first(scale, k), "row long, floor long")
    bounded = asks.join(floors.select(F.col("row").alias("of"), "floor"), F.col("row") == F.col("of")).select("row", "id", "vector", "dim", "part", "lot", "floor")
    need = bounded.where("part >= 0").mapInPandas(_needed(scale, pivots, reach), f"row long, id long, vector {kind}, dim int, part int, lot int, floor long, group int")
    need = stored(need.union(bounded.where("part < 0").withColumn("group", F.col("part"))), "needed")
    met = need.select("dim", F.col("group").alias("g"), F.col("part").alias("q_part"), F.col("lot").alias("q_lot")).distinct()
    data = placed.withColumnRenamed("dim", "d").withColumnRenamed("lot", "l").join(met, (F.col("d") == F.col("dim")) & (F.col("part") == F.col("g")))
    key = ["dim", "g", "block", "q_part", "q_lot"]
    data = side(data, True, *key, F.lit(None).cast("long").alias("floor"))
    left = need.join(blocks.select("of_dim", "of_part", "blocks"), (F.col("dim") == F.col("of_dim")) & (F.col("group") == F.col("of_part")))
    left = left.withColumn("block", every("blocks")).withColumnRenamed("group", "g").withColumnRenamed("part", "q_part").withColumnRenamed("lot", "q_lot")
    found = data.union(side(left, False, *key, "floor")).groupBy(*key).applyInPandas(_solve(scale, k), "query_row long, query_id long, row long, vec_id long, score long")
    order = F.expr("row_number() over (partition by query_row order by score desc, vec_id nulls last, row)")
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
