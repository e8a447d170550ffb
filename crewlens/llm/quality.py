"""A quality classifier: naive Bayes support vectors.

A text is the set of its byte n-grams, hashed to ``BUCKETS``. Each indicator is
scaled by its class log-count ratio, rows are brought to unit length, and a
linear hinge-loss model is fitted to them by dual coordinate descent (Wang and
Manning 2012; Hsieh et al. 2008). N-grams that stand ``OFTEN`` times in a text
are indicators of their own.

The fit reads at most ``SAMPLE`` labelled documents of each class, those of the
least hashes of doc_id, and of these at most ``INDICATORS`` indicators a class,
whole documents; nothing but the text enters a score. Counting the n-grams of
the sample is a Spark job; the descent runs in one task over at most 2 x SAMPLE
rows of 2 x INDICATORS numbers. Scoring reads every whole text.

Null texts count as empty; they have no n-grams and get the score of the bias.
Equal texts, such as those of repeated rows, get equal scores; a score of 0.5
counts as class 1.
Labels other than 0 and 1, or null ones, are not used; of documents with several
labels the least counts. Where one class has no label the score is the share of
class 1 among the labels, or 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.llm.shared import as_bytes, fresh, row_key, stored

BUCKETS = 1 << 18
GRAMS = (1, 2, 3, 4)
OFTEN = 4
SAMPLE, INDICATORS = 4000, 1 << 24
#: Smoothing of the counts, penalty of the hinge loss, passes over the rows; every CALIBRATE-th row sets the scale of the score.
ALPHA, COST, PASSES, CALIBRATE = 1.0, 1.0, 12, 5
_PART = 1 << 20
_U = np.uint32


class Grams:
    """The n-gram indicators of a text as bucket numbers; texts are read in parts of a MB."""

    def __init__(self) -> None:
        self.place = np.zeros(BUCKETS, np.int64)
        self.count = np.zeros(BUCKETS, np.int64)

    def of(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8).astype(_U)
        found = [np.zeros(0, np.int64)]
        for n in GRAMS:
            for i in range(0, max(0, len(data) - n + 1), _PART):
                part = data[i : i + _PART + n - 1]
                size = len(part) - n + 1
                code = part[:size] + _U(1)
                for k in range(1, n):
                    code = code * _U(0x01000193) + part[k : k + size] + _U(1)
                code = ((code * _U(0x9E3779B1)) >> _U(33 - BUCKETS.bit_length() + 1)).astype(np.int64)
                # A code's last place marks it: one place for each code.
                order = np.arange(size)
                self.place[code] = order
                one = code[self.place[code] == order]
                found.append(one[self.count[one] == 0])
                np.add.at(self.count, code, 1)
        code = np.concatenate(found)
        often = code[self.count[code] >= OFTEN] + (BUCKETS >> 1)
        self.count[code] = 0
        return np.concatenate((code, often)).astype(np.int32)


def descend(rows: list[np.ndarray], ratio: np.ndarray, label: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over rows ratio[row] / |ratio[row]|, by dual coordinate descent."""
    rng = np.random.default_rng(seed)
    scale = [1 / max(np.linalg.norm(ratio[r]), 1e-12) for r in rows]
    weight, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    # Both classes weigh the same.
    cost = np.where(label > 0, COST * len(label) / (2.0 * max(1, (label > 0).sum())), COST * len(label) / (2.0 * max(1, (label < 0).sum())))
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)).tolist():
            y, value = label[i], ratio[rows[i]] * scale[i]
            gradient = y * (weight[rows[i]] @ value + bias) - 1.0
            new = min(max(dual[i] - gradient / 2.0, 0.0), cost[i])  # |x|^2 is 1, and 1 for the bias
            step = (new - dual[i]) * y
            if step:
                dual[i] = new
                weight[rows[i]] += step * value
                bias += step
    return weight, bias


def margin(grams: np.ndarray, ratio: np.ndarray, weight: np.ndarray, bias: float) -> float:
    value = ratio[grams]
    return float(weight[grams] @ value) / max(float(np.linalg.norm(value)), 1e-12) + bias


def calibrate(margins: np.ndarray, positive: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, rows weighed to the share of class 1 among all labels."""
    n1, n0 = int(positive.sum()), int((~positive).sum())
    if not n1 or not n0:
        return 4.0, 0.0
    weight = np.where(positive, share / n1, (1 - share) / n0)
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.column_stack([margins, np.ones(len(margins))]), np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * (theta - (4.0, 0.0))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.1)), float(theta[1])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        rows = [grams.of(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.int32()))], names=[*batch.schema.names[1:], "grams"])


def _fit(_, rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["toss", "label"]).reset_index(drop=True)
    share, label = float(rows["share"].iloc[0]), np.where(rows["label"] == 1, 1, -1)
    ones, zeros = np.full(BUCKETS, ALPHA), np.full(BUCKETS, ALPHA)
    ones[counts["bucket"]] += counts["ones"]
    zeros[counts["bucket"]] += counts["zeros"]
    ratio = np.log((ones / ones.sum()) / (zeros / zeros.sum()))
    # The log-count ratios are of rows that the descent reads; the others set the scale of the score.
    grams, fit = rows["grams"].tolist(), rows["fit"].to_numpy(bool)
    weight, bias = descend([g for g, f in zip(grams, fit, strict=True) if f], ratio, label[fit])
    rest = np.array([margin(g, ratio, weight, bias) for g, f in zip(grams, fit, strict=True) if not f])
    slope, shift = calibrate(rest, label[~fit] > 0, share)
    model = np.concatenate(([bias, slope, shift], ratio, weight)).astype(np.float32)
    return pd.DataFrame({"model": [model.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column) -> np.ndarray:
    """The model: bias, slope and shift of the score, log-count ratios, weights. train: a condition on doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & train)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    known = stored(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "labels")
    ones, zeros = (known.where(F.col("label") == k).count() for k in (1, 0))
    share = ones / (ones + zeros) if ones + zeros else 0.5
    if not ones or not zeros:
        odds = np.clip(share, 1e-3, 1 - 1e-3)
        return np.concatenate(([0.0, 1.0, np.log(odds / (1 - odds))], np.zeros(2 * BUCKETS))).astype(np.float32)
    toss = F.xxhash64("doc_id")
    part = lambda k: known.where(F.col("label") == k).orderBy(toss, "doc_id").limit(SAMPLE)
    chosen = F.broadcast(part(1).union(part(0)).withColumnRenamed("doc_id", "id"))  # 2 x SAMPLE rows at most
    texts = docs.select(as_bytes(F.col("text")).alias("text"), F.col("doc_id").cast("long").alias("doc_id")).join(chosen, F.col("doc_id") == F.col("id"))
    texts = texts.select("text", "label", toss.alias("toss"), F.lit(share).alias("share"))
    rows = stored(texts.mapInArrow(_grams, "label int, toss long, share double, grams array<int>").withColumn("fit", F.pmod("toss", F.lit(CALIBRATE)) > 0), "grams")
    # 2 x SAMPLE rows, more only where doc_ids repeat.
    sizes = rows.select("label", "toss", F.size("grams").alias("n")).groupBy("label", "toss").agg(F.sum("n").alias("n"))
    room = sizes.withColumn("total", F.expr("sum(n) over (partition by label order by toss)")).where(F.col("total") <= INDICATORS)
    rows = rows.join(room.select("label", "toss"), ["label", "toss"], "left_semi")
    counts = rows.where("fit").select("label", F.explode("grams").alias("bucket")).groupBy("bucket")
    counts = counts.agg(F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros"))
    both = rows.withColumn("all", F.lit(0)).groupBy("all").cogroup(counts.withColumn("all", F.lit(0)).groupBy("all"))
    return np.frombuffer(both.applyInPandas(_fit, "model binary").first()[0], np.float32)


def score(docs: DataFrame, model: np.ndarray, key: Column | None = None) -> DataFrame:
    """doc_id, or ``key`` in its place, and score (0 to 1; higher: class 1 is likelier) of each row."""
    # The model has 2 x BUCKETS numbers, 2 MB, whatever the input's size.
    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(model, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = Grams(), sent.value.astype(np.float64)
        bias, slope, shift = model[:3].tolist()
        ratio, weight = model[3 : 3 + BUCKETS], model[3 + BUCKETS :]
        for batch in batches:
            m = np.array([margin(grams.of(t.as_py()), ratio, weight, bias) for t in batch.column(0)])
            p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(as_bytes(F.col("text")).alias("text"), (F.col("doc_id").cast("long") if key is None else key).alias("doc_id"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out() -> Column:
    """Rows that no fit reads: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def good_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more; all their columns. Rows are told apart by their texts, which alone decide."""
    model = fit(docs, labels, label, ~held_out())
    own, other, key = fresh(docs, "key"), fresh(docs, "key kept"), row_key(F.col("text"))
    kept = score(docs, model, key).where("score >= 0.5").select(F.col("doc_id").alias(other)).distinct()
    return docs.withColumn(own, key).join(kept, F.col(own) == F.col(other), "left_semi").select(*docs.columns)
