"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased bytes (runs of white space as one space, a space at
either end), hashed to 2**BITS places. Each feature's value is the naive Bayes ratio
r = log((p + a) / |p|) - log((q + a) / |q|), p and q counting the training texts of each class that hold the feature.
A logistic regression with an L2 penalty learns weights on these values; weight times ratio is one table of numbers, and a text's score is the
logistic function of the sum over its features.

The training rows are a bounded sample: at most PER_CLASS texts of each label, by a hash of the id. The table of weights has 2**BITS numbers.

Defined cases: null text is an empty text; an empty text has the score of the intercept; without training rows, or
with one label only, the score is the smoothed share of toxic labels; contradicting labels of one document all count; rows with null label or id are not
trained on; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, parts, schema_of

ORDERS = (3, 4, 5)
BITS = 18
PER_CLASS = 1000
ALPHA = 1.0
#: Features of fewer training texts get no weight.
LEAST = 3
L2 = 2e-3
STEPS = 60
RATE = 0.02


def features(text: str | bytes | None, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """Places of the distinct n-grams."""
    raw = text.encode() if isinstance(text, str) else text or b""
    raw = b" ".join(raw.lower().split())
    if not raw:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    h, found = b * np.uint32(0x9E3779B1), []
    for n in range(2, min(max(orders), len(b)) + 1):
        h = h[:-1] * np.uint32(0x85EBCA6B) ^ b[n - 1 :] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        if n in orders:
            found.append(h * np.uint32(0x2C1B3C6D) >> np.uint32(32 - bits))
    if not found:
        return np.zeros(0, np.int64)
    x = np.sort(np.concatenate(found))
    return x[np.concatenate([[True], x[1:] != x[:-1]])].astype(np.int64)


class Model:
    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def score(self, text: str | bytes | None) -> float:
        f = features(text, bits=int(np.log2(len(self.table))))
        z = self.bias + (float(self.table[f].sum()) if len(f) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str], labels: list[int], bits: int = BITS, l2: float = L2, steps: int = STEPS) -> Model:
    """Full-batch accelerated gradient descent on the logistic loss, classes weighted alike."""
    y = np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 10)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))))
    rows = [features(t, bits=bits) for t in texts]
    common = np.bincount(np.concatenate(rows), minlength=1 << bits) >= LEAST
    rows = [r[common[r]] for r in rows]
    at = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    p = np.bincount(at[y[doc] == 1], minlength=1 << bits) + ALPHA
    q = np.bincount(at[y[doc] == 0], minlength=1 << bits) + ALPHA
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log(p / (n1 + 2 * ALPHA)) - np.log(q / (n0 + 2 * ALPHA))
    value = ratio[at]
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, bias = np.zeros(1 << bits), 0.0
    moment, second, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(doc, w[at] * value, len(rows)) + bias
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(at, g[doc] * value, 1 << bits) + l2 * w
        gb = g.sum()
        moment = 0.9 * moment + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= RATE * (moment / c1) / (np.sqrt(second / c2) + 1e-6)
        bias -= RATE * (mb / c1) / (np.sqrt(sb / c2) + 1e-6)
    return Model((w * ratio).astype(np.float32), float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, train, per_class: int = PER_CLASS) -> tuple[list[str], list[int]]:
    """At most per_class texts of each label, by a hash of the id."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("_toxic")).where(train & F.col("_toxic").isin(0, 1))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    # The ids are few (per_class a label), so sending them to each task is bounded.
    ids = [known.where(F.col("_toxic") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    picked = docs.select("doc_id", docs["text"].cast("string").alias("_text")).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    rows = [r for k in (0, 1) for r in picked.where(F.col("_toxic") == k).orderBy(*order, "_text").limit(per_class).collect()]
    return [r._text for r in rows], [r._toxic for r in rows]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score. The table of the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = [shared.value.score(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, schema_of([docs.schema["doc_id"]], "score double"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array([shared.value.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_in(mod: int = 5, rest: int = 0):
    """Rows to train on: a known id that is not in the held-out class."""
    return F.coalesce(bucket(F.col("doc_id"), mod) != rest, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0) -> DataFrame:
    """Trains on labelled rows outside the held-out class, scores all."""
    model = fit(*training_rows(docs, labels, held_in(mod, rest)))
    return score(docs, model).select("doc_id", F.coalesce(bucket(F.col("doc_id"), mod) == rest, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
