"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

Every coordinate has its own learning rate, and L1 keeps the weights of most at exactly zero, so that what is broadcast
for scoring is a short list of (feature, weight). Scoring sums the weights of a text's distinct features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmotif.llm.memory import release
from trackmotif.llm.words import BASE, lettered, mix
from trackmotif.session import ship_package

BITS = 20
#: Rows of which the model is fitted at most, those of the smallest hash of doc_id; passes over them.
MAX_TRAIN, EPOCHS = 16_000, 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.5
THRESHOLD = 0.3


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed words, pairs of neighbours and pairs with one word between, with repetitions."""
    h = lettered(text).hashes
    parts = [mix(h)]
    for gap in (1, 2):
        if len(h) > gap:
            parts.append(mix(h[:-gap] * BASE + h[gap:] + np.uint64(gap)))
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for 0/1 features; coordinate 2 ** bits is the bias, which has no L1."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bias, self.alpha, self.beta, self.l1, self.l2 = 1 << bits, alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, found: np.ndarray, label: int) -> None:
        at = np.append(found, self.bias)
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, bits: int = BITS, **settings: float) -> dict[int, float]:
    """Weights other than zero, after passes over (distinct features, label)."""
    model = Ftrl(bits, **settings)
    for _ in range(epochs):
        for found, label in rows:
            model.learn(found, label)
    at = np.append(np.flatnonzero(np.abs(model.z[:-1]) > model.l1), model.bias)
    return dict(zip(at.tolist(), model.weights(at).tolist(), strict=True))


def score(found: np.ndarray, weights: np.ndarray) -> float:
    """Of features with repetitions; ``weights`` has the bias last."""
    w = weights[found]
    used = np.unique(found[w != 0])
    return _sigmoid(weights[used].sum() + weights[-1])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that the model never learns from: crc32 of the identifier as text leaves 2 when divided by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_TRAIN, bits: int = BITS) -> np.ndarray:
    """Dense weights (bias last) learnt from at most ``limit`` labelled rows that are not held out.

    The labelled identifiers that are taken (bounded by ``limit``) are broadcast; their texts' features meet in one task,
    which sends back the weights that are not zero. Of an identifier's labels the largest counts; of its rows, that with
    the smallest text's hash. Null labels and identifiers are left out; without rows of both labels the weights are the
    bias alone.
    """
    spark = docs.sparkSession
    ship_package(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    taken = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "x.text", "label")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(t.as_py(), bits)).astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["doc_id", "found", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
            got = fit([(np.frombuffer(found, "<i4"), label) for _, found, label in rows], bits=bits)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.float64())], names=["at", "weight"])
        del rows
        release()

    prepared = rows.mapInArrow(prepare, "doc_id long, found binary, label int")
    weights = np.zeros((1 << bits) + 1)
    for r in prepared.repartition(1).mapInArrow(learn, "at long, weight double").collect():
        weights[r.at] = r.weight
    return weights


DIGEST = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_TRAIN, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row, from its text alone.

    Null and empty texts get the bias' score; a null doc_id is not held out; repeated rows give repeated rows; other
    columns are left out.
    """
    weights = train(docs, labels, limit=limit, bits=bits)
    at = np.flatnonzero(weights)
    sparse = docs.sparkSession.sparkContext.broadcast((at, weights[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << bits) + 1)
        dense[sparse.value[0]] = sparse.value[1]
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
        for batch in batches:
            scores = [score(features(t.as_py(), bits), dense) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())], schema=schema)
        release()

    return docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")).mapInArrow(run, DIGEST)
