"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

A text's features are its words and marks, pairs of them, and one feature for places where three
in a row stood before; each is hashed to a bucket, and a bucket's value is its share of the places.
Training follows the regularised leader, coordinate by coordinate, over a bounded sample in a task
of its own; scoring is a sparse dot product with the weights, whose size is fixed by the number of
buckets, so they are broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memory, per_document, slices

BUCKETS, SAMPLE_ROWS, EPOCHS, SCALE, THRESHOLD = 1 << 18, 12_000, 4, 8.0, 0.3
TOKENS = re.compile(r"\w+|[^\w\s]+")
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def _code(token: str) -> int:
    """64 bits of a token."""
    raw = token.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1] + b"#")


_memory = Memory(_code)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * MIX) ^ b
    x ^= x >> TURN
    return x * MIX


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """A bucket for each place of each feature; none for a null or empty text."""
    tokens = TOKENS.findall(text) if text else []
    if not tokens:
        return np.zeros(0, np.int64)
    _memory.begin(400_000)
    h = np.fromiter(map(_memory.__getitem__, tokens), np.uint64, len(tokens))
    parts = [h * MIX]
    if len(h) > 1:
        pairs = mixed(h[:-1], h[1:])
        parts.append(pairs)
        if len(h) > 2:
            triples = np.sort(mixed(pairs[:-1], h[2:]))
            again = int((triples[1:] == triples[:-1]).sum())
            if again:
                parts.append(np.zeros(again, np.uint64))
    return (np.concatenate(parts) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2 penalties; index `buckets` is the bias."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = 0.5, beta: float = 0.2, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def example(places: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values, the bias last."""
    at, counts = np.unique(places, return_counts=True)
    return np.append(at, buckets), np.append(SCALE * counts / max(1, len(places)), 1.0)


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    model = Ftrl(buckets)
    for _ in range(epochs):
        for at, values, label in examples:
            model.learn(at, values, label)
    return model.weights().astype(np.float32)


def score(weights: np.ndarray, text: str | None) -> float:
    buckets = len(weights) - 1
    places = features(text, buckets)
    total = weights[buckets] + (SCALE * float(weights[places].sum()) / len(places) if len(places) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(total, -35.0, 35.0))))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> np.ndarray:
    """Weights from at most `sample_rows` labelled rows outside the held-out fold, chosen by hash of the id.

    Rows with a null label, id or text teach nothing. Without rows all weights are 0, which scores 0.5.
    """
    order = F.xxhash64("doc_id")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.orderBy(order, "doc_id", "y").limit(sample_rows)
    # The sample's bound is what makes this side small enough to broadcast and its texts fit one task.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    ordered = texts.repartition(1).sortWithinPartitions(order, "doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in slices(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, values = example(features(text, buckets), buckets)
                examples.append((at.astype(np.int32), values.astype(np.float32), y))
        data = fit(examples, buckets).tobytes() if examples else b""
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["weights"])

    rows = ordered.select("text", "y").mapInArrow(run, "weights binary").collect()
    data = next((bytes(r[0]) for r in rows if r[0]), b"")
    return np.frombuffer(data, np.float32) if data else np.zeros(buckets + 1, np.float32)


def _score(weights, texts: list) -> dict:
    scores = [score(weights.value, t) for t in texts]
    return {"score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.3 on) of each whole text.

    Null and empty texts get the bias alone. Repeated rows are scored each; an empty table gives no
    rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return per_document(base, partial(_score, shared), "score double, predicted int", ("doc_id", "held_out"))
