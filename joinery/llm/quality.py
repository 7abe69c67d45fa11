"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters and digits or of other marks, in lower case; the
features of a text are its words and pairs of neighbours, hashed into a fixed
number of bins, each worth its share of all features. The model is fitted by one
task on a bounded sample of labelled rows, one example at a time (FTRL-proximal
with per-coordinate steps). Scoring sums the weights of a text's
features where the text is and moves nothing.

Null and empty texts, or texts of white space, have no feature: their score is
that of the intercept. Null ids are scored, never learned from, and not held
out. Null labels do not count, repeated equal labels of a document count once, and
a document with both labels is not learned from. Of several texts of one id, that
with the smallest hash is learned from. With no label of one kind all scores lean
to the other; with none they are 0.5.
Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, texts

BINS = 1 << 18
#: Labelled rows that the model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 6000
WORD = re.compile(r"\w+|[^\w\s]+")
SCALE = 16.0
PAIR = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: those whose crc32(id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def features(docs: list[str], bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the words and word pairs of all texts, end to end, and how many each text has."""
    words = [WORD.findall(t.lower()) for t in docs]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for own in words for w in own]
    if not flat:
        return np.zeros(0, np.int64), n
    h = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    pair = (h[:-1] * PAIR) ^ h[1:]
    pair ^= pair >> np.uint64(29)
    first = np.cumsum(n) - n
    inside = np.ones(len(h), bool)
    inside[first[(first > 0) & (n > 0)] - 1] = False  # the pair that begins at a text's last word ends in another
    inside[-1] = False
    both = np.empty(len(h) + int(inside.sum()), np.int64)
    count = 1 + inside.astype(np.int64)
    at = np.cumsum(count) - count
    both[at] = (h % np.uint64(bins)).astype(np.int64)
    both[at[inside] + 1] = (pair[inside[:-1]] % np.uint64(bins)).astype(np.int64)
    return both, np.where(n > 0, 2 * n - 1, 0)


class FTRL:
    """Logistic regression by FTRL-proximal; ``bins`` weights and an intercept at the end."""

    def __init__(self, bins: int = BINS, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(bins + 1), np.zeros(bins + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
        g = (p - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], bins: int = BINS, passes: int = 4, seed: int = 7) -> np.ndarray:
    """Weights from (label, distinct bins of a text's features, their counts)."""
    model, order = FTRL(bins), np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(examples)):
            label, at, count = examples[i]
            model.learn(np.append(at, bins).astype(np.int64), np.append(SCALE * count / max(1, count.sum()), 1.0), label)
    return model.weights()


def counted(bins: np.ndarray) -> bytes:
    """Distinct bins and their counts as 32-bit integers: no more than ``BINS`` pairs however long the text."""
    at, count = np.unique(bins, return_counts=True)
    return np.stack([at, np.minimum(count, 0xFFFFFFFF)]).astype("<u4").tobytes()


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``doc_id, label, bins`` (see ``counted``) of at most ``most`` labelled documents that are not held out, those with the smallest hashes of their ids.

    A document with both labels is left out; of the texts of one id, that with the smallest hash counts.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("high")).filter("label = high").drop("high")
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch):
                bins, n = features(texts(some))
                each = [counted(x) for x in np.split(bins, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("label"), some.column("mark"), pa.array(each, pa.binary())], names=["doc_id", "label", "mark", "bins"])

    rows = own.mapInArrow(run, "doc_id long, label int, mark long, bins binary")
    return rows.groupBy("doc_id", "label").agg(F.min(F.struct("mark", "bins")).alias("r")).select("doc_id", "label", "r.bins")


def fitted(examples: DataFrame) -> np.ndarray:
    """Weights of the model, fitted by one task on the bounded sample ``examples``; only they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "bins")))]
        rows.sort(key=lambda r: r[:2])
        weights = fit([(label, *np.frombuffer(raw, "<u4").reshape(2, -1)) for _, label, raw in rows])
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary())], names=["weights"])

    got = examples.coalesce(1).mapInArrow(run, "weights binary").first()
    return np.frombuffer(got["weights"], "<f4") if got else np.zeros(BINS + 1, "<f4")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = SAMPLE, whole: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (doc_id, text); with ``whole``, the row itself goes along as the struct ``row``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fitted(labelled(docs, labels, most)))  # BINS + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for some in by_bytes(batch):
                bins, n = features(texts(some))
                total = np.zeros(len(n))
                if len(bins):  # each text is summed by itself, so that its score does not depend on its neighbours
                    total[n > 0] = np.add.reduceat(w[bins].astype(np.float64), (np.cumsum(n) - n)[n > 0])
                margin = SCALE * total / np.maximum(n, 1) + w[-1]
                score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                yield scored(some, {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    rows = with_row(docs, whole)
    return rows.mapInArrow(run, scored_schema(rows, "score double, predicted int"))


def with_row(docs: DataFrame, whole: bool) -> DataFrame:
    """``doc_id, held_out, text`` and, if ``whole``, all columns as the struct ``row``, so that none can clash with what is added."""
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * whole
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", *row)


def scored_schema(rows: DataFrame, more: str) -> T.StructType:
    """The schema of ``rows`` without the text and with more columns, which can be null."""
    return T.StructType([f for f in rows.schema if f.name != "text"] + T.StructType.fromDDL(more).fields)


def scored(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without its text and with more columns."""
    kept = {n: batch.column(n) for n in batch.schema.names if n != "text"} | more
    return pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))
