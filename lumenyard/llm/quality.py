"""Quality classifier with Naive Bayes support vectors.

Features are hashed n-gram indicators (one and two tokens) of words and of word shapes, and whether one
word stands in a row. Each is scaled by
the log ratio of its rates in the two classes, each document to unit length, and a linear hinge-loss model
is fitted by dual coordinate descent on a sample of labelled documents of bounded size. Margins become
probabilities by a logistic fit on margins of held-out parts of that sample.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blobs, filtered, map_batches

SAMPLE = 4000  # labelled documents that the model is fitted on, half of them of either class where there are as many
BUCKETS = 1 << 18  # hash buckets of each kind of feature
KINDS = 4  # words, pairs of words, shapes, pairs of shapes; one bucket each for runs of a repeated word follows
RUNS = (2, 3, 5, 8)  # lengths of such runs
SIZE = KINDS * BUCKETS + len(RUNS)
SMOOTHING = 1.0
CLEAR = 3.0  # standard errors by which a feature's shares must differ to count
COST = 1.0
EPOCHS = 10
PARTS = 3  # of the sample, for the logistic fit
THRESHOLD = 0.3
#: A-Z to A, a-z and all that is not ASCII to a, digits to 0.
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def features(text: bytes) -> np.ndarray:
    """The sorted distinct features of a whole text."""
    out = []
    raw = np.frombuffer(text.translate(SHAPE), dtype=np.uint8)
    runs = raw[np.append(True, raw[1:] != raw[:-1])].tobytes() if len(raw) else b""
    for kind, tokens in ((0, text.lower().split()), (2, runs.split())):
        h = np.fromiter(map(zlib.crc32, tokens), dtype=np.uint64, count=len(tokens))
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
        out += [h % BUCKETS + kind * BUCKETS, pair % BUCKETS + (kind + 1) * BUCKETS]
        if kind == 0 and len(h):
            ends = np.append(np.flatnonzero(h[1:] != h[:-1]), len(h) - 1)
            longest = np.diff(ends, prepend=-1).max()
            out.append(np.array([KINDS * BUCKETS + k for k, n in enumerate(RUNS) if longest >= n], dtype=np.uint64))
    return np.unique(np.concatenate(out)).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Smoothed share of documents that have a feature, in class 1 over class 0, as a logarithm.

    Shares of documents, not of all features counted: what both classes have alike says nothing then,
    though one class has longer texts. Differences that chance explains count as none: passages that
    many documents share would else speak for the class that happens to have a few more of them.
    """
    n = np.full((2, SIZE), SMOOTHING)
    for x, y in zip(rows, labels):
        n[int(y), x] += 1
    of = np.array([(labels <= 0).sum(), (labels > 0).sum()]) + 2 * SMOOTHING
    rate = n / of[:, None]
    mean = n.sum(axis=0) / of.sum()
    error = np.sqrt(mean * (1 - mean) * (1 / of).sum())
    return np.where(np.abs(rate[1] - rate[0]) >= CLEAR * error, np.log(rate[1] / rate[0]), 0).astype(np.float32)


def coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and a bias, by dual coordinate descent on the hinge loss.

    Classes weigh alike: the cost of a row is shared out by the size of its class.
    """
    values = [ratio[x] for x in rows]
    values = [v / max(1e-9, float(np.sqrt(v @ v))) for v in values]
    y = np.where(labels > 0, 1.0, -1.0)
    most = cost * len(y) / 2 / np.where(labels > 0, max(1, (labels > 0).sum()), max(1, (labels <= 0).sum()))
    weights, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            x, v = rows[i], values[i]
            slope = y[i] * (weights[x] @ v + bias) - 1
            to = min(max(alpha[i] - slope / 2, 0.0), most[i])  # each row has length 1, and 1 for the bias
            if to != alpha[i]:
                step = (to - alpha[i]) * y[i]
                weights[x] += step * v
                bias += step
                alpha[i] = to
    return weights, bias


def margin(x: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float) -> float:
    v = ratio[x]
    return float(weights[x] @ v) / max(1e-9, float(np.sqrt(v @ v))) + bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of class 1, by Newton's method on smoothed targets."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margins, d.sum()])
        h = np.array([[w @ margins**2, w @ margins], [w @ margins, w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    """product: weight times ratio of each feature; ratio gives the length that a document is scaled by."""

    product: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float
    prior: float

    def score(self, x: np.ndarray) -> float:
        if not len(x) or not self.slope:
            return self.prior
        v = self.ratio[x]
        m = float(self.product[x].sum()) / max(1e-9, float(np.sqrt(v @ v))) + self.bias
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, self.slope * m + self.offset)))))


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    """A model of the sample; with one class or none, its prior is the only score."""
    if len(set((labels > 0).tolist())) < 2:
        none = np.zeros(0, dtype=np.float32)
        return Model(none, none, 0.0, 0.0, 0.0, prior)
    part = np.arange(len(rows)) % PARTS
    margins = np.zeros(len(rows))
    for k in range(PARTS):
        own, rest = np.flatnonzero(part == k), np.flatnonzero(part != k)
        kept = [rows[i] for i in rest]
        ratio = log_count_ratios(kept, labels[rest])
        weights, bias = coordinate_descent(kept, ratio, labels[rest])
        margins[own] = [margin(rows[i], ratio, weights, bias) for i in own]
    slope, offset = logistic(margins, labels)
    ratio = log_count_ratios(rows, labels)
    weights, bias = coordinate_descent(rows, ratio, labels)
    return Model((weights * ratio).astype(np.float32), ratio, bias, slope, offset, prior)


def learn(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> Model:
    """A model of quality (1 or 0) from labels' rows that the condition on doc_id keeps; nulls teach nothing.

    The sample takes the ids whose hash is smallest, at most half of it from either class. Labels
    without a document count for nothing. The prior is the share of class 1 among all labels kept.
    """
    own = labels.select("doc_id", "quality").dropna().filter(training)
    share = own.agg(F.avg("quality").alias("p")).first()["p"]
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.col("doc_id")]
    drawn = [own.filter(F.col("quality") == k).orderBy(*order).limit(sample // 2) for k in (0, 1)]
    ids = drawn[0].unionByName(drawn[1]).dropDuplicates(["doc_id"])
    # bounded by the sample's size
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def compute(batch: pa.RecordBatch) -> list:
        return [pa.array([features(b) for b in blobs(batch)], pa.list_(pa.int32()))]

    found = map_batches(texts, [("features", "array<int>")], compute).select("doc_id", "quality", "features").toArrow()
    by = np.argsort([zlib.crc32(str(i).encode()) for i in found["doc_id"].to_pylist()], kind="stable") if len(found) else []
    lists = found["features"].combine_chunks()
    rows = [np.asarray(lists[int(i)].values, dtype=np.int64) for i in by]
    quality = np.array(found["quality"].to_pylist(), dtype=np.int64)[by] if len(found) else np.zeros(0, np.int64)
    return fit(rows, quality, 0.5 if share is None else float(share))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score, from 0 to 1, for every whole text; null and empty texts have the prior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list:
        own = shared.value
        return [pa.array([own.score(features(b)) for b in blobs(batch)], pa.float64())]

    return map_batches(docs, [("quality_score", "double")], compute)


def good_enough(docs: DataFrame, labels: DataFrame, training: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their own columns, whose score reaches the threshold."""
    model = learn(docs, labels, training)
    return filtered(docs, ["quality_score"], lambda d: classify(d, model), F.col("quality_score") >= threshold)
