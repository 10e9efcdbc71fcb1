"""Quality classifier: naive Bayes support vectors.

Indicators of byte n-grams (hashed) are scaled by the classes' log-count ratios, and a linear hinge-loss model is
fitted to them by dual coordinate descent. Margins become scores by a logistic curve fitted on a part of the sample
that the model did not see.

Rows: null and empty texts have no n-grams and get the score of the intercept. Rows that repeat a doc_id are scored
one by one. With fewer than two classes to learn from, every score is the share of label 1, or 0.5 without labels.
Rows with a null label, or whose text is missing, teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.common import slices, table, tidy, utf8
from gatelens.llm.langid import held_out

#: The stated bound on the labelled sample that the model is fitted to.
SAMPLE_ROWS = 12_000
DIMS = 1 << 16
SIZES = (1, 2, 3)
ALPHA = 1.0
COST = 0.5
EPOCHS = 12
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def indicators(batch: pa.RecordBatch, group: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of rows: (row in the batch, bucket) of every distinct n-gram."""
    data, off = utf8(batch.column("text"))
    for a in range(0, batch.num_rows, group):
        z = min(batch.num_rows, a + group)
        piece = data[off[a] : off[z]].astype(np.uint32)
        row = np.repeat(np.arange(z - a, dtype=np.uint32), np.diff(off[a : z + 1]))
        seen = np.zeros((z - a) * DIMS, bool)
        for n in SIZES:
            count = len(piece) - n + 1
            if count <= 0:
                break
            h = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ piece[k : k + count]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            inside = row[:count] == row[n - 1 :]
            seen[(row[:count].astype(np.int64) * DIMS + ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)))[inside]] = True
        at = np.flatnonzero(seen)
        yield a + at // DIMS, at % DIMS


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """rows: the distinct buckets of each text; labels: 0 or 1."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(DIMS), 0.0, 0.0, _logit(share))
    order = np.random.default_rng(seed).permutation(len(rows))
    apart = order[: max(2, len(rows) // 5)]
    taught = order[len(apart) :]
    if len(np.unique(labels[apart])) < 2 or len(np.unique(labels[taught])) < 2:
        apart = taught = order
    p, q = np.full(DIMS, ALPHA), np.full(DIMS, ALPHA)
    for i in taught:
        (p if labels[i] else q)[rows[i]] += 1
    n1, n0 = (labels[taught] == 1).sum(), (labels[taught] == 0).sum()
    # shares of the classes' documents, as the features are indicators
    ratio = np.log(p / (n1 + 2 * ALPHA)) - np.log(q / (n0 + 2 * ALPHA))
    y = np.where(labels == 1, 1.0, -1.0)
    values = [ratio[r] / max(1.0, float(np.linalg.norm(ratio[r]))) for r in rows]
    norm = [float(v @ v) + 1.0 for v in values]
    cost = np.where(labels == 1, COST * (n0 + n1) / (2 * n1), COST * (n0 + n1) / (2 * n0)) * 10
    w, bias, alpha = np.zeros(DIMS), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(seed + 1)
    for _ in range(EPOCHS):
        for i in draw.permutation(taught):
            r, v = rows[i], values[i]
            slack = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * v
                bias += step
    margin = np.array([w[rows[i]] @ values[i] + bias for i in apart])
    slope, shift = _platt(margin, labels[apart])
    return Model(np.stack([w * ratio, ratio * ratio]), bias, slope, shift)


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton's method, targets drawn in from 0 and 1."""
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * beta)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score_rows(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    if model.weights.ndim == 1:
        return np.full(batch.num_rows, 1 / (1 + np.exp(-model.shift)))
    total, square = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
    for row, bucket in indicators(batch):
        total += np.bincount(row, weights=model.weights[0][bucket], minlength=batch.num_rows)
        square += np.bincount(row, weights=model.weights[1][bucket], minlength=batch.num_rows)
    margin = total / np.maximum(1.0, np.sqrt(square)) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """docs: (doc_id, text); labels: (doc_id, label). At most about ``limit`` labelled rows, taken by hash of the id."""
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = labels.count()
    part = F.pmod(F.xxhash64(F.lit("nbsvm"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.select("doc_id", "text").where("text is not null").where(part < min(1.0, limit / max(1, n))).join(labels, "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [b"".join([]) for _ in range(batch.num_rows)]
            for row, bucket in indicators(batch):
                for r in np.unique(row):
                    rows[r] = bucket[row == r].astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "label", "buckets"])

    # at most limit rows of at most DIMS two-byte buckets; a usual text has some hundreds
    found = sample.mapInArrow(tidy(run), "doc_id long, label int, buckets binary").toArrow().sort_by([("doc_id", "ascending"), ("buckets", "ascending")])
    return fit([np.frombuffer(b, np.uint16).astype(np.int64) for b in found.column("buckets").to_pylist()], found.column("label").to_numpy())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_rows(model, batch))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out("doc_id", 4, 2)
    model = learn(docs.where(~out), labels.where(~out).select("doc_id", F.col("quality").alias("label")))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
