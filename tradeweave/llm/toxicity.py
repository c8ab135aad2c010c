"""Toxicity: linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, labelled_sample, map_batches, read, scores, sigmoid, split_of, texts_of

SIZES = (4, 5, 6)  # n-gram lengths in bytes
BITS = 20  # hashed features: 2 ** BITS
#: Labelled rows that the classifier learns from, at most of each label.
SAMPLE = 6000
FEATURES = 5000  # n-grams kept, at most: those whose ratio is least likely by chance
STRENGTH = 3.5  # standard errors that the ratio of a kept n-gram is from 0, at least
SHRINK = 1.0
STEPS, PENALTY = 400, 2e-3


PART = 1 << 18  # bytes of a text that are hashed at once


def present(text: bytes, kept: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed n-grams of the lower-cased text, of those kept only where given; a blank stands before and after.

    Parts of the text, which overlap, are hashed one at a time.
    """
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    out = [np.zeros(0, np.int32)]
    for at in range(0, len(b), PART):
        part = b[at : at + PART + max(SIZES) - 1].astype(np.uint64)
        for n in SIZES:
            if len(part) < n:
                continue
            h = np.zeros(len(part) - n + 1, np.uint64)
            for i in range(n):
                h = (h << np.uint64(8)) | part[i : len(part) - n + 1 + i]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h = (h >> np.uint64(64 - BITS)).astype(np.int32)
            out.append(np.unique(h if kept is None else h[kept[h]]))
    return np.unique(np.concatenate(out))


class Model:
    """weights: by hashed n-gram, 0 where not kept; the score is a sigmoid."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.kept = weights.astype(np.float32), bias, weights != 0

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = [float(self.weights[present(t, self.kept)].sum()) if t else 0.0 for t in texts]
        return sigmoid(np.array(x, np.float64) + self.bias)

    def column(self, text: str) -> Column:
        return scores(self.score, text)


def _counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each n-gram and texts, by label, summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for b in batches:
            for t, y in zip(binaries(b, "text"), b.column("y").to_pylist(), strict=True):
                n[y, present(t or b"")] += 1
                size[y] += 1
        if size.sum():
            at = np.flatnonzero(n.sum(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), n[0, at], n[1, at], size)], names=["at", "n0", "n1", "size"]
            )

    n, size = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in train.mapInArrow(run, "at binary, n0 binary, n1 binary, size binary").toLocalIterator():
        at = np.frombuffer(r["at"], np.int32)
        n[0, at] += np.frombuffer(r["n0"], np.int32)
        n[1, at] += np.frombuffer(r["n1"], np.int32)
        size += np.frombuffer(r["size"], np.int64)
    return n, size


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learns from at most SAMPLE labelled rows of each label.

    docs: doc_id, text; labels: doc_id and the label, 0 or 1 (other values and
    null are left out). Log-count ratios of the n-grams present scale the
    features, and a linear classifier with a logistic loss is fitted to them.
    Without rows of both labels all scores are the share of label 1, or 0.
    """
    train = labelled_sample(docs, labels, label, SAMPLE)
    n, size = _counts(train)
    if not size.all():  # one label alone, or none
        w = np.zeros(1 << BITS)
        return Model(w, float(np.log(1e-6)) if not size[1] else float(np.log(1e6)))
    p, q = n[1] + SHRINK, n[0] + SHRINK
    ratio = np.log(p / (size[1] + 2 * SHRINK)) - np.log(q / (size[0] + 2 * SHRINK))
    strength = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    strength[n.sum(0) < 3] = 0
    top = np.argsort(-strength, kind="stable")[:FEATURES]
    top = np.sort(top[strength[top] > STRENGTH])
    kept = np.zeros(1 << BITS, bool)
    kept[top] = True
    number = np.cumsum(kept) - 1
    sent = docs.sparkSession.sparkContext.broadcast((kept, number.astype(np.int32)))

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        kept, number = sent.value
        rows = [number[present(t or b"", kept)].astype(np.int16 if len(top) < 32768 else np.int32).tobytes() for t in binaries(batch, "text")]
        return {"y": batch.column("y"), "x": pa.array(rows, pa.binary())}

    kind = np.int16 if len(top) < 32768 else np.int32
    rows = map_batches(train.select("y", "text"), run, "y int, x binary").collect()  # at most 2 * SAMPLE rows of kept features
    target = np.array([r["y"] for r in rows], np.float64)
    cols = [np.frombuffer(r["x"], kind) for r in rows]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate([*cols, np.zeros(0, kind)]).astype(np.int64)
    r = ratio[top]
    v, bias = np.zeros(len(top)), float(np.log(size[1] / size[0]))
    velocity, vb = np.zeros_like(v), 0.0
    scale = 1 / max(1.0, float(np.bincount(row, r[col] ** 2, len(cols)).max()) ** 0.5)
    for _ in range(STEPS):  # accelerated gradient steps with a light penalty
        look, lb = v + 0.9 * velocity, bias + 0.9 * vb
        g = target - sigmoid(np.bincount(row, (r * look)[col], len(cols)) + lb)
        velocity = 0.9 * velocity + scale * (r * np.bincount(col, g[row], len(top)) / len(cols) ** 0.5 - PENALTY * look)
        vb = 0.9 * vb + 0.5 * g.mean()
        v, bias = v + velocity, bias + vb
    weights = np.zeros(1 << BITS)
    weights[top] = r * v
    return Model(weights, bias)


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row of docs.

    Null and empty texts score as texts without n-grams. Very long texts are
    read whole. Repeated rows return as often as they occur. Other columns of
    docs are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id"), "score": model.score([t or b"" for t in binaries(batch, "text")])}

    scored = map_batches(texts_of(docs), run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4(spark: SparkSession, sf_dir: str, modulus: int = 4, held: int = 2) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = split_of("doc_id", modulus) == held
    model = fit(docs.where(~out), labels)
    return score_texts(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")
