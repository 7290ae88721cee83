"""Quality classifier (2): positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are training documents labelled 1, unlabelled are training documents without a label. The class
prior is estimated from the scores of positive-against-unlabelled models, each on the half of the sample that it has not
seen; copies share a half. Features are taken from the text alone: frequencies of trigrams of character classes, and shares of repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import train_fold
from marketflow.llm.common import held_out as held_out_fold
from marketflow.llm.linear import class_prior, logistic, non_negative_pu, sigmoid
from marketflow.llm.textarrays import Hashes, mix, raw, slices, word_spans

#: A class for lower case, upper case, digits and bytes of longer characters; every other byte is its own class.
CLASSES = np.arange(256, dtype=np.uint32)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 1, 2, 3, 4


@dataclass(frozen=True)
class QualityConfig:
    """positives, unlabelled: bounds on the documents of either kind that the model is fitted on (lowest hash of id first). least: rows of either kind that a model needs."""

    buckets: int = 2048
    positives: int = 5000
    unlabelled: int = 8000
    least: int = 4


def features(column: pa.Array, buckets: int) -> Iterator[np.ndarray]:
    """Matrices of buckets + 6 columns, rows in the texts' order; an empty text has zeros and the constant."""
    data, offsets = raw(column)
    for i, j in slices(offsets, rows=256):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        x, n = CLASSES[part], np.diff(at)
        row = np.repeat(np.arange(j - i), n)
        gram = (x[:-2] * np.uint32(65599) + x[1:-1]) * np.uint32(65599) + x[2:] if len(x) > 2 else x[:0]
        gram = ((gram * np.uint32(2654435761)) >> np.uint32(10)) % np.uint32(buckets)
        same = row[: len(gram)] == row[2:]
        counts = np.bincount((row[: len(gram)] * buckets + gram)[same], minlength=(j - i) * buckets).reshape(j - i, buckets)
        grams = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        starts, ends, first = word_spans(part, at)
        words = Hashes(part).of(starts, ends)
        pairs = mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
        shape = np.zeros((j - i, 6))
        for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            m = b - a
            if m:
                shape[k, :4] = 1 - len(np.unique(words[a:b])) / m, 1 - len(np.unique(pairs[a : b - 1])) / max(m - 1, 1), np.log1p(m) / 10, (n[k] - m) / m / 10
        shape[:, 4] = n == 0
        shape[:, 5] = 1
        yield np.hstack([grams, shape]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> tuple[np.ndarray, float] | None:
    """Weights and the estimated class prior, from the training fold only; None without positives or other documents.

    Where nearly every document has a label, the rows that are not labelled 1 are the unlabelled ones, as are the labels.
    """
    by_hash = lambda ids, n: ids.where(train_fold(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    positive = labels.where("quality = 1").select("doc_id")
    good = by_hash(positive, config.positives).withColumn("role", F.lit(1))
    rest = by_hash(docs.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti"), config.unlabelled)
    if rest.count() < config.least:
        rest = by_hash(docs.select("doc_id").join(positive, "doc_id", "left_anti"), config.unlabelled)
    rest = rest.withColumn("role", F.lit(0))
    sample = docs.select("doc_id", "text").join(F.broadcast(good.unionByName(rest)), "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.vstack([*features(batch.column("text"), config.buckets), np.zeros((0, config.buckets + 6), np.float32)])
            yield pa.RecordBatch.from_arrays([batch.column("role"), pa.array([r.tobytes() for r in found.astype(np.float16)], pa.binary())], ["role", "x"])

    got = sample.select("role", "text").mapInArrow(rows, "role int, x binary").collect()
    got.sort(key=lambda r: (zlib.crc32(r.x), r.x))  # rows come in any order; equal ones are neighbours
    p, u = (np.array([np.frombuffer(r.x, np.float16) for r in got if r.role == k]).astype(np.float32) for k in (1, 0))
    if len(p) < config.least or len(u) < config.least:
        return None
    prior = estimated_prior(p, u)
    return non_negative_pu(p, u, prior), prior


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled rows u, by two halves of all rows that judge each other; equal rows
    must be neighbours."""
    halves = [(p[: len(p) // 2], u[: len(u) // 2]), (p[len(p) // 2 :], u[len(u) // 2 :])]
    scores: list[list[np.ndarray]] = [[], []]
    for (mine, others), (far, far_others) in zip(halves, halves[::-1], strict=True):
        y = np.repeat([[1.0], [0.0]], [len(mine), len(others)], axis=0).astype(np.float32)
        share = (np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())).astype(np.float32)
        probe = logistic(np.vstack([mine, others]), y, share, steps=100)[:, 0]
        scores[0].append(far @ probe)
        scores[1].append(far_others @ probe)
    return class_prior(*(np.concatenate(s) for s in scores))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of docs.

    Null texts count as empty ones, which have a score too. Without a model every score is 0.5. Rows with equal ids
    are scored one by one; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model[0] if model else None)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            z = np.zeros(len(batch))
            if weights is not None and len(batch):
                z = np.concatenate([x @ weights for x in features(batch.column("text"), config.buckets)])
            s = sigmoid(z.astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), "text").mapInArrow(of, "doc_id long, held_out boolean, score double, predicted int")
