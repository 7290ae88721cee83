"""Language ID (4): error-correcting output codes over hashed byte n-grams, with loss-weighted decoding.

Each language has a codeword; for each bit a logistic model over n-gram frequencies predicts it. A text goes to the
codeword with the least loss, summed over bits with weights by the bits' accuracy; a small gap to the second flags
the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import held_out
from marketflow.llm.linear import logistic
from marketflow.llm.textarrays import LOWER, raw, slices

#: Bytes that count as parts of letters: a-z, and all bytes of longer characters; others separate words.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
FOLD = _LETTERS[LOWER]


@dataclass(frozen=True)
class LanguageConfig:
    """sample: bound on documents that the models are fitted on, shared evenly by the languages. least: documents a language
    should have in it; of more than sample / least different values of lang the most frequent ones are learned."""

    buckets: int = 4096
    sample: int = 6000
    least: int = 8
    bits: int = 15
    ambiguous: float = 0.6
    seed: int = 3


def gram_counts(column: pa.Array, buckets: int) -> Iterator[np.ndarray]:
    """Matrices of n-gram frequencies, rows in the texts' order: square roots of the counts, scaled to length 1, and a 1."""
    data, offsets = raw(column)
    for i, j in slices(offsets, rows=256):
        x = FOLD[data[offsets[i] : offsets[j]]].astype(np.uint32)
        row = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
        total = np.zeros((j - i) * buckets)
        for n in (1, 2, 3):
            if len(x) >= n:
                gram = np.full(len(x) - n + 1, n, np.uint32)
                for k in range(n):
                    gram = gram * np.uint32(257) + x[k : k + len(gram)]
                gram = (gram * np.uint32(2654435761)) >> np.uint32(12)
                same = row[: len(gram)] == row[n - 1 :]
                total += np.bincount((row[: len(gram)] * buckets + gram % np.uint32(buckets))[same], minlength=len(total))
        out = np.sqrt(total).reshape(j - i, buckets)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        yield np.hstack([out, np.ones((j - i, 1))]).astype(np.float32)


def codewords(n: int, bits: int, seed: int) -> np.ndarray:
    """n rows of +-1: every split of the languages for up to 5 of them, else the best of some random codes."""
    if n <= 5:
        found = [[1 if c == 0 or k >> (c - 1) & 1 else -1 for c in range(n)] for k in range(2 ** (n - 1) - 1)]
        return np.array(found or [[1] * n]).T
    rng = np.random.default_rng(seed)
    bits = max(bits, int(np.ceil(10 * np.log2(n))))

    def spread(code):
        apart = (bits - code @ code.T) // 2 + bits * np.eye(n, dtype=int)
        return apart.min()

    return max((rng.choice([-1, 1], (n, bits)) for _ in range(50)), key=spread)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    config: LanguageConfig

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language's number and its share of belief for each row of n-gram frequencies."""
        margin = x @ self.weights
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        belief = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        return loss.argmin(axis=1), (belief / belief.sum(axis=1, keepdims=True)).max(axis=1)


def fit(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> Model | None:
    """From text and non-null lang of the documents outside the held-out fold; None if there is none."""
    train = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequent = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, config.sample // config.least))
    counts = {r.lang: r["count"] for r in frequent.collect()}
    if not counts:
        return None
    each = config.sample // len(counts)
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, rate double")
    sample = train.join(F.broadcast(rates), "lang").where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6) < F.col("rate"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.vstack([*gram_counts(batch.column("text"), config.buckets), np.zeros((0, config.buckets + 1), np.float32)])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in found.astype(np.float16)], pa.binary())], ["lang", "x"])

    got = sample.select("text", "lang").mapInArrow(rows, "lang string, x binary").collect()
    names = sorted({r.lang for r in got})
    if not names:
        return None
    x = np.array([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32)
    y = np.array([names.index(r.lang) for r in got])
    code = codewords(len(names), config.bits, config.seed)
    target = (code[y] > 0).astype(np.float32)
    balance = (1 / np.bincount(y, minlength=len(names)))[y][:, None]
    share = np.repeat(balance / balance.sum(), code.shape[1], axis=1).astype(np.float32)
    weights = logistic(x, target, share, penalty=1e-5)
    right = np.clip((((x @ weights) > 0) == (target > 0)).mean(axis=0), 0.5, 0.999)
    trust = np.log(right / (1 - right))
    return Model(names, code, weights, (trust / trust.sum() * len(trust)) if trust.sum() else np.ones(len(trust)), config)


def has_letter(data: bytes) -> bool:
    return any(map(str.isalpha, data.decode("utf-8", "replace")))


def identify(docs: DataFrame, model: Model | None, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: a row per row of docs.

    Null texts and texts without a letter are `und` with score 0, as are all texts without a model. Rows with equal
    ids are judged one by one; columns other than doc_id and text are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column("text")
            n = len(column)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if model:
                at = 0
                for x in gram_counts(column, model.config.buckets):
                    best[at : at + len(x)], score[at : at + len(x)] = model.decode(x)
                    at += len(x)
            data, offsets = raw(column)
            plain = np.concatenate([[0], np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122))])
            letters = np.diff(plain[offsets]) > 0
            for k in np.flatnonzero(~letters):
                letters[k] = has_letter(data[offsets[k] : offsets[k + 1]].tobytes())
            known = letters & (model is not None)
            names = np.array([*(model.languages if model else []), "und"], object)
            pred = names[np.where(known, best, len(names) - 1)]
            score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(~known | (score < config.ambiguous))],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        of, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )
