"""Bootstrap over rows: each row weighs what a Poisson draw by the hash of (replicate, row) gives it, in every replicate at once.

Rows are dealt out by ranges of (score, key) and sorted there, once. A task takes its rows in order with an array of weights for each, and
returns three numbers a replicate, positives, negatives and pairs in order, for its first score, its last and all between; scores
that go on in the next range meet again, and all are put together in order. So no table of replicates x rows is ever made, a score that a third
of the rows share is spread over tasks, and equal scores count half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cumulative probabilities of a Poisson draw of mean 1.
STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_MASK = np.uint64(0xFFFFFFFF)


def draws(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson weights, rows x replicates, by a 32-bit hash of seed, replicate and key (the lower 32 bits)."""
    r = np.arange(1, replicates + 1, dtype=np.uint64)
    x = ((keys.astype(np.uint64) & _MASK) * np.uint64(2654435761))[:, None] + (r * np.uint64(2246822519) + np.uint64(seed))[None, :]
    x &= _MASK
    x = (x ^ (x >> np.uint64(16))) * np.uint64(2246822507) & _MASK
    x = (x ^ (x >> np.uint64(13))) * np.uint64(3266489909) & _MASK
    x ^= x >> np.uint64(16)
    return np.searchsorted(STEPS, (x.astype(np.float64) + 0.5) / 4294967296.0, "right").astype(np.float64)


def replicate_auc(rows: DataFrame, key: str, score: str, label: str, replicates: int = 200, seed: int = 0, rows_at_once: int = 4096) -> DataFrame:
    """replicate, positives, negatives, auc (null without both classes), balanced_accuracy of scores above 0.5. Rows without key, score or label are left out.

    key: whole numbers; rows of one key are drawn together.
    """
    x = rows.where(F.col(key).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    x = x.select(F.col(key).cast("long").alias("key"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label"))
    ranged = x.repartitionByRange("score", "key").sortWithinPartitions("score", "key")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = lambda: np.zeros(replicates)
        hits, edges = [zero(), zero()], []  # edges: (score, positives, negatives) of the first and the last score
        inner, pos, neg, pairs = None, zero(), zero(), zero()  # of the scores between
        last, open_pos, open_neg = None, zero(), zero()
        for batch in batches:
            keys, scores, labels = (batch.column(c).to_numpy() for c in ("key", "score", "label"))
            for i in range(0, len(keys), rows_at_once):
                w, s, y = draws(keys[i : i + rows_at_once], replicates, seed), scores[i : i + rows_at_once], labels[i : i + rows_at_once] > 0
                for k, own in enumerate((~y, y)):
                    hits[k] += w[own & ((s > 0.5) == bool(k))].sum(axis=0)
                at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                p, n, names = np.add.reduceat(w * y[:, None], at), np.add.reduceat(w * ~y[:, None], at), s[at]
                if s[0] == last:
                    p[0], n[0] = p[0] + open_pos, n[0] + open_neg
                elif last is not None:
                    p, n, names = np.vstack([open_pos, p]), np.vstack([open_neg, n]), np.append(last, names)
                last, open_pos, open_neg = names[-1], p[-1], n[-1]
                p, n, names = p[:-1], n[:-1], names[:-1]
                if len(names) and not edges:
                    edges.append((names[0], p[0], n[0]))
                    p, n, names = p[1:], n[1:], names[1:]
                if len(names):
                    inner = float(names[0]) if inner is None else inner
                    below = neg + np.cumsum(n, axis=0) - n
                    pairs = pairs + (p * (below + n / 2)).sum(axis=0)
                    pos, neg = pos + p.sum(axis=0), neg + n.sum(axis=0)
        if last is not None:
            edges.append((last, open_pos, open_neg))
        found = [(float(name), True, p, n, zero(), *(hits if not k else (zero(), zero()))) for k, (name, p, n) in enumerate(edges)]
        if inner is not None:
            found.append((inner, False, pos, neg, pairs, zero(), zero()))
        for name, edge, *v in found:
            columns = [pa.array(np.arange(1, replicates + 1)), pa.array(np.full(replicates, name)), pa.array(np.full(replicates, edge)), *map(pa.array, v)]
            yield pa.RecordBatch.from_arrays(columns, ["replicate", "at", "edge", "pos", "neg", "pairs", "hits_0", "hits_1"])

    sums = [F.sum(c).alias(c) for c in ("pos", "neg", "pairs", "hits_0", "hits_1")]
    parts = ranged.mapInArrow(of, "replicate long, at double, edge boolean, pos double, neg double, pairs double, hits_0 double, hits_1 double").groupBy("replicate", "at", "edge").agg(*sums)
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("replicate").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # three rows a task
    equal = F.when(F.col("edge"), F.col("pos") * F.col("neg") / 2).otherwise(0.0)
    whole = parts.withColumn("pairs", F.col("pairs") + equal + F.col("pos") * below).groupBy("replicate").agg(*sums)
    some = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return whole.select("replicate", F.col("pos").cast("long").alias("positives"), F.col("neg").cast("long").alias("negatives"), (F.col("pairs") / (some("pos") * some("neg"))).alias("auc"), ((F.col("hits_0") / some("neg") + F.col("hits_1") / some("pos")) / 2).alias("balanced_accuracy"))


def interval(replicates: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """metric, low, high, mean over the replicates that have it, and n of them."""
    long = replicates.selectExpr(f"stack({len(columns)}, {', '.join(f'{c!r}, {c}' for c in columns)}) as (metric, value)")
    return long.groupBy("metric").agg(F.percentile("value", (1 - share) / 2).alias("low"), F.percentile("value", (1 + share) / 2).alias("high"), F.avg("value").alias("mean"), F.count("value").alias("n"))


def tiers(found: DataFrame, chance: float = 0.5, strong: float = 0.55) -> DataFrame:
    """found with tier: whether an interval lies above `strong`, above chance, around it or below it."""
    tier = F.when(F.col("low") > strong, "STRONG").when(F.col("low") > chance, "ABOVE_CHANCE").when(F.col("high") < chance, "BELOW_CHANCE").otherwise("INDISTINGUISHABLE")
    return found.withColumn("tier", F.when(F.col("low").isNotNull(), tier).otherwise("NO_DATA"))
