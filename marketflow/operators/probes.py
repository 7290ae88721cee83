"""Many small linear probes fitted together: standardise, reduce, logistic regression, for every cell and fold at once.

Nothing is fitted inside one group. Each pass over the rows adds up what all models need of them - sums, centred cross
products, then gradient, Hessian and loss of Newton's method - as one small array for each model and task, which Spark adds by
model. A cell may hold any number of rows; the driver holds one vector for each model, whose number is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.sources.shared import written


@dataclass(frozen=True)
class ProbeConfig:
    """reduce: "pca", "random" (projection), "none", or "majority" (no model but the larger class of the training rows). size: components kept.
    c: inverse strength of the penalty on weights. balanced: classes weigh the same. rounds: most Newton passes. models: most models fitted at once."""

    reduce: str = "pca"
    size: int = 20
    c: float = 1.0
    balanced: bool = False
    seed: int = 42
    tolerance: float = 1e-9
    rounds: int = 60
    models: int = 20_000


@dataclass
class Model:
    """score = sigmoid(bias + weights . basis' ((x - mean) / scale)), or the constant."""

    mean: np.ndarray
    scale: np.ndarray | None = None
    basis: np.ndarray | None = None
    weights: np.ndarray | None = None
    class_weights: tuple[float, float] = (1.0, 1.0)
    constant: float | None = None

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        z = z if self.basis is None else z @ self.basis
        return np.hstack([np.ones((len(z), 1)), z])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.design(x) @ self.weights)


Key = tuple[str, int]


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def prepared(rows: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """The rows that can be used, as a table: cell, by, key, x, y, train, test. Rows whose x is null or holds a null or a value that is not finite, or whose y is null, are left out."""
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x = rows.where(F.col("y").isNotNull() & F.coalesce(sound, F.lit(False)))
    own = [F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("train", "test")]
    return written(x.select(F.to_json(F.struct(*by)).alias("cell"), *by, *key, F.transform("x", lambda v: v.cast("double")).alias("x"), F.col("y").cast("int").alias("y"), *own))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _groups(batch: pa.RecordBatch, role: str) -> Iterator[tuple[Key, np.ndarray]]:
    """The rows of a batch that have the role, for each cell and fold."""
    cells, folds = batch.column("cell").dictionary_encode(), batch.column(role)
    at = np.repeat(np.arange(len(batch)), folds.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    fold, code = folds.flatten().to_numpy(zero_copy_only=False), cells.indices.to_numpy(zero_copy_only=False)[at]
    order = np.lexsort((at, fold, code))
    at, fold, code = at[order], fold[order], code[order]
    if not len(at):
        return
    edges = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (fold[1:] != fold[:-1])))
    for a, b in zip(edges, np.append(edges[1:], len(at)), strict=True):
        yield (cells.dictionary[int(code[a])].as_py(), int(fold[a])), at[a:b]


SUMS = "cell string, fold int, v binary"


def totals(rows: DataFrame, part: Callable[[Key, np.ndarray, np.ndarray], np.ndarray | None]) -> dict[Key, np.ndarray]:
    """For every cell and fold the sum of part(key, x, y) over its training rows. part returns one vector, or None for a model that needs nothing."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[Key, np.ndarray] = {}
        for batch in batches:
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy().astype(np.float64)
            for key, at in _groups(batch, "train"):
                v = part(key, x[at], y[at])
                if v is not None:
                    total[key] = total[key] + v if key in total else v
        yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, v = None, None
        for batch in batches:
            done = {}
            for cell, fold, more in zip(*(batch.column(c).to_pylist() for c in ("cell", "fold", "v")), strict=True):
                if (cell, fold) != key:
                    if key is not None:
                        done[key] = v
                    key, v = (cell, fold), np.zeros(len(more) // 8)
                v = v + np.frombuffer(more)
            yield packed(done)
        if key is not None:
            yield packed({key: v})

    def packed(found: dict[Key, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["cell", "fold", "v"])

    parts = rows.select("cell", "x", "y", "train").mapInArrow(of, SUMS)
    found = parts.repartition("cell", "fold").sortWithinPartitions("cell", "fold").mapInArrow(add, SUMS)
    return {(r.cell, r.fold): np.frombuffer(r.v) for r in found.collect()}  # a vector a model


def fit(rows: DataFrame, config: ProbeConfig) -> dict[Key, Model]:
    """A model for each cell and fold that has training rows. rows: prepared()."""
    n = rows.select("cell", F.explode("train").alias("fold")).distinct().count()
    if n > config.models:
        raise ValueError(f"{n} models are more than {config.models}; split the cells over several calls")
    spark = rows.sparkSession.sparkContext
    first = totals(rows, lambda key, x, y: np.concatenate([[len(x), y.sum()], x.sum(axis=0)]))
    counts = {k: (v[0], v[1]) for k, v in first.items()}
    models = {k: Model(v[2:] / v[0]) for k, v in first.items()}
    for k, (m, ones) in counts.items():
        if config.reduce == "majority":
            models[k].constant = float(ones * 2 > m)
        elif ones in (0, m):
            models[k].constant = float(ones / m)
        elif config.balanced:
            models[k].class_weights = m / (2 * (m - ones)), m / (2 * ones)
    open_ = {k for k, m in models.items() if m.constant is None}
    if not open_:
        return models
    means = spark.broadcast({k: models[k].mean for k in open_})
    whole = config.reduce == "pca"

    def spread(key: Key, x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
        if key not in means.value:
            return None
        x = x - means.value[key]
        return (x.T @ x).ravel() if whole else (x * x).sum(axis=0)

    for k, v in totals(rows, spread).items():
        model, (m, _) = models[k], counts[k]
        d = len(model.mean)
        cross = v.reshape(d, d) / m if whole else None
        var = np.diag(cross) if whole else v / m
        model.scale = np.where(var > 0, np.sqrt(np.maximum(var, 0)), 1.0)
        if whole:
            values, vectors = np.linalg.eigh(cross / np.outer(model.scale, model.scale))
            vectors = vectors[:, np.argsort(-values, kind="stable")[: int(min(config.size, d, m - 1))]]
            lead = np.abs(vectors).argmax(axis=0)
            model.basis = vectors * np.sign(vectors[lead, np.arange(vectors.shape[1])])
        elif config.reduce == "random":
            model.basis = np.random.default_rng(config.seed).normal(0, 1 / np.sqrt(config.size), (d, config.size))
    _newton(rows, models, counts, open_, config)
    return models


def _newton(rows: DataFrame, models: dict[Key, Model], counts: dict[Key, tuple], open_: set[Key], config: ProbeConfig) -> None:
    """Weights that minimise c * loss + |weights|^2 / 2, the bias free, with halved steps where a full one does not help."""
    best: dict[Key, tuple] = {}  # loss, weights, direction, step
    for k in open_:
        width = 1 + (len(models[k].mean) if models[k].basis is None else models[k].basis.shape[1])
        models[k].weights = np.zeros(width)
    spark = rows.sparkSession.sparkContext
    for _ in range(config.rounds):
        if not open_:
            return
        shared = spark.broadcast({k: models[k] for k in open_})

        def part(key: Key, x: np.ndarray, y: np.ndarray, shared=shared) -> np.ndarray | None:
            model = shared.value.get(key)
            if model is None:
                return None
            a = model.design(x)
            z, weigh = a @ model.weights, np.where(y > 0, model.class_weights[1], model.class_weights[0])
            p = sigmoid(z)
            loss = (weigh * (np.logaddexp(0, z) - y * z)).sum()
            return np.concatenate([[loss], a.T @ (weigh * (p - y)), (a.T @ (a * (weigh * p * (1 - p))[:, None])).ravel()])

        for k, v in totals(rows, part).items():
            w = models[k].weights
            width = len(w)
            held = np.append(0.0, w[1:])
            loss, slope = config.c * v[0] + held @ held / 2, config.c * v[1 : 1 + width] + held
            if k in best and loss > best[k][0] + 1e-12 * abs(best[k][0]):
                _, w, direction, step = best[k]
                if step < 1e-10:
                    models[k].weights = w
                    open_.discard(k)
                    continue
                best[k] = (best[k][0], w, direction, step / 2)
                models[k].weights = w - direction * step / 2
                continue
            if np.abs(slope).max() <= config.tolerance * (1 + counts[k][0]):
                open_.discard(k)
                continue
            curve = config.c * v[1 + width :].reshape(width, width) + np.diag(np.append(0.0, np.ones(width - 1)))
            direction = np.linalg.solve(curve + 1e-12 * np.eye(width), slope)
            best[k] = (loss, w, direction, 1.0)
            models[k].weights = w - direction
        shared.unpersist()
    for k in open_:
        if k in best:
            models[k].weights = best[k][1]


def out_of_fold(rows: DataFrame, models: dict[Key, Model], by: list[str], key: list[str]) -> DataFrame:
    """by, key, fold, y, score: each row for every fold that tests it; a fold without a model gives none. rows: prepared()."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    keep = [*by, *key]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            at, fold, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
            for k, rows_ in _groups(batch, "test"):
                if k in shared.value:
                    at.append(rows_)
                    fold.append(np.full(len(rows_), k[1], np.int32))
                    score.append(shared.value[k].score(x[rows_]))
            taken = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in keep), pa.array(np.concatenate(fold)), batch.column("y").take(taken), pa.array(np.concatenate(score))], [*keep, "fold", "y", "score"])

    kinds = dict(rows.dtypes)
    return rows.select("cell", *keep, "x", "y", "test").mapInArrow(of, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "fold int, y int, score double"]))


def fold_metrics(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, fold, n, accuracy and balanced accuracy: the mean of the recalls of the classes that are there."""
    hit = ((F.col("score") > 0.5).cast("int") == F.col("y")).cast("double")
    recall = [F.avg(F.when(F.col("y") == k, hit)) for k in (0, 1)]
    x = scores.groupBy(*by, "fold").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), recall[0].alias("__0"), recall[1].alias("__1"))
    both = (F.coalesce("__0", F.lit(0.0)) + F.coalesce("__1", F.lit(0.0))) / (F.col("__0").isNotNull().cast("int") + F.col("__1").isNotNull().cast("int"))
    return x.withColumn("balanced_accuracy", both).drop("__0", "__1")


def probe_eval(rows: DataFrame, by: list[str], key: list[str], config: ProbeConfig = ProbeConfig()) -> DataFrame:
    """Per cell: means and deviations (of the population) of the folds' accuracy and balanced accuracy, folds, windows.

    rows: by, key, x (numbers, as many in every row of a call), y (0 or 1), train and test (lists of folds). Cells of which no fold has both training
    and test rows have n_folds 0 and null means. Where the training rows are of one class its share is the score of all.
    """
    x = prepared(rows, by, key)
    folds = fold_metrics(out_of_fold(x, fit(x, config), by, key), by)
    mean = folds.groupBy(*by).agg(
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"), F.avg("balanced_accuracy").alias("balanced_accuracy_mean"),
        F.stddev_pop("balanced_accuracy").alias("balanced_accuracy_std"), F.count("*").alias("n_folds"),
    )
    return x.groupBy(*by).agg(F.count("*").alias("n_windows")).join(mean, by, "left").withColumn("n_folds", F.coalesce("n_folds", F.lit(0)))


def probe_summary(evals: DataFrame, by: list[str], threshold: float = 0.514) -> DataFrame:
    """Over the cells of each horizon: mean, median and deviation of both accuracies, cells above the threshold, cells without a fold."""
    out = [F.count("*").alias("n_cells"), F.count_if(F.col("n_folds") == 0).alias("n_errors")]
    for c in ("accuracy", "balanced_accuracy"):
        m = f"{c}_mean"
        out += [F.avg(m).alias(f"mean_{c}"), F.median(m).alias(f"median_{c}"), F.stddev_pop(m).alias(f"std_{c}"), F.count_if(F.col(m) > threshold).alias(f"n_above_{c}")]
    return evals.groupBy(*by).agg(*out)


def grid(rows: DataFrame, by: list[str], key: list[str], strengths: list[float], config: ProbeConfig) -> DataFrame:
    """by, c, balanced_accuracy_mean, chosen: each cell's folds under every c; the best is chosen, the least c of equals."""
    from dataclasses import replace

    from pyspark.sql import Window

    x = prepared(rows, by, key)
    parts = []
    for c in strengths:
        scores = out_of_fold(x, fit(x, replace(config, c=c)), by, key)
        parts.append(fold_metrics(scores, by).groupBy(*by).agg(F.avg("balanced_accuracy").alias("balanced_accuracy_mean")).withColumn("c", F.lit(float(c))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("balanced_accuracy_mean").desc(), "c"))
    return out.select(*by, "c", "balanced_accuracy_mean", (first == 1).alias("chosen"))


def confound(rows: DataFrame, by: list[str], key: list[str], session: str, config: ProbeConfig) -> DataFrame:
    """by, flat, session_only, gap: balanced accuracy of the features and of the hour alone; features that beat the hour by nothing may only tell the hour.

    session: a column of small whole numbers below 24, taken as 24 indicators.
    """
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: (h == F.col(session)).cast("double"))
    flat = probe_eval(rows.drop(session), by, key, config).select(*by, F.col("balanced_accuracy_mean").alias("flat"))
    alone = probe_eval(rows.withColumn("x", hours).drop(session), by, key, ProbeConfig("none", c=config.c, balanced=config.balanced)).select(*by, F.col("balanced_accuracy_mean").alias("session_only"))
    return flat.join(alone, by).withColumn("gap", F.col("flat") - F.col("session_only"))
