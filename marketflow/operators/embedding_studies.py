"""Studies of embeddings: clusters and their agreement with labels, ranks of the spectrum, cosines of populations of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.functions.running import running
from marketflow.operators.folds import hash_order
from marketflow.sources.shared import written


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sound(vector: str) -> Column:
    """Whether a vector is there and all of it is finite."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of part(batch), a vector of one length: each task adds up its own, Spark those of the tasks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                v = part(batch)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    found = rows.mapInArrow(of, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r.i] = r.v
    return out


@dataclass(frozen=True)
class ClusterConfig:
    """k clusters of standardised vectors; starts: seeds tried at once, of which the least inertia wins; tolerance: on the squared shift of centres, for each unit of variance."""

    k: int = 16
    starts: int = 3
    seed: int = 0
    rounds: int = 300
    tolerance: float = 1e-4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


def k_means(rows: DataFrame, key: str, vector: str, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """rows with cluster, 0 .. k - 1; vectors that are null or not finite are left out.

    Standardised first. Seeds are drawn as k-means++ does, each by a race: a row's hash gives it an exponential time at the rate of its
    squared distance to the seeds so far, and the earliest of all is next. Hashes hang on key, seed and round, centres are held to nine digits,
    so that reruns agree whatever the partitions. Rounds go on until no start's centres move by more than the tolerance. With fewer distinct rows than k some clusters stay empty.
    """
    x = written(rows.where(sound(vector)).withColumn("__h", F.xxhash64(F.lit(config.seed), F.col(key).cast("string"))))
    spark = rows.sparkSession.sparkContext
    first = summed(x.select(vector), lambda b: np.append(matrix(b.column(0)).sum(axis=0), len(b)))
    if not len(first):
        return x.withColumn("cluster", F.lit(0)).drop("__h")
    n = first[-1]
    mean = np.round(first[:-1] / n, 9)
    shared = spark.broadcast(mean)
    scale = np.round(np.sqrt(summed(x.select(vector), lambda b: ((matrix(b.column(0)) - shared.value) ** 2).sum(axis=0)) / n), 9)
    scale[scale == 0] = 1.0
    d, k, s = len(mean), config.k, config.starts
    plain = spark.broadcast((mean, scale))
    standard = lambda b: (matrix(b.column(vector)) - plain.value[0]) / plain.value[1]

    def race(seeds: np.ndarray, turn: int) -> np.ndarray:
        """The next seed of every start. seeds: starts x turn x d."""
        known = spark.broadcast(seeds)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list = [None] * s
            for batch in batches:
                z = standard(batch)
                h = batch.column("__h").to_numpy().view(np.uint64)
                for i in range(s if len(z) else 0):
                    u = (_mix(h + np.uint64(1 + i * k + turn)) >> np.uint64(11)).astype(np.float64) / 2.0**53
                    rate = _distances(z, known.value[i]).min(axis=1) if turn else np.ones(len(z))
                    with np.errstate(divide="ignore"):
                        time = np.where(rate > 1e-12, -np.log(np.maximum(u, 1e-300)) / rate, np.inf)
                    at = int(np.lexsort((h, time))[0])
                    found = (float(time[at]), int(h[at : at + 1].view(np.int64)[0]), z[at])
                    if best[i] is None or found[:2] < best[i][:2]:
                        best[i] = found
            there = [i for i in range(s) if best[i] is not None]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([best[i][0] for i in there], pa.float64()), pa.array([best[i][1] for i in there], pa.int64()), pa.array([best[i][2].tolist() for i in there], pa.list_(pa.float64()))], ["start", "time", "h", "z"])

        won = x.select(vector, "__h").mapInArrow(of, "start int, time double, h long, z array<double>").groupBy("start").agg(F.min_by("z", F.struct("time", "h")).alias("z")).collect()
        return np.round(np.array([r.z for r in sorted(won)]), 9)[:, None, :]

    centres = np.zeros((s, 0, d))
    for turn in range(k):
        centres = np.concatenate([centres, race(centres, turn)], axis=1)
    width, moving = k * (d + 1) + 1, np.ones(s, bool)
    for _ in range(config.rounds):
        known = spark.broadcast(centres)

        def part(b: pa.RecordBatch, known=known) -> np.ndarray:
            z, out = standard(b), []
            for c in known.value:
                far = _distances(z, c)
                near = far.argmin(axis=1)
                member = np.zeros((len(z), k))
                member[np.arange(len(z)), near] = 1
                out += [(member.T @ z).ravel(), member.sum(axis=0), [far[np.arange(len(z)), near].sum()]]
            return np.concatenate(out)

        parts = summed(x.select(vector), part).reshape(s, width)
        inertia, counts, total = parts[:, -1], parts[:, k * d : -1], parts[:, : k * d].reshape(s, k, d)
        new = np.where(counts[:, :, None] > 0, np.round(total / np.maximum(counts, 1)[:, :, None], 9), centres)
        moving = ((new - centres) ** 2).sum(axis=(1, 2)) > config.tolerance
        if not moving.any():
            break
        centres = new
    best = spark.broadcast(centres[int(np.argmin(np.round(inertia, 6)))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _distances(standard(batch), best.value).argmin(axis=1).astype(np.int32) if len(batch) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "cluster"])

    schema = ", ".join(f"`{c}` {t}" for c, t in x.dtypes) + ", cluster int"
    return x.mapInArrow(assign, schema).drop("__h")


def adjusted_rand(cells: DataFrame, by: list[str], a: str, b: str, n: str) -> DataFrame:
    """by, ari: the adjusted Rand index of two labelings from their contingency cells (a, b, n)."""
    pairs = lambda c: c * (c - 1) / 2
    side = lambda name: cells.groupBy(*by, name).agg(F.sum(n).alias("m")).groupBy(*by).agg(F.sum(pairs(F.col("m"))).alias(f"__{name}"), F.sum("m").alias("__n"))
    whole = cells.groupBy(*by).agg(F.sum(pairs(F.col(n))).alias("__both"))
    x = whole.join(side(a).drop("__n"), by) if by else whole.join(F.broadcast(side(a).drop("__n")))
    x = x.join(side(b), by) if by else x.join(F.broadcast(side(b)))  # a row each
    expected, most = F.col(f"__{a}") * F.col(f"__{b}") / F.nullif(pairs(F.col("__n")), F.lit(0.0)), (F.col(f"__{a}") + F.col(f"__{b}")) / 2
    return x.select(*by, F.when(most == expected, 1.0).otherwise((F.col("__both") - expected) / (most - expected)).alias("ari"))


def permuted_cells(rows: DataFrame, key: str, cluster: str, label: str, permutations: int, seed: int) -> DataFrame:
    """replicate, cluster, label, n: contingency cells with the labels permuted by hash, `permutations` times.

    In a replicate rows go by their hash, and the labels, least first, are dealt out in that order; a label thus takes a range of ranks.
    Only rows whose hash shares its first digits with a bound of such a range need their exact rank, the others only the count of the digits below theirs.
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("m")).orderBy(label).collect()  # a row a label
    ends, total = [], 0
    for r in sizes:
        total += r.m
        ends.append(total)
    x = rows.select(key, cluster, F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("replicate"))
    x = x.withColumn("__h", hash_order(F.concat_ws(":", "replicate", F.col(key).cast("string")), seed)).withColumn("__c", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    counts = x.groupBy("replicate", "__c").agg(F.count("*").alias("__m"))
    upto = Window.partitionBy("replicate").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__m").over(upto), F.lit(0)))  # at most 4,096 rows a replicate
    place = lambda rank: sum((F.when(rank >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    counts = counts.withColumns({"__low": place(F.col("__before")), "__high": place(F.col("__before") + F.col("__m") - 1)})
    # 4,096 rows a replicate are many for a broadcast, which would go through the driver's memory
    x = x.join(counts.select("replicate", "__c", "__before", "__low", "__high").hint("merge"), ["replicate", "__c"])
    whole = x.where("__low = __high").select("replicate", cluster, F.col("__low").alias("__p"))
    cut = x.where("__low <> __high").withColumn("__r", F.col("__before") + F.row_number().over(Window.partitionBy("replicate", "__c").orderBy("__h", key)) - 1)
    names = F.array(*[F.lit(r[label]) for r in sizes])
    both = whole.unionByName(cut.select("replicate", cluster, place(F.col("__r")).alias("__p")))
    return both.groupBy("replicate", cluster, "__p").agg(F.count("*").alias("n")).select("replicate", cluster, F.get(names, F.col("__p")).alias(label), "n")


def agreement(rows: DataFrame, key: str, cluster: str, label: str, permutations: int = 100, seed: int = 0) -> DataFrame:
    """One row: ari of clusters and labels, and mean, p95, p99 and maximum of it over permuted labels. Rows without a cluster or a label are left out."""
    x = rows.where(F.col(cluster).isNotNull() & F.col(label).isNotNull())
    real = adjusted_rand(x.groupBy(cluster, label).agg(F.count("*").alias("n")), [], cluster, label, "n")
    cells = written(permuted_cells(x, key, cluster, label, permutations, seed))  # few rows, read three times
    null = adjusted_rand(cells, ["replicate"], cluster, label, "n")
    stats = null.agg(F.avg("ari").alias("null_mean"), F.percentile("ari", 0.95).alias("null_p95"), F.percentile("ari", 0.99).alias("null_p99"), F.max("ari").alias("null_max"))
    return real.join(F.broadcast(stats))  # a row each


def rank_summary(rows: DataFrame, vector: str, floor: float = 0.01, collapse: float = 0.05) -> DataFrame:
    """One row: n, rankme (the exponential of the entropy of the singular values' shares), effective_rank (singular values of the centred
    vectors above `floor` of the greatest; 1 where all vectors are equal), mean_std over the features and collapsed, whether that is below `collapse`.

    Two passes: the mean, then one centred matrix of d rows and columns from each task. Vectors that are null or not finite are left out; without a row n is 0 and the rest null, but for rankme, 1 below two rows.
    """

    x = rows.where(sound(vector)).select(vector)
    spark = rows.sparkSession
    schema = "n long, rankme double, effective_rank long, mean_std double, collapsed boolean"
    first = summed(x, lambda b: np.append(matrix(b.column(0)).sum(axis=0), len(b)))
    if not len(first):
        return spark.createDataFrame([(0, 1.0, None, None, None)], schema)
    n, mean = int(first[-1]), first[:-1] / first[-1]
    d = len(mean)
    shared = spark.sparkContext.broadcast(mean)

    def part(b: pa.RecordBatch) -> np.ndarray:
        z = matrix(b.column(0)) - shared.value
        return np.append((z.T @ z).ravel(), z.sum(axis=0))

    g = summed(x, part)
    rest = g[d * d :] / n  # what rounding left of the mean
    centred = g[: d * d].reshape(d, d) - n * np.outer(rest, rest)
    whole = centred + n * np.outer(mean + rest, mean + rest)
    least = np.trace(whole) * 1e-14

    def singular(cross: np.ndarray) -> np.ndarray:
        values = np.linalg.eigvalsh(cross)
        values[values < least] = 0
        return np.sqrt(values)

    s, c = singular(whole), singular(centred)
    share = s / (s.sum() + 1e-12)
    share = share[share > 1e-12]
    rankme = float(np.exp(-(share * np.log(share)).sum())) if n > 1 else 1.0
    std = float(np.sqrt(np.maximum(np.diag(centred), 0) / (n - 1)).mean()) if n > 1 else None
    effective = int((c > c.max() * floor).sum()) if c.max(initial=0) > 0 else 1
    return spark.createDataFrame([(n, rankme, effective, std, std is not None and std < collapse)], schema)


#: Populations of pairs: same symbol or not, same hour or not.
POPULATIONS = ["same_symbol_same_hour", "same_symbol_other_hour", "other_symbol_same_hour", "other_symbol_other_hour"]


def sampled_pairs(rows: DataFrame, symbol: str, hour: str, key: str, cap: int, seed: int) -> DataFrame:
    """population, i, j (global places of two rows, j before i), and placed rows by place: up to about `cap` pairs of each population, all if there are no more.

    Rows are placed by symbol, hour and key. Counts of the cells (symbol, hour) give every population's number of pairs, P, and the range of pair
    numbers that belong to a cell; pair t of the sample has a number drawn by hash from the t-th of `cap` ranges of about one size that make up 0 .. P - 1. So each cell makes its own
    pairs, without a search: at most cap + 2 x cells rows. The last population is drawn among pairs of different symbols, as many more
    as its share asks for (20 times at most), and pairs of one hour are dropped.
    """
    cells = rows.groupBy(symbol, hour).agg(F.count("*").alias("n"))
    cells = running(cells, [], symbol, [hour], {"through": (F.col("n"), "sum")})
    own, at_hour = Window.partitionBy(symbol).orderBy(hour).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(hour).orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"first": F.col("through") - F.col("n"), "in_symbol": F.coalesce(F.sum("n").over(own), F.lit(0)), "in_hour": F.coalesce(F.sum("n").over(at_hour), F.lit(0))})
    cells = cells.withColumn("others", F.col("first") - F.col("in_symbol"))
    n = F.col("n")
    weigh = [F.expr("n * (n - 1) div 2"), n * F.col("in_symbol"), n * F.col("in_hour"), n * F.col("others")]
    cells = written(running(cells.withColumns({f"w{k}": w for k, w in enumerate(weigh)}), [], symbol, [hour], {f"to{k}": (F.col(f"w{k}"), "sum") for k in range(4)}))
    totals = cells.agg(*[F.coalesce(F.sum(f"w{k}"), F.lit(0)) for k in range(4)]).first()
    other = totals[3] - totals[2]
    wanted = [min(cap, totals[k]) for k in range(3)] + [0]
    if other > 0:
        wanted[3] = min(totals[3], 20 * cap, -(-min(cap, other) * totals[3] // other))
    placed = rows.join(cells.select(symbol, hour, "first", "in_hour"), [symbol, hour]).withColumn("__k", F.row_number().over(Window.partitionBy(symbol, hour).orderBy(key)) - 1)
    placed = placed.withColumns({"place": F.col("first") + F.col("__k"), "hour_place": F.col("in_hour") + F.col("__k")}).drop("first", "in_hour", "__k")
    parts = []
    for k, name in enumerate(POPULATIONS):
        if not wanted[k]:
            continue
        whole = float(totals[k])
        x = cells.where(f"w{k} > 0").withColumns({"__a": F.col(f"to{k}") - F.col(f"w{k}"), "__b": F.col(f"to{k}")})
        low, high = F.floor(F.col("__a") / whole * wanted[k]) - 1, F.floor(F.col("__b") / whole * wanted[k]) + 1
        x = x.withColumn("t", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("long"), F.least(high, F.lit(wanted[k] - 1)).cast("long"))))
        part = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.col("t").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296
        edge = lambda t: F.floor(t / wanted[k] * whole)  # noqa: B023, E731
        number = F.col("t") if wanted[k] == totals[k] else edge(F.col("t")) + F.floor(part * (edge(F.col("t") + 1) - edge(F.col("t"))))
        x = x.withColumn("u", F.least(number.cast("long"), F.lit(totals[k] - 1))).where("u >= __a and u < __b").withColumn("r", F.col("u") - F.col("__a"))
        if k == 0:  # pair r of a cell is (i, j), j < i, with r = i (i - 1) / 2 + j
            i = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(8.0) * F.col("r"))) / 2)
            i = F.when(i * (i - 1) / 2 > F.col("r"), i - 1).when((i + 1) * i / 2 <= F.col("r"), i + 1).otherwise(i)
            x = x.withColumn("__i", i.cast("long"))
            x = x.select(F.lit(name).alias("population"), (F.col("first") + F.col("__i")).alias("i"), (F.col("first") + F.col("r") - F.expr("__i * (__i - 1) div 2")).alias("j"), F.lit(None).cast(dict(rows.dtypes)[hour]).alias("by_hour"))
        else:
            before = F.expr({1: "in_symbol", 2: "in_hour", 3: "others"}[k])
            i, j = F.floor(F.col("r") / before), F.col("r") % before
            start = {1: F.col("first") - F.col("in_symbol"), 2: F.lit(0), 3: F.lit(0)}[k]
            x = x.select(F.lit(name).alias("population"), (F.col("first") + i).cast("long").alias("i"), (start + j).cast("long").alias("j"), (F.col(hour) if k == 2 else F.lit(None).cast(dict(rows.dtypes)[hour])).alias("by_hour"))
        parts.append(x)
    if not parts:
        empty = placed.sparkSession.createDataFrame([], "population string, i long, j long")
        return empty.join(placed.select(F.col("place").alias("i"), F.struct(*rows.columns).alias("a")), "i").withColumn("b", F.col("a"))
    pairs = parts[0]
    for x in parts[1:]:
        pairs = pairs.unionByName(x)
    pairs = written(pairs)
    as_row = F.struct(*rows.columns)
    left = placed.select(F.col("place").alias("i"), as_row.alias("a"))
    right, of_hour = placed.select(F.col("place").alias("j"), as_row.alias("b")), placed.select(F.col(hour).alias("by_hour"), F.col("hour_place").alias("j"), as_row.alias("b"))
    third = F.col("population") == POPULATIONS[2]
    both = pairs.where(~third).drop("by_hour").join(right, "j").unionByName(pairs.where(third).join(of_hour, ["by_hour", "j"]).drop("by_hour"))
    out = both.join(left, "i")
    return out.where((F.col("population") != POPULATIONS[3]) | (F.col(f"a.{hour}") != F.col(f"b.{hour}")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors in doubles; a vector of length 0 counts as it is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(F.sqrt(dot(x, x)) < 1e-12, 1.0).otherwise(F.sqrt(dot(x, x)))
    return dot(a, b) / norm(a) / norm(b)


def cosine_populations(rows: DataFrame, symbol: str, hour: str, key: str, vector: str, cap: int = 100_000, seed: int = 0) -> DataFrame:
    """population, n_pairs, mean, std, p5, p50, p95 of the cosines of sampled pairs. Rows without symbol, hour or a finite vector are left out."""
    x = rows.where(F.col(symbol).isNotNull() & F.col(hour).isNotNull() & sound(vector)).select(symbol, hour, key, vector)
    pairs = sampled_pairs(x, symbol, hour, key, cap, seed).withColumn("c", cosine(F.col(f"a.{vector}"), F.col(f"b.{vector}")))
    q = lambda p: F.percentile("c", p)  # noqa: E731  of at most about cap values
    return pairs.groupBy("population").agg(F.count("*").alias("n_pairs"), F.avg("c").alias("mean"), F.coalesce(F.stddev_samp("c"), F.lit(0.0)).alias("std"), q(0.05).alias("p5"), q(0.5).alias("p50"), q(0.95).alias("p95"))
