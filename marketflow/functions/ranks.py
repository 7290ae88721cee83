"""Ranks over whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds a value reaches, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    edges = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(edges, at + s - 1) <= value, at + s).otherwise(at))


def mean_rank_share(df: DataFrame, key: list[str], metrics: list[str], name: str, bins: int = 256) -> DataFrame:
    """df with column `name`: the mean over the metrics of (average rank among all rows, ties shared) / rows, or 0 for a
    constant metric. key tells rows apart; metrics are not null. Use it on a table that is cheap to read again.

    Counts by (metric, value), then prefix sums in two levels: values fall into bins by approximate quantiles, whose
    number is fixed; whole bins are summed first, then the values inside each bin.
    """
    bounds = df.agg(*[F.percentile_approx(m, [k / bins for k in range(1, bins)], 10 * bins).alias(m) for m in metrics]).first()
    long = df.select(*key, F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(m).alias("v")) for i, m in enumerate(metrics)])).alias("x")).select(*key, "x.m", "x.v")
    place = F.coalesce(*[F.when(F.col("m") == i, bin_of(F.col("v"), sorted(set(bounds[m] or [])))) for i, m in enumerate(metrics)])
    counts = long.groupBy("m", "v").agg(F.count("*").alias("n")).withColumn("bin", place)
    each = Window.partitionBy("m")
    before = counts.groupBy("m", "bin").agg(F.sum("n").alias("t")).select(
        "m", "bin", F.coalesce(F.sum("t").over(each.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("t").over(each).alias("every"),
    )
    inside = Window.partitionBy("m", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    share = F.when(F.col("n") == F.col("every"), 0.0).otherwise((first + (F.col("n") + 1) / 2) / F.col("every"))
    ranks = counts.join(F.broadcast(before), ["m", "bin"]).select("m", "v", share.alias("share"))  # before: at most bins rows a metric
    return df.join(long.join(ranks, ["m", "v"]).groupBy(*key).agg((F.sum("share") / len(metrics)).alias(name)), key)
