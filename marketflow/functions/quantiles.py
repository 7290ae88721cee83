"""Exact interpolated quantiles of groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.functions.ranks import bin_of


def group_quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], bins: int = 256) -> DataFrame:
    """by and, for each name, the quantile of a column in its group, nulls left out; null for a group without values.

    Values are counted, dealt to bins by approximate quantiles of the whole table, whose number is fixed, and summed up in
    two levels, bins first; so the row that holds a wanted position is known. The bounds cost a pass of their own and
    only set how even the bins are.
    """
    columns = list({str(c): c for c, _ in wanted.values()}.values())
    number = {name: next(i for i, c in enumerate(columns) if str(c) == str(col)) for name, (col, _) in wanted.items()}
    x = df.select(*by, *[c.cast("double").alias(f"__{i}") for i, c in enumerate(columns)])
    found = x.agg(*[F.percentile_approx(f"__{i}", [k / bins for k in range(1, bins)], 10 * bins).alias(str(i)) for i in range(len(columns))]).first()
    bin_ = F.coalesce(*[F.when(F.col("m") == i, bin_of(F.col("v"), sorted(set(found[str(i)] or [])))) for i in range(len(columns))])
    long = x.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(f"__{i}").alias("v")) for i in range(len(columns))])).alias("x")).select(*by, "x.m", "x.v")
    counts = long.where("v is not null").groupBy(*by, "m", "v").agg(F.count("*").alias("n")).withColumn("bin", bin_)
    each = Window.partitionBy(*by, "m")
    before = counts.groupBy(*by, "m", "bin").agg(F.sum("n").alias("t")).select(
        *by, "m", "bin", F.coalesce(F.sum("t").over(each.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("t").over(each).alias("every"),
    )
    inside = Window.partitionBy(*by, "m", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(before, [*by, "m", "bin"]).withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    spot = lambda q: (F.col("every") - 1) * q
    holds = lambda i, at: (F.col("m") == i) & (F.col("first") <= at) & (at < F.col("first") + F.col("n"))
    parts = []
    for name, (_, q) in wanted.items():
        i = number[name]
        parts += [F.max(F.when(holds(i, F.floor(spot(q))), F.col("v"))).alias(f"__lo_{name}"), F.max(F.when(holds(i, F.ceil(spot(q))), F.col("v"))).alias(f"__hi_{name}"), F.max(F.when(F.col("m") == i, spot(q) - F.floor(spot(q)))).alias(f"__f_{name}")]
    out = placed.groupBy(*by).agg(*parts)
    # one rounding for the product and the sum: an edge that falls onto a value is that value
    value = lambda n: F.when(F.col(f"__lo_{n}").isNotNull(), F.java_method(F.lit("java.lang.Math"), F.lit("fma"), F.col(f"__lo_{n}"), 1 - F.col(f"__f_{n}"), F.col(f"__hi_{n}") * F.col(f"__f_{n}")).cast("double"))
    return out.select(*by, *[value(n).alias(n) for n in wanted])
