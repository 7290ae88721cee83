"""As-of and interval joins by one sort each: both sides are stacked, sorted by key and time, and the last (or next)
quote is carried along. Cost is linear in both sides; a day's events and quotes share a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], tie: str, forward: bool = False) -> DataFrame:
    """left with the columns `take` of its last right row at or before left_time (forward: first at or after), and that
    row's time as asof_time; null where there is none. tie orders right rows of one time: the greatest wins (forward: the
    least)."""
    fields = [F.col(right_time).alias("asof_time"), *[F.col(c) for c in take]]
    r = right.select(*by, F.col(right_time).alias("__t"), F.lit(0 if not forward else 1).alias("__side"), F.col(tie).cast("long").alias("__tie"), F.struct(*fields).alias("__q"))
    x = left.select(*by, F.col(left_time).alias("__t"), F.lit(1 if not forward else 0).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.struct(*left.columns).alias("__l"))
    both = r.unionByName(x, allowMissingColumns=True)
    # a frame that ends at the row itself grows with it; one that starts there would be read anew for every row, so forward goes backwards
    keys = ["__t", "__side", "__tie"]
    order = Window.partitionBy(*by).orderBy(*[F.col(k).desc() if forward else F.col(k) for k in keys])
    found = F.last("__q", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__f", found).where("__l is not null")
    return out.select("__l.*", *[F.col("__f")[c].alias(c) for c in ["asof_time", *take]])


def running_count_at(events: DataFrame, flag: Column, by: list[str], time: str) -> DataFrame:
    """events with `before`: flagged rows of its key up to and including its time."""
    order = Window.partitionBy(*by).orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    return events.withColumn("before", F.count(F.when(flag, 1)).over(order))


def exists_within(events: DataFrame, flag: Column, by: list[str], time: str, ahead: int) -> Column:
    """Whether a flagged row lies in (time, time + ahead] of the same key: a range frame, no join."""
    order = Window.partitionBy(*by).orderBy(time).rangeBetween(1, ahead)
    return F.count(F.when(flag, 1)).over(order) > 0


def interval_join(points: DataFrame, spans: DataFrame, time: str, start: str, end: str, width: int) -> DataFrame:
    """Every point with every span that holds it (bounds included), by the time cells of `width` that a span touches.

    A span is copied to its cells, so the join is an equi-join that shuffles; no side has to be small.
    """
    cells = spans.withColumn("__cell", F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(f"{end} div {width}"))))
    p = points.withColumn("__cell", F.expr(f"{time} div {width}"))
    return p.join(cells, "__cell").where(F.col(time).between(F.col(start), F.col(end))).drop("__cell")
