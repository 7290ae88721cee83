"""Windows of events with what followed them: forward returns, liquidations within the horizon, and their direction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.operators import order_events as o
from marketflow.operators import session_kernel as kernel
from marketflow.operators.asof import asof


def anchors(events: DataFrame, liquidations: DataFrame, length: int, stride: int, horizons: list[int]) -> DataFrame:
    """symbol, session, window_start, anchor_ts, anchor_vwap, horizon, end_ts, fwd (log return), liq_ts and liq_price of the first liquidation after the anchor (null: none): a row for each window and horizon within the session.

    events: symbol, session, ts_ms, vwap, one row a time. liquidations: symbol, session, ts_ms, price, tie. The two sides are stacked and sorted once a session.
    """
    w = o.ordered("ts_ms")
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("ts_ms", h).over(w).alias("end_ts"), F.log(F.lead("vwap", h).over(w) / F.col("vwap")).alias("fwd")) for h in horizons])
    x = o.indexed(events.select(*o.DAY, "ts_ms", "vwap")).withColumn("h", ahead).withColumn("window_start", F.col("event_idx") - (length - 1))
    x = x.where((F.col("window_start") >= 0) & (F.col("window_start") % stride == 0)).withColumn("after", F.col("ts_ms") + 1)
    found = asof(x, liquidations.withColumn("liq_price", F.col("price")), o.DAY, "after", "ts_ms", ["liq_price"], "tie", forward=True)
    out = found.select(*o.DAY, "window_start", F.col("ts_ms").alias("anchor_ts"), F.col("vwap").alias("anchor_vwap"), F.explode("h").alias("h"), F.col("asof_time").alias("liq_ts"), "liq_price")
    return out.where("h.end_ts is not null").select(*o.DAY, "window_start", "anchor_ts", "anchor_vwap", "h.horizon", "h.end_ts", "h.fwd", "liq_ts", "liq_price")


def direction_dataset(rows: DataFrame) -> DataFrame:
    """rows of anchors() with direction: whether the first liquidation after the anchor and up to the horizon's end is above (1) or below (-1) the anchor's price; 0 without one or at it."""
    inside = F.coalesce(F.col("liq_ts") <= F.col("end_ts"), F.lit(False))
    return rows.withColumn("direction", F.when(inside, F.signum(F.col("liq_price") - F.col("anchor_vwap")).cast("int")).otherwise(0)).drop("liq_ts", "liq_price")


def cascade_windows(rows: DataFrame, features: DataFrame, width: int, least: int, share: float = 0.9) -> DataFrame:
    """rows of anchors() with real_label, whether a liquidation falls into the horizon, synthetic_label, whether the size of the forward return lies above its rolling quantile over `width` windows of the
    session and horizon (never with fewer than `least`), and the window's features. features: symbol, session, window_start and numbers. Windows without features are left out."""
    x = rows.withColumn("real_label", F.coalesce(F.col("liq_ts") <= F.col("end_ts"), F.lit(False)).cast("int")).drop("liq_ts", "liq_price")
    kinds = dict(x.dtypes)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window_start")
        size = pdf["fwd"].abs().to_numpy()
        return pdf.assign(synthetic_label=(size > kernel.frame(size, share, width, least)).astype("int32"))

    labelled = x.groupBy(*o.DAY, "horizon").applyInPandas(of, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", synthetic_label int")
    return labelled.join(features, [*o.DAY, "window_start"])
