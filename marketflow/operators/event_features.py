"""The features and labels of all order events of all symbols and sessions, and windows of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketflow.functions.running import places
from marketflow.operators import order_events as o
from marketflow.operators import session_kernel as kernel
from marketflow.operators.asof import asof
from marketflow.sources.shared import written

TRADE = ["log_return", "log_total_qty", "is_open", "time_delta", "num_fills", "book_walk", "effort_vs_result", "climax_score", "prev_seq_time_span"]
BOOK = ["log_spread", "imbalance_l1", "imbalance_l5", "depth_ratio", "trade_vs_mid", "delta_imbalance_l1", "kyle_lambda", "cum_ofi_5"]
FEATURES = [*TRADE, *BOOK]
LABELS = ["wy_stress", "wy_informed_flow", "wy_climax", "wy_spring", "wy_absorption"]
#: Last values that tell the hour of day and are left out of flat features.
PRUNED = ["time_delta_last", "prev_seq_time_span_last"]


def filter_taker(fills: DataFrame) -> DataFrame:
    """Fills of the taking side; needs the column event_type."""
    if "event_type" not in fills.columns:
        raise ValueError("fills need the column event_type")
    return fills.where("event_type = 'fulfill_taker'")


def dedup_by_era(fills: DataFrame, cut: int) -> DataFrame:
    """Sessions before `cut`: the first fill of each counterparty pair; from it on: takers' fills. One pass over both."""
    w = Window.partitionBy(*o.DAY, "ts_ms", "qty", "price").orderBy("recv_ms", "order_id", "l_linenumber")
    early = F.col("session") < cut
    keep = F.when(early, F.row_number().over(w) == 1).otherwise(F.col("event_type") == "fulfill_taker")
    return fills.withColumn("__keep", keep).where("__keep").drop("__keep")


def holdout_guard(rows: DataFrame, first: int, consume: bool = False) -> DataFrame:
    """rows, or an error if any session is held out (`first` or later) and not to be consumed."""
    if consume:
        return rows
    bad = F.raise_error(F.concat(F.lit("session is held out: "), F.col("session").cast("string")))
    return rows.where(F.when(F.col("session") >= first, bad.cast("boolean")).otherwise(F.lit(True)))


def min_rows(rows: DataFrame, least: int) -> DataFrame:
    """Rows of symbol-sessions with at least `least` rows."""
    return places(rows, o.DAY, "ts_ms", ["ts_ms"], {"__at": F.lit(True)}).where(F.col("__at_n") >= least).drop("__at", "__at_n")


def snapshots(book: DataFrame, size: int = 20_000) -> DataFrame:
    """Book features per snapshot, with mid and spread. Changes are taken in spans of `size` snapshots, each with the five before that they reach back to."""
    carried = ["mid", "spread", *[c for c in BOOK if c not in ("trade_vs_mid", "kyle_lambda")]]
    best = [f"{side}1_{what}" for side in ("bid", "ask") for what in ("price", "qty")]
    x = o.depths(o.book_levels(o.expand_levels(book))).select(*o.DAY, "ts_ms", "snap_id", "__depth", *best, *[c for c in carried if c not in ("delta_imbalance_l1", "cum_ofi_5")])
    x = places(x, o.DAY, "ts_ms", ["ts_ms", "snap_id"], {"__at": F.lit(True)}).withColumn("__at", F.col("__at") - 1)
    x = spans(x, "__at", size, 5, 0)
    x = o.flow_changes(o.imbalance_change(x, [*o.DAY, "span"]), [*o.DAY, "span"])
    return x.where(F.expr(f"__at div {size}") == F.col("span")).select(*o.DAY, "ts_ms", "snap_id", *carried)


def trade_kyle(snaps: DataFrame, flows: DataFrame) -> DataFrame:
    """snaps with kyle_lambda: slope of mid changes on the cumulative signed notional of the trades.

    flows: symbol, session, snap_id (null: before the first snapshot, which gets them), signed_notional.
    """
    w = o.ordered("ts_ms", "snap_id")
    x = snaps.withColumn("__first", F.row_number().over(w) == 1)
    sums = flows.where("snap_id is not null").groupBy(*o.DAY, "snap_id").agg(F.sum("signed_notional").alias("__s"))
    early = flows.where("snap_id is null").groupBy(*o.DAY).agg(F.sum("signed_notional").alias("__e"))
    x = x.join(sums, [*o.DAY, "snap_id"], "left").join(early, o.DAY, "left")
    flow = F.coalesce("__s", F.lit(0.0)) + F.when(F.col("__first"), F.coalesce("__e", F.lit(0.0))).otherwise(0.0)
    x = x.withColumn("__f", flow).withColumn("cum_flow", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return o.kyle_lambda(x, "mid", "cum_flow", ["ts_ms", "snap_id"]).drop("__first", "__s", "__e", "__f")


def aligned(events: DataFrame, snaps: DataFrame) -> DataFrame:
    """Events with snap_id, mid and spread of the last snapshot at or before them (null before the first)."""
    return asof(events, snaps.withColumn("__id", F.col("snap_id")), o.DAY, "ts_ms", "ts_ms", ["snap_id", "mid", "spread"], "__id").drop("asof_time")


def spans(rows: DataFrame, place: str, size: int, back: int, ahead: int) -> DataFrame:
    """rows with span: place div size, and copies for the span after, of the last `back` rows of a span, and for the one before, of the first `ahead`. Both are less than size."""
    own = F.expr(f"{place} div {size}")
    near = F.sequence(F.greatest(F.expr(f"({place} - {ahead}) div {size}"), F.lit(0).cast("long")), F.expr(f"({place} + {back}) div {size}"))
    return rows.withColumn("span", F.explode(F.when(own >= 0, near)))


def stacked(snaps: DataFrame, events: DataFrame) -> DataFrame:
    """Both in one table, snapshots with __side 0 before the events of their time."""
    return snaps.withColumn("__side", F.lit(0)).unionByName(events.withColumn("__side", F.lit(1)), allowMissingColumns=True)


def impacts(snaps: DataFrame, trades: DataFrame, width: int, size: int) -> DataFrame:
    """snaps with kyle_lambda, the slope of mid changes on the cumulative signed notional of the trades up to the next snapshot, and __at, their place; sessions with fewer than two are left out.

    Trades before the first snapshot count with it. A session goes through arrays in spans of `size` snapshots, each with the `width` before. As a slope does not hang on where
    a sum starts, a span adds up its own trades.
    """
    x = places(stacked(snaps, trades.select(*o.DAY, "ts_ms", "signed_notional")), o.DAY, "ts_ms", ["ts_ms", "__side", "snap_id"], {"__at": F.col("__side") == 0})
    x = x.where("__at_n >= 2").withColumn("__at", F.greatest(F.col("__at") - 1, F.lit(0)))
    own = [c for c in snaps.columns if c not in o.DAY]
    x = x.groupBy(*o.DAY, "__at").agg(*[F.max(c).alias(c) for c in own], F.coalesce(F.sum("signed_notional"), F.lit(0.0)).alias("__flow"))  # one of a place's rows is a snapshot
    schema = ", ".join([*(f"{c} {k}" for c, k in snaps.dtypes), "kyle_lambda double, __at long"])

    def of(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("__at")
        s["kyle_lambda"] = kernel.price_impact(s["mid"].to_numpy(), s["__flow"].to_numpy().cumsum(), width)
        return s[s["__at"] >= key[-1] * size].drop(columns=["__flow", "span"])

    return spans(x, "__at", size, width, 0).groupBy(*o.DAY, "span").applyInPandas(of, schema)


def event_features(fills: DataFrame, book: DataFrame, cut: int, holdout: int, consume: bool = False, least: int = 400, snaps: Callable[[DataFrame], DataFrame] = snapshots, size: int = 20_000) -> DataFrame:
    """symbol, session, ts_ms, the 17 features, direction labels (null without a later event), the five event labels, and event_idx and n_events, the place in the session and its events.

    Sessions with fewer than two snapshots or fewer than `least` events with a snapshot at or before them give no rows.
    snaps: how a book becomes snapshot features. Events and snapshots are written once to the shared folder; an event finds its snapshot by that one's place, counted in cells of
    time. Arrays then do the features and the labels of spans of `size` events. A span also has the events that its frames reach back to (features over o.WIDTH, labels over
    o.WIDTH features) and that its labels look ahead to, so no window, group or array holds a session and a task's memory does not hang on a session's length.
    """
    width, length, horizons = o.WIDTH, o.LENGTH, o.HORIZONS
    back, ahead = max(2 * width, length) + 1, max(horizons)
    if size <= max(back, ahead):
        raise ValueError("a span must be longer than what its labels look back and ahead")
    events = o.order_events(dedup_by_era(holdout_guard(fills, holdout, consume), cut))
    events = written(events.select(*o.DAY, "ts_ms", "total_qty", "vwap", "is_open_frac", "n_fills", "book_walk_abs", "signed_notional"))
    labels = [f"dir_h{h}" for h in horizons]
    out = [*o.DAY, "ts_ms", *FEATURES, *labels, *LABELS, "event_idx", "n_events"]
    carried = [c for c in BOOK if c not in ("trade_vs_mid", "kyle_lambda")]
    snap = written(snaps(book).select(*o.DAY, "ts_ms", "snap_id", "mid", "spread", *carried))
    found = impacts(snap, events, 50, size).select(*o.DAY, F.col("__at").alias("__snap"), "mid", "spread", *carried, "kyle_lambda")
    first = snap.groupBy(*o.DAY).agg(F.min("ts_ms").alias("__first"))  # a row a session
    known = events.drop("signed_notional").join(first, o.DAY).where("ts_ms >= __first").drop("__first")
    x = places(stacked(snap.select(*o.DAY, "ts_ms", "snap_id"), known), o.DAY, "ts_ms", ["ts_ms", "__side", "snap_id"], {"__snap": F.col("__side") == 0, "__at": F.col("__side") == 1})
    x = x.where((F.col("__side") == 1) & (F.col("__at_n") >= least)).withColumns({"__snap": F.col("__snap") - 1, "__at": F.col("__at") - 1})
    x = x.drop("snap_id", "__side", "__snap_n").join(found, [*o.DAY, "__snap"]).drop("__snap")

    def of(key: tuple, e: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values("__at")
        x = {c: e[c].to_numpy() for c in e.columns if c not in o.DAY}
        price = x["vwap"]
        x["trade_vs_mid"] = np.clip((price - x["mid"]) / np.maximum(x["spread"], x["mid"] * 1e-8), -5, 5)
        x |= kernel.trade(x, width, length)
        x |= kernel.event_labels(x, width)
        for h in horizons:
            up = pd.array(np.zeros(len(price)), "Int32")
            up[: max(len(price) - h, 0)] = (price[h:] > price[: max(len(price) - h, 0)]).astype(np.int32)
            up[max(len(price) - h, 0) :] = pd.NA
            x[f"dir_h{h}"] = up
        x["event_idx"], x["n_events"] = x["__at"], x["__at_n"]
        own = x["__at"] // size == key[-1]
        return pd.DataFrame({c: x[c][own] for c in out if c not in o.DAY}).assign(**dict(zip(o.DAY, key[:-1], strict=True)))[out]

    kinds = dict(events.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in o.DAY), "ts_ms long", *(f"{c} double" for c in FEATURES), *(f"{c} int" for c in [*labels, *LABELS]), "event_idx long, n_events long"])
    return spans(x, "__at", size, back, ahead).groupBy(*o.DAY, "span").applyInPandas(of, schema)


def window_rows(features: DataFrame, length: int, stride: int) -> DataFrame:
    """A row for each event of each window: window_start, pos, first_ts, the features, and the labels of the window's last event."""
    x = o.numbered(features).withColumn("__last", F.col("n_events") - length).where("__last >= 0")
    lo, hi = F.greatest(F.ceil((F.col("event_idx") - (length - 1)) / stride), F.lit(0)), F.floor(F.least("event_idx", "__last") / stride)
    x = x.withColumn("__lo", lo).withColumn("__hi", hi).where("__hi >= __lo").withColumn("__w", F.explode(F.sequence("__lo", "__hi"))).withColumn("window_start", F.col("__w") * stride)
    whole = Window.partitionBy(*o.DAY, "window_start")
    labels = [*[f"dir_h{h}" for h in o.HORIZONS], *LABELS]
    ends = {c: F.max(F.when(F.col("pos") == length - 1, F.col(c))).over(whole) for c in labels}
    x = x.withColumn("pos", F.col("event_idx") - F.col("window_start")).withColumns({"first_ts": F.min("ts_ms").over(whole), **ends})
    return x.select(*o.DAY, "window_start", "pos", "first_ts", "ts_ms", *FEATURES, *labels)


def window_wyckoff(features: DataFrame, length: int = 200, stride: int = 200) -> DataFrame:
    """Per window: absorption, buying and selling climax, stress (0 or 1) and the climax seed score."""
    x = window_rows(features, length, stride)
    within = lambda c, a, b: F.when(F.col("pos").between(a, b - 1), F.col(c))
    half, quarter, prior = length // 2, length * 3 // 4, length // 4
    std_full, std_recent = F.stddev_pop("log_return") + 1e-12, F.stddev_pop(within("log_return", half, length))
    peak, last, before = F.max(within("climax_score", quarter, length)), F.avg(within("log_return", quarter, length)), F.avg(within("log_return", prior, quarter))
    flag = lambda c: c.cast("int")
    return x.groupBy(*o.DAY, "window_start").agg(
        flag((F.avg(within("effort_vs_result", half, length)) > 1.5) & (std_recent < std_full * 0.5) & (F.avg(within("log_total_qty", half, length)) > 0.5)).alias("is_absorption"),
        flag((peak > 2.5) & (last > 0) & (before > 0)).alias("is_buying_climax"),
        flag((peak > 2.5) & (last < 0) & (before < 0)).alias("is_selling_climax"),
        flag((peak > 3.0) & (std_recent > std_full * 1.5)).alias("is_stressed"),
        peak.alias("climax_seed"),
    )
