"""Fills to order events, book features, labels and rolling statistics, per symbol and session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marketflow.operators import session_kernel as kernel

#: Rolling frames and windows of events, in events.
WIDTH, LENGTH, STRIDE = 1000, 200, 50
HORIZONS = [10, 50, 100, 500]
DAY = ["symbol", "session"]
OPEN_SIDES = ["open_long", "close_short"]


def ordered(*by: str) -> Window:
    return Window.partitionBy(*DAY).orderBy(*by)


def dedup_counterparty(fills: DataFrame) -> DataFrame:
    """Of fills of one (ts_ms, qty, price) the first received; the side does not count."""
    w = Window.partitionBy(*DAY, "ts_ms", "qty", "price").orderBy("recv_ms", "order_id", "l_linenumber")
    return fills.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def order_events(fills: DataFrame) -> DataFrame:
    """One row per (symbol, session, ts_ms): quantity, vwap, share of buying fills, fills, |last - first price|, signed notional."""
    spot = F.struct("recv_ms", "order_id", "l_linenumber")
    return fills.groupBy(*DAY, "ts_ms").agg(
        F.sum("qty").alias("total_qty"),
        (F.sum(F.col("qty") * F.col("price")) / F.sum("qty")).alias("vwap"),
        F.avg(F.col("side").isin(OPEN_SIDES).cast("double")).alias("is_open_frac"),
        F.count("*").alias("n_fills"),
        F.abs(F.max_by("price", spot) - F.min_by("price", spot)).alias("book_walk_abs"),
        F.sum(F.when(F.col("side").isin(OPEN_SIDES), 1).otherwise(-1) * F.col("qty") * F.col("price")).alias("signed_notional"),
    )


def order_event_stats(fills: DataFrame) -> DataFrame:
    """Per symbol: rows, distinct rows with and without side, events, mixed-side and multi-fill events, fills per event."""
    per = fills.groupBy("symbol", "ts_ms").agg(F.count("*").alias("n"), F.count_distinct("side").alias("sides"))
    a = per.groupBy("symbol").agg(F.count("*").alias("n_events"), F.count_if(F.col("sides") > 1).alias("mixed_side"), F.count_if(F.col("n") > 1).alias("multi_fill"), F.avg("n").alias("avg_fills"), F.max("n").alias("max_fills"))
    b = fills.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count_distinct("ts_ms", "qty", "price", "side").alias("distinct_with_side"), F.count_distinct("ts_ms", "qty", "price").alias("distinct_without_side"))
    return a.join(b, "symbol")


def direction_labels(events: DataFrame, horizons: list[int]) -> DataFrame:
    """dir_h: whether vwap is higher h events later; null for the last h events of a session."""
    w = ordered("ts_ms")
    return events.withColumns({f"dir_h{h}": F.when(F.lead("vwap", h).over(w).isNotNull(), (F.lead("vwap", h).over(w) > F.col("vwap")).cast("int")) for h in horizons})


def direction_base_rate(events: DataFrame, horizons: list[int]) -> DataFrame:
    """Per symbol and horizon: ups, downs and ups / (ups + downs); ties are left out."""
    w = ordered("ts_ms")
    diff = events.withColumns({f"d{h}": F.lead("vwap", h).over(w) - F.col("vwap") for h in horizons})
    long = diff.selectExpr("symbol", f"stack({len(horizons)}, {', '.join(f'{h}, d{h}' for h in horizons)}) as (h, d)")
    out = long.groupBy("symbol", "h").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    return out.withColumn("up_rate", F.col("up") / F.nullif(F.col("up") + F.col("down"), F.lit(0)))


def rolling(rows: DataFrame, stats: dict[str, tuple], order: str | list[str] = "ts_ms") -> DataFrame:
    """rows with causal rolling statistics per symbol and session: name -> (column, mean, std, min or a quantile, width, least rows).

    Quantiles of long frames cost Spark's window a sort a row, so a session goes through pandas' rolling kernel, which
    keeps its frame sorted. A session's events are a bounded group: a day of one symbol.
    """

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable" if isinstance(order, str) else "quicksort")
        found = {}
        for name, (column, how, width, least) in stats.items():
            frame = pdf[column].astype("float64").rolling(width, min_periods=least)
            found[name] = frame.quantile(how) if isinstance(how, float) else getattr(frame, how)()
        return pdf.assign(**found)

    fields = [*rows.schema.fields, *[StructField(name, DoubleType()) for name in stats]]
    return rows.groupBy(*DAY).applyInPandas(of, StructType(fields))


def trade_features(events: DataFrame, width: int = WIDTH, span: int = LENGTH) -> DataFrame:
    """The nine trade features (kernel.trade) of order events that carry the spread and mid of their book snapshot, and events' columns."""
    names = ["log_return", "log_total_qty", "is_open", "time_delta", "num_fills", "book_walk", "effort_vs_result", "climax_score", "prev_seq_time_span"]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        return pdf.assign(**kernel.trade({c: pdf[c].to_numpy() for c in pdf.columns}, width, span))

    return events.groupBy(*DAY).applyInPandas(of, StructType([*events.schema.fields, *[StructField(n, DoubleType()) for n in names]]))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def expand_levels(book: DataFrame, depth: int = 10) -> DataFrame:
    """Nested levels as flat columns; missing levels are 0."""
    cols = {f"{side}{i + 1}_{what}": F.coalesce(F.get(F.col(f"{side}s"), F.lit(i))[what], F.lit(0.0)) for side in ("bid", "ask") for i in range(depth) for what in ("price", "qty")}
    return book.select(*DAY, "ts_ms", "snap_id", *[c.alias(n) for n, c in cols.items()])


def book_levels(flat: DataFrame) -> DataFrame:
    """mid, log spread, imbalance of level 1 and of five levels weighted by 1 / level, and depth ratio of each snapshot by itself."""
    notional = lambda side, i: F.col(f"{side}{i}_price") * F.col(f"{side}{i}_qty")
    total = lambda side, n, weight: sum((notional(side, i) * weight(i) for i in range(2, n + 1)), notional(side, 1) * weight(1))
    x = flat.withColumn("mid", (F.col("bid1_price") + F.col("ask1_price")) / 2).withColumn("spread", F.greatest(F.col("ask1_price") - F.col("bid1_price"), F.lit(1e-10)))
    x = x.withColumn("log_spread", F.log(F.col("spread") / F.greatest("mid", F.lit(1e-10))))
    for name, n, weight in (("imbalance_l1", 1, lambda i: 1.0), ("imbalance_l5", 5, lambda i: 1 / i)):
        b, a = total("bid", n, weight), total("ask", n, weight)
        x = x.withColumn(name, (b - a) / F.greatest(b + a, F.lit(1e-10)))
    return x.withColumn("depth_ratio", F.log(F.greatest(total("bid", 10, lambda i: 1.0), F.lit(1e-6)) / F.greatest(total("ask", 10, lambda i: 1.0), F.lit(1e-6))))


def imbalance_change(levels: DataFrame, by: list[str]) -> DataFrame:
    """levels with delta_imbalance_l1, the change from the snapshot before of the same key; 0 for its first."""
    w = Window.partitionBy(*by).orderBy("ts_ms", "snap_id")
    return levels.withColumn("delta_imbalance_l1", F.coalesce(F.col("imbalance_l1") - F.lag("imbalance_l1").over(w), F.lit(0.0)))


def book_features(flat: DataFrame) -> DataFrame:
    """What book_levels gives, and the change of the imbalance of level 1."""
    return imbalance_change(book_levels(flat), DAY)


def depths(flat: DataFrame) -> DataFrame:
    """flat with tilt, bid less ask notional of ten levels, and __depth, their sum."""
    depth = lambda s: sum((F.col(f"{s}{i}_price") * F.col(f"{s}{i}_qty") for i in range(2, 11)), F.col(f"{s}1_price") * F.col(f"{s}1_qty"))
    return flat.withColumns({"tilt": depth("bid") - depth("ask"), "__depth": depth("bid") + depth("ask")})


def flow_changes(x: DataFrame, by: list[str]) -> DataFrame:
    """x, of `depths`, with ofi and cum_ofi_5 from the snapshots before of the same key."""
    w = Window.partitionBy(*by).orderBy("ts_ms", "snap_id")
    price, was = lambda s: F.col(f"{s}1_price"), lambda s: F.lag(f"{s}1_price").over(w)
    held, left = lambda s: price(s) * F.col(f"{s}1_qty"), lambda s: F.lag(price(s) * F.col(f"{s}1_qty")).over(w)
    more = lambda s: (F.col(f"{s}1_qty") - F.lag(f"{s}1_qty").over(w)) * price(s)
    bid = F.when(price("bid") > was("bid"), held("bid")).when(price("bid") < was("bid"), -left("bid")).otherwise(more("bid"))
    ask = F.when(price("ask") > was("ask"), -left("ask")).when(price("ask") < was("ask"), held("ask")).otherwise(-more("ask"))
    five = w.rowsBetween(-4, 0)
    x = x.withColumn("ofi", F.coalesce(bid + ask, F.lit(0.0)))
    return x.withColumn("cum_ofi_5", F.sum("ofi").over(five) / F.greatest(F.sum("__depth").over(five), F.lit(1e-10))).drop("__depth")


def order_flow(flat: DataFrame) -> DataFrame:
    """ofi: piecewise order-flow imbalance in notional on changes of the best prices, as the sum of both sides' terms; cum_ofi_5:
    its sum over 5 rows, over the notional of ten levels of both sides in them. tilt: bid less ask notional of ten levels."""
    return flow_changes(depths(flat), DAY)


def kyle_lambda(rows: DataFrame, price: str, flow: str, order: list[str], width: int = 50) -> DataFrame:
    """Slope of price changes on flow over `width` full rows; 0 before, and where flow does not vary. A session's first change is 0 and counts."""
    w = ordered(*order)
    frame = w.rowsBetween(-(width - 1), 0)
    x = rows.withColumn("__d", F.coalesce(F.col(price) - F.lag(price).over(w), F.lit(0.0)))
    value = F.covar_samp("__d", flow).over(frame) / F.nullif(F.var_samp(flow).over(frame), F.lit(0.0))
    return x.withColumn("kyle_lambda", F.when(F.count("__d").over(frame) == width, F.coalesce(value, F.lit(0.0))).otherwise(0.0)).drop("__d")


def sweep_cost(levels: Column, size_usd: float, mid: Column, sign: int) -> Column:
    """struct(fillable, avg_price, slip_bps) of taking size_usd from levels in order."""
    start = F.struct(F.lit(float(size_usd)).alias("left"), F.lit(0.0).alias("qty"), F.lit(0.0).alias("paid"))
    step = lambda acc, lv: F.struct(
        (acc["left"] - F.least(acc["left"], lv["price"] * lv["qty"])).alias("left"),
        (acc["qty"] + F.least(acc["left"], lv["price"] * lv["qty"]) / lv["price"]).alias("qty"),
        (acc["paid"] + F.least(acc["left"], lv["price"] * lv["qty"])).alias("paid"),
    )
    end = lambda acc: F.struct(
        (acc["left"] <= 1e-9).alias("fillable"),
        F.when(acc["left"] <= 1e-9, acc["paid"] / acc["qty"]).alias("avg_price"),
        F.when(acc["left"] <= 1e-9, (acc["paid"] / acc["qty"] / mid - 1) * 10_000 * sign).alias("slip_bps"),
    )
    return F.aggregate(F.filter(levels, lambda lv: (lv["price"] > 0) & (lv["qty"] > 0)), start, step, end)


def window_starts(events: DataFrame, length: int, stride: int, offset: int = 0) -> DataFrame:
    """symbol, session, window_start: positions of windows of `length` events that do not cross a session."""
    n = events.groupBy(*DAY).agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= length + offset).select(*DAY, F.explode(F.sequence(F.lit(offset), F.col("n").cast("int") - length, F.lit(stride))).alias("window_start"))


def indexed(events: DataFrame) -> DataFrame:
    return events.withColumn("event_idx", F.row_number().over(ordered("ts_ms")) - 1)


def numbered(events: DataFrame) -> DataFrame:
    """events with event_idx and n_events, the place in their session and its events; those that have them stay as they are."""
    if {"event_idx", "n_events"} <= set(events.columns):
        return events
    return indexed(events).withColumn("n_events", F.count("*").over(Window.partitionBy(*DAY)))


def flat_features(events: DataFrame, columns: list[str], length: int, stride: int, size: int = 400) -> DataFrame:
    """Per window: mean, population deviation, corrected skew and excess kurtosis, last value of each column (kernel.moments).

    A session goes through arrays in spans of `size` windows; only events at the end of a span are copied, to the next one's windows that hold them.
    """
    names = [f"{c}_{s}" for c in columns for s in ("mean", "std", "skew", "kurt", "last")]
    wide = size * stride  # first events of a span's windows

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_idx")
        n = (len(pdf) - length) // stride + 1
        out: dict = {DAY[0]: [key[0]] * n, DAY[1]: [key[1]] * n, "window_start": key[2] * wide + np.arange(n) * stride}
        for c in columns:
            out |= {f"{c}_{k}": v for k, v in kernel.moments(pdf[c].to_numpy(np.float64), length, stride).items()}
        return pd.DataFrame(out, columns=[*DAY, "window_start", *names])

    kinds = dict(events.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in DAY), "window_start long", *(f"`{n}` double" for n in names)])
    first = F.greatest(F.expr(f"(event_idx - {length - 1}) div {wide}"), F.lit(0).cast("long"))
    places = [c for c in ("event_idx", "n_events") if c in events.columns]
    x = numbered(events.select(*DAY, "ts_ms", *columns, *places))
    fits = F.filter(F.sequence(first, F.expr(f"event_idx div {wide}")), lambda c: c * wide + length <= F.col("n_events"))  # a span without a window gives no group
    x = x.withColumn("span", F.explode(fits)).drop("n_events")
    return x.groupBy(*DAY, "span").applyInPandas(of, schema)


def bursts(rows: DataFrame, gap_ms: int, least: int = 2, min_bps: float = 10.0) -> DataFrame:
    """Runs of rows of a symbol with at most gap_ms between neighbours, of `least` rows or more with positive prices that move
    by min_bps (of the log return) at least: islands by a running sum."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", "tie")
    x = rows.withColumn("__new", (F.col("ts_ms") - F.lag("ts_ms").over(w) > gap_ms).cast("int")).withColumn("burst", F.sum(F.coalesce("__new", F.lit(0))).over(w))
    spot = F.struct("ts_ms", "tie")
    out = x.groupBy("symbol", "burst").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n_trades"), F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("price")).alias("notional"),
        F.min_by("price", spot).alias("start_price"), F.max_by("price", spot).alias("end_price"),
    )
    move = F.log(F.col("end_price") / F.col("start_price")) * 10_000
    kept = out.where((F.col("n_trades") >= least) & (F.col("start_price") > 0) & (F.col("end_price") > 0)).withColumn("move_bps", move)
    return kept.where(F.abs("move_bps") >= min_bps).withColumn("direction", F.signum("move_bps").cast("int"))
