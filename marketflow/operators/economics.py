"""Economics of windows against the order book: what taking and making would have cost and earned.

Events and snapshots are stacked and go to their symbol's session in one exchange; every snapshot finds its event there, so the
book before an anchor, and the best prices while an order would have rested, come from that one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.operators import order_events as o
from marketflow.operators.asof import asof
from marketflow.operators.evaluation import best_levels, burst_metrics, headroom


def anchored(events: DataFrame, book: DataFrame, length: int, stride: int, horizons: list[int], depth: bool = False) -> DataFrame:
    """The last event of each window of `length` events, every `stride` events: symbol, session, window_start, anchor_ts, anchor_mid, and r, an array with a struct
    for each horizon h (in events) that the session reaches: horizon, fwd (log return), end_ts, low_ask and high_bid (over the snapshots from anchor_ts to end_ts).
    depth: also bids and asks of the last snapshot at or before the anchor. Anchors without such a snapshot, or whose book lacks a side, are left out.

    events: symbol, session, ts_ms, vwap, one row a time. book: symbol, session, ts_ms, snap_id, bids, asks, one row a snapshot; of snapshots of one time the greatest snap_id counts as the last.
    """
    bid, ask = best_levels(F.col("bids"), F.col("asks"))
    names = ["ts_ms", "snap_id", "bid", "ask"]
    e = events.select(*o.DAY, "ts_ms", "vwap")
    b = book.select(*o.DAY, "ts_ms", F.struct("ts_ms", "snap_id", bid.alias("bid"), ask.alias("ask")).alias("snap"))
    upto = Window.partitionBy(*o.DAY).orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, 0)
    own = F.col("vwap").isNotNull()
    x = e.unionByName(b, allowMissingColumns=True).withColumns({"idx": F.count("vwap").over(upto) - 1, "event_ts": F.max(F.when(own, F.col("ts_ms"))).over(upto), "last": F.max("snap").over(upto)}).where("idx >= 0")
    # a row an event: its own, the book it meets, and the best prices from it to the next event and at its very time
    at = F.col("ts_ms") == F.col("event_ts")
    x = x.groupBy(*o.DAY, "idx").agg(
        F.max("event_ts").alias("ts"), F.max("vwap").alias("vwap"), *[F.max(F.when(own, F.col(f"last.{c}"))).alias(f"last_{c}") for c in names],
        F.min("snap.ask").alias("low"), F.max("snap.bid").alias("high"), F.min(F.when(at, F.col("snap.ask"))).alias("low_at"), F.max(F.when(at, F.col("snap.bid"))).alias("high_at"),
    )
    w = Window.partitionBy(*o.DAY).orderBy("idx")
    parts = []
    for h in horizons:
        span = w.rowsBetween(0, h - 1)
        parts.append(
            F.when(
                F.lead("ts", h).over(w).isNotNull(),
                F.struct(
                    F.lit(h).alias("horizon"), F.log(F.lead("vwap", h).over(w) / F.col("vwap")).alias("fwd"), F.lead("ts", h).over(w).alias("end_ts"),
                    F.least(F.min("low").over(span), F.lead("low_at", h).over(w)).alias("low_ask"), F.greatest(F.max("high").over(span), F.lead("high_at", h).over(w)).alias("high_bid"),
                ),
            )
        )
    first = F.col("idx") - (length - 1)
    x = x.withColumn("r", F.filter(F.array(*parts), lambda s: s.isNotNull())).where((first >= 0) & (first % stride == 0))
    mid = (F.col("last_bid") + F.col("last_ask")) / 2
    out = [*o.DAY, first.alias("window_start"), F.col("ts").alias("anchor_ts"), mid.alias("anchor_mid"), "r"]
    x = x.where(mid > 0)
    if not depth:
        return x.select(*out)
    # levels do not go through the windows: only anchors fetch theirs
    levels = book.select(*o.DAY, F.col("ts_ms").alias("last_ts_ms"), F.col("snap_id").alias("last_snap_id"), "bids", "asks")
    return x.select(*out, "last_ts_ms", "last_snap_id").join(levels, [*o.DAY, "last_ts_ms", "last_snap_id"]).drop("last_ts_ms", "last_snap_id")


def taker_rows(events: DataFrame, book: DataFrame, length: int, stride: int, horizons: list[int], sizes: list[float], fees_bps: float) -> DataFrame:
    """A row for each window, size and horizon: fillable (both sides), slip_buy_bps, slip_sell_bps and their mean size slip_avg_bps, edge_bps (size of the forward move), headroom_bps.

    Slips are null where a side's levels do not hold the size, edges where the session ends before the horizon; headroom needs both.
    """
    x = anchored(events, book, length, stride, horizons, depth=True)
    legs = [F.struct(F.lit(float(s)).alias("size_usd"), o.sweep_cost(F.col("asks"), s, F.col("anchor_mid"), 1).alias("buy"), o.sweep_cost(F.col("bids"), s, F.col("anchor_mid"), -1).alias("sell")) for s in sizes]
    x = x.withColumn("leg", F.explode(F.array(*legs))).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    edge = F.abs(F.get(F.filter("r", lambda s: s["horizon"] == F.col("horizon")), F.lit(0))["fwd"]) * 10_000
    x = x.withColumns({"slip_buy_bps": F.col("leg.buy.slip_bps"), "slip_sell_bps": F.col("leg.sell.slip_bps"), "edge_bps": edge})
    x = x.withColumn("slip_avg_bps", (F.abs("slip_buy_bps") + F.abs("slip_sell_bps")) / 2)
    return x.select(*o.DAY, "window_start", "anchor_ts", "leg.size_usd", "horizon", (F.col("leg.buy.fillable") & F.col("leg.sell.fillable")).alias("fillable"), "slip_buy_bps", "slip_sell_bps", "slip_avg_bps", "edge_bps", headroom(F.col("edge_bps"), F.col("slip_avg_bps"), fees_bps).alias("headroom_bps"))


def maker_rows(events: DataFrame, book: DataFrame, length: int, stride: int, horizons: list[int], offsets: list[float]) -> DataFrame:
    """A row for each window, horizon within the session, and offset in bps from the mid: limit prices, whether an opposite best price touched them by the
    horizon's end, mid_at_horizon (the anchor's mid moved by the forward return) and what each filled side gained by then, in bps (null where it was not filled)."""
    x = anchored(events, book, length, stride, horizons).withColumn("h", F.explode("r")).withColumn("offset_bps", F.explode(F.array(*[F.lit(float(v)) for v in offsets])))
    c = F.col
    x = x.withColumns({"bid_price": c("anchor_mid") * (1 - c("offset_bps") / 1e4), "ask_price": c("anchor_mid") * (1 + c("offset_bps") / 1e4), "mid_at_horizon": c("anchor_mid") * F.exp("h.fwd")})
    x = x.withColumns({"bid_filled": F.coalesce(c("h.low_ask") <= c("bid_price"), F.lit(False)), "ask_filled": F.coalesce(c("h.high_bid") >= c("ask_price"), F.lit(False))})
    return x.select(
        *o.DAY, "window_start", "anchor_ts", "anchor_mid", "h.horizon", "offset_bps", "bid_price", "ask_price", "bid_filled", "ask_filled", F.col("h.end_ts").alias("fill_horizon_ts"), "mid_at_horizon",
        F.when(c("bid_filled") & (c("bid_price") > 0), (c("mid_at_horizon") - c("bid_price")) / c("bid_price") * 1e4).alias("realized_bid_pnl_bps"), F.when(c("ask_filled") & (c("ask_price") > 0), (c("ask_price") - c("mid_at_horizon")) / c("ask_price") * 1e4).alias("realized_ask_pnl_bps"),
    )


def breakeven(expected: Column, fee_bps: float) -> Column:
    """The accuracy at which expected gains cover the fee; infinite where nothing is gained and a fee is due."""
    return F.when(expected == 0, 0.5 if fee_bps == 0 else float("inf")).otherwise(0.5 + fee_bps / expected)


def adverse_cells(rows: DataFrame, by: list[str], fee_bps: float) -> DataFrame:
    """by of maker_rows(): windows, fill rates of either side and of any, mean, median and quartiles of the filled sides' gains, the mean and median of both together, the gain
    of always posting both, and the accuracy that breaks even. The two sides of a window filled twice are two samples."""
    # a row a side, so that the rows, which are dear, are worked out once, and each column's quantiles come from one sorted count
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"realized_{s}_pnl_bps").alias("v")) for s in ("bid", "ask")])
    x = rows.select(*by, "bid_filled", "ask_filled", F.explode(sides).alias("x")).select(*by, "bid_filled", "ask_filled", "x.side", "x.v")
    rate = lambda c: F.avg(c.cast("double"))
    aggs = [F.count_if(F.col("side") == "bid").alias("n_windows"), rate(F.col("bid_filled")).alias("fill_rate_bid"), rate(F.col("ask_filled")).alias("fill_rate_ask"), rate(F.col("bid_filled") | F.col("ask_filled")).alias("fill_rate_either")]
    for side in ("bid", "ask"):
        v = F.when(F.col("side") == side, F.col("v"))
        aggs += [F.avg(v).alias(f"mean_pnl_{side}_filled"), F.percentile(v, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias(f"__{side}")]
    x = x.groupBy(*by).agg(*aggs, F.avg("v").alias("mean_pnl_either_filled"), F.percentile("v", 0.5).alias("median_pnl_either_filled"))
    out = x.withColumns({f"{n}_pnl_{side}_filled": F.get(f"__{side}", F.lit(i)) for side in ("bid", "ask") for i, n in enumerate(("median", "q25", "q75"))}).drop("__bid", "__ask")
    gain = lambda side: F.col(f"fill_rate_{side}") * F.coalesce(F.col(f"mean_pnl_{side}_filled"), F.lit(0.0))
    return out.withColumns({"unconditional_maker_pnl_bps": (gain("bid") + gain("ask")) / 2 - 2 * fee_bps, "model_accuracy_breakeven": breakeven(F.col("mean_pnl_either_filled"), fee_bps)})


def spring_argmin(features: DataFrame, sigma: float, back: int = 50, near: int = 10, width: int = 1000) -> DataFrame:
    """features with min_return, evr_at_min, is_open_at_min and spring: the least log return of the event and the `back` before it (the first of equals), with that row's
    effort against result and share of opening, and whether a spring fires: the least return lies more than sigma rolling deviations below 0, the
    row's effort is above 1 and its share above one half, and the mean return of the event and the `near` before is positive. Null values where there are fewer rows; a spring
    never fires there. Deviations of fewer than ten rows count as 1e-6."""
    w = o.ordered("ts_ms")
    frame, short = w.rowsBetween(-back, 0), w.rowsBetween(-near, 0)
    # the least struct: by return, then by place, so that the row's own columns come along
    x = features.withColumn("__i", F.row_number().over(w)).withColumn("__m", F.min(F.struct("log_return", "__i", F.col("effort_vs_result").alias("e"), F.col("is_open").alias("p"))).over(frame))
    x = x.withColumns({"__x": F.sum("log_return").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__xx": F.sum(F.col("log_return") * F.col("log_return")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    n = F.least(F.col("__i"), F.lit(width))
    before = lambda c: F.coalesce(F.lag(c, width).over(w), F.lit(0.0))
    total, squares = F.col("__x") - before("__x"), F.col("__xx") - before("__xx")
    deviation = F.when(n >= 10, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0)))).otherwise(1e-6)
    full = F.col("__i") > back
    got = lambda c: F.when(full, F.col(f"__m.{c}"))
    x = x.withColumns({"min_return": got("log_return"), "evr_at_min": got("e"), "is_open_at_min": got("p"), "__dev": deviation, "__near": F.avg("log_return").over(short)})
    fires = (F.col("min_return") < -sigma * F.col("__dev")) & (F.col("evr_at_min") > 1) & (F.col("is_open_at_min") > 0.5) & (F.col("__near") > 0)
    return x.withColumn("spring", F.coalesce(fires, F.lit(False))).drop("__i", "__m", "__x", "__xx", "__dev", "__near")


def spring_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, windows (events with a full frame), fires and their share of spring_argmin()."""
    return rows.groupBy(*by).agg(F.count("min_return").alias("windows"), F.count_if("spring").alias("fires")).withColumn("rate", F.col("fires") / F.greatest("windows", F.lit(1)))


def post_cascade_rows(bursts: DataFrame, events: DataFrame, delays: list[int], horizons: list[int], cost_bps: float) -> DataFrame:
    """A row for each burst, delay and horizon (in events) that the session reaches: the forward log return from `delay` events after the last event at or before the burst's end,
    and what going on or turning back would have gained (burst_metrics).

    bursts: symbol, session, start_ms, end_ms, n_trades, notional, move_bps, direction. events: symbol, session, ts_ms, vwap, one row a time. Bursts before the first event give none.
    """
    w = o.ordered("ts_ms")
    steps = {(d, h): F.log(F.lead("vwap", d + h).over(w) / (F.lead("vwap", d).over(w) if d else F.col("vwap"))) for d in delays for h in horizons}
    x = events.select(*o.DAY, "ts_ms", (F.row_number().over(w) - 1).alias("anchor_idx"), F.array(*[F.struct(F.lit(d).alias("delay_events"), F.lit(h).alias("horizon"), v.alias("forward_log_return")) for (d, h), v in steps.items()]).alias("grid"))
    found = asof(bursts, x.withColumn("__tie", F.lit(0)), o.DAY, "end_ms", "ts_ms", ["anchor_idx", "grid"], "__tie").where("anchor_idx is not null")
    out = found.withColumn("g", F.explode("grid")).where("g.forward_log_return is not null").select(*bursts.columns, "anchor_idx", "g.*")
    return out.withColumn("round_trip_cost_bps", F.lit(float(cost_bps))).withColumns(burst_metrics(F.col("move_bps"), F.col("forward_log_return"), cost_bps))


def burst_regime_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, bursts, sessions, symbols, median and mean net result, share above 0, median gross result of turning back."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_events"), F.count_distinct("session").alias("n_days"), F.count_distinct("symbol").alias("n_symbols"), F.percentile("net_reversion_bps", 0.5).alias("median_net_bps"), F.avg("net_reversion_bps").alias("mean_net_bps"),
        F.avg((F.col("net_reversion_bps") > 0).cast("double")).alias("frac_positive"), F.percentile("gross_reversion_bps", 0.5).alias("median_gross_reversion_bps"),
    )


def maker_sensitivity(rows: DataFrame, fees_bps: list[float], accuracies: list[float], share: float = 0.5, least_bps: float = 0.0, touch_bps: float = 1.0) -> DataFrame:
    """Per maker fee and accuracy: cells (symbol, size_usd, horizon) whose median headroom exceeds least_bps and is positive in more than `share` of the fillable windows with an edge;
    those of them whose edge also reaches touch_bps in more than `share`; and the five with the highest medians, by label among equals.

    Headroom, (2 p - 1) x edge - 2 x fee, grows with the edge (p of one half or more), so a cell's median edge and counts of edges give it for the whole grid: rows are not copied to it.
    """
    if min(accuracies) < 0.5:
        raise ValueError("accuracies below one half are no signal")
    cell = ["symbol", "size_usd", "horizon"]
    edge = F.when(F.col("fillable"), F.abs("edge_bps"))
    x = rows.withColumn("__e", edge).where(F.col("__e").isNotNull())
    grid = [(float(f), float(p)) for p in accuracies for f in fees_bps]
    positive = [F.avg(((2 * p - 1) * F.col("__e") - 2 * f > 0).cast("double")) for f, p in grid]
    x = x.groupBy(*cell).agg(F.percentile("__e", 0.5).alias("__m"), F.avg((F.col("__e") >= touch_bps).cast("double")).alias("__t"), F.array(*positive).alias("__p"))
    each = F.array(*[F.struct(F.lit(f).alias("maker_fee_bps"), F.lit(p).alias("accuracy"), ((2 * p - 1) * F.col("__m") - 2 * f).alias("median"), F.get("__p", F.lit(i)).alias("positive")) for i, (f, p) in enumerate(grid)])
    x = x.select(*cell, "__t", F.explode(each).alias("g")).select(*cell, "__t", "g.*")
    alive = (F.col("median") > least_bps) & (F.col("positive") > share)
    label = F.format_string("%s:$%dk:H%d", F.col("symbol"), F.floor(F.col("size_usd") / 1000).cast("long"), F.col("horizon").cast("long"))
    best = F.slice(F.array_sort(F.collect_list(F.when(alive, F.struct((-F.col("median")).alias("m"), label.alias("l"))))), 1, 5)  # of one row a cell
    out = x.groupBy("maker_fee_bps", "accuracy").agg(F.count_if(alive).alias("n_cells_alive"), F.count_if(alive & (F.col("__t") > share)).alias("n_cells_alive_with_fill_proxy"), best.alias("b"))
    return out.withColumn("top_5_cells_by_median_headroom", F.array_join(F.transform("b", lambda s: F.format_string("%s(%+.2fbp)", s["l"], -s["m"])), ", ")).drop("b")
