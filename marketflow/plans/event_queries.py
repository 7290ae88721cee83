"""Queries over fills, order events, books, as-of joins, labels and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketflow.functions.quantiles import group_quantiles
from marketflow.operators import asof
from marketflow.operators import order_events as o
from marketflow.registry import query, view
from marketflow.sources import adapters as a

W = "partition by symbol, session order by ts_ms"
view("dedup", "select * exclude (n_) from (select *, row_number() over (partition by symbol, session, ts_ms, qty, price order by recv_ms, order_id, l_linenumber) as n_ from fills) where n_ = 1", ["fills"])
view(
    "oev",
    """select symbol, session, ts_ms, sum(qty) as total_qty, sum(qty * price) / sum(qty) as vwap, avg((side in ('open_long', 'close_short'))::int::double) as is_open_frac, count(*) as n_fills,
    abs(arg_max(price, (recv_ms, order_id, l_linenumber)) - arg_min(price, (recv_ms, order_id, l_linenumber))) as book_walk_abs,
    sum(case when side in ('open_long', 'close_short') then 1 else -1 end * qty * price) as signed_notional from dedup group by all""",
    ["dedup"],
)


def events(spark, sf_dir):
    return o.order_events(o.dedup_counterparty(a.fills(spark, sf_dir)))


@query("dedup_counterparty", "select symbol, session, ts_ms, qty, price, side, recv_ms from dedup", ["dedup"], "price")
def dedup_counterparty(spark, sf_dir):
    """First fill of each counterparty pair."""
    return o.dedup_counterparty(a.fills(spark, sf_dir)).select("symbol", "session", "ts_ms", "qty", "price", "side", "recv_ms")


@query("order_events", "select * from oev", ["oev"], "total_qty vwap is_open_frac book_walk_abs signed_notional")
def order_events(spark, sf_dir):
    """Fills to order events."""
    return events(spark, sf_dir)


@query(
    "order_event_stats",
    """select * from (select symbol, count(*) as n_events, count(*) filter (sides > 1) as mixed_side, count(*) filter (n > 1) as multi_fill, avg(n) as avg_fills, max(n) as max_fills from
    (select symbol, ts_ms, count(*) as n, count(distinct side) as sides from fills group by all) group by symbol)
    join (select symbol, count(*) as n_rows, count(distinct (ts_ms, qty, price, side)) as distinct_with_side, count(distinct (ts_ms, qty, price)) as distinct_without_side from fills group by symbol) using (symbol)""",
    ["fills"],
    "avg_fills",
)
def order_event_stats(spark, sf_dir):
    """Order-event diagnostics."""
    return o.order_event_stats(a.fills(spark, sf_dir))


@query(
    "events_per_day",
    "select symbol, count(*) as n_days, median(n) as median_events, quantile_cont(n, 0.1) as p10, quantile_cont(n, 0.9) as p90, min(n) as least, max(n) as most, sum(n)::bigint as total from (select symbol, session, count(distinct ts_ms) as n from fills group by all) group by symbol",
    ["fills"],
    "median_events p10 p90",
)
def events_per_day(spark, sf_dir):
    """Distribution of events per session."""
    n = a.fills(spark, sf_dir).groupBy("symbol", "session").agg(F.count_distinct("ts_ms").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return n.groupBy("symbol").agg(F.count("*").alias("n_days"), q[1].alias("median_events"), q[0].alias("p10"), q[2].alias("p90"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"))


HZ = o.HORIZONS


@query("direction_labels", f"select symbol, session, ts_ms, {', '.join(f'case when lead(vwap, {h}) over ({W}) is not null then (lead(vwap, {h}) over ({W}) > vwap)::int end as dir_h{h}' for h in HZ)} from oev", ["oev"])
def direction_labels(spark, sf_dir):
    """Labels with a masked tail. Equal neighbours differ by a sum's order only where prices tie exactly."""
    return o.direction_labels(events(spark, sf_dir), HZ).select("symbol", "session", "ts_ms", *[f"dir_h{h}" for h in HZ])


@query(
    "direction_base_rate",
    " union all ".join(f"select symbol, {h} as h, count(*) filter (d > 0) as up, count(*) filter (d < 0) as down, count(*) filter (d > 0) / nullif(count(*) filter (d <> 0), 0)::double as up_rate from (select symbol, lead(vwap, {h}) over ({W}) - vwap as d from oev) group by symbol" for h in HZ),
    ["oev"],
    "up_rate",
)
def direction_base_rate(spark, sf_dir):
    """Ups against downs without ties."""
    return o.direction_base_rate(events(spark, sf_dir), HZ)


@query("window_counts", "select symbol, sum(greatest(0, case when n >= 200 then (n - 200) // 50 + 1 else 0 end))::bigint as windows, count(*) as sessions from (select symbol, session, count(*) as n from oev group by all) group by symbol", ["oev"])
def window_counts(spark, sf_dir):
    """Windows per symbol."""
    ev = events(spark, sf_dir)
    starts = o.window_starts(ev, o.LENGTH, o.STRIDE).groupBy("symbol").agg(F.count("*").alias("windows"))
    return ev.groupBy("symbol").agg(F.count_distinct("session").alias("sessions")).join(starts, "symbol", "left").select("symbol", F.coalesce("windows", F.lit(0)).cast("long").alias("windows"), "sessions")


@query("cadence_stats", "select symbol, count(d) as n, avg(d) as mean_gap, quantile_cont(d, 0.25) as p25, quantile_cont(d, 0.5) as p50, quantile_cont(d, 0.99) as p99 from (select symbol, snap_id, ts_ms - lag(ts_ms) over (partition by symbol order by ts_ms, snap_id) as d from (select distinct symbol, ts_ms, snap_id from levels)) group by symbol", ["levels"], "mean_gap p25 p50 p99")
def cadence_stats(spark, sf_dir):
    """Gaps between snapshots."""
    b = a.book(spark, sf_dir).withColumn("d", F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("symbol").orderBy("ts_ms", "snap_id")))
    gaps = b.groupBy("symbol").agg(F.count("d").alias("n"), F.avg("d").alias("mean_gap"))
    return gaps.join(group_quantiles(b, ["symbol"], {"p25": (F.col("d"), 0.25), "p50": (F.col("d"), 0.5), "p99": (F.col("d"), 0.99)}), "symbol", "left")


_LV = ", ".join(f"coalesce(max({s}{q}) filter (i = {i}), 0) as {s}{i}_{'qty' if q else 'price'}" for s in ("bid", "ask") for i in range(1, 11) for q in ("", "_qty"))
view("flat", f"select symbol, session, ts_ms, snap_id, {_LV} from levels group by symbol, session, ts_ms, snap_id", ["levels"])


@query("expand_levels", "select * from flat", ["flat"], " ".join(f"{s}{i}_{q}" for s in ("bid", "ask") for i in range(1, 11) for q in ("price", "qty")))
def expand_levels(spark, sf_dir):
    """A5: nested levels to 40 columns."""
    return o.expand_levels(a.book(spark, sf_dir))


_nt = lambda s, n, wt: " + ".join(f"{s}{i}_price * {s}{i}_qty * {wt(i)}" for i in range(1, n + 1))
WB = "partition by symbol, session order by ts_ms, snap_id"
view(
    "bookf",
    f"""select *, coalesce(imbalance_l1 - lag(imbalance_l1) over ({WB}), 0) as delta_imbalance_l1 from (select *, (bid1_price + ask1_price) / 2 as mid,
    greatest(ask1_price - bid1_price, 1e-10::double) as spread, ln(greatest(ask1_price - bid1_price, 1e-10::double) / greatest((bid1_price + ask1_price) / 2, 1e-10::double)) as log_spread, (b1 - a1) / greatest(b1 + a1, 1e-10::double) as imbalance_l1, (b5 - a5) / greatest(b5 + a5, 1e-10::double) as imbalance_l5,
    ln(greatest(b10, 1e-6::double) / greatest(a10, 1e-6::double)) as depth_ratio from (select *, {_nt('bid', 1, lambda i: 1)} as b1, {_nt('ask', 1, lambda i: 1)} as a1, {_nt('bid', 5, lambda i: f'(1.0::double / {i})')} as b5, {_nt('ask', 5, lambda i: f'(1.0::double / {i})')} as a5,
    {_nt('bid', 10, lambda i: 1)} as b10, {_nt('ask', 10, lambda i: 1)} as a10 from flat))""",
    ["flat"],
)
_BF = ["mid", "log_spread", "imbalance_l1", "imbalance_l5", "depth_ratio", "delta_imbalance_l1"]


@query("book_features", f"select symbol, session, snap_id, {', '.join(_BF)} from bookf", ["bookf"], " ".join(_BF))
def book_features(spark, sf_dir):
    """Book features."""
    return o.book_features(o.expand_levels(a.book(spark, sf_dir))).select("symbol", "session", "snap_id", *_BF)


_bn, _an = "bid1_price * bid1_qty", "ask1_price * ask1_qty"
view(
    "flow",
    f"""select *, sum(ofi) over ({WB} rows between 4 preceding and current row) / greatest(sum(depth_) over ({WB} rows between 4 preceding and current row), 1e-10::double) as cum_ofi_5 from (select *,
    ({_nt('bid', 10, lambda i: 1)}) - ({_nt('ask', 10, lambda i: 1)}) as tilt, ({_nt('bid', 10, lambda i: 1)}) + ({_nt('ask', 10, lambda i: 1)}) as depth_, case when lag(ts_ms) over ({WB}) is null then 0 else
    case when bid1_price > lag(bid1_price) over ({WB}) then {_bn} when bid1_price < lag(bid1_price) over ({WB}) then -lag({_bn}) over ({WB}) else (bid1_qty - lag(bid1_qty) over ({WB})) * bid1_price end
    + case when ask1_price > lag(ask1_price) over ({WB}) then -lag({_an}) over ({WB}) when ask1_price < lag(ask1_price) over ({WB}) then {_an} else -(ask1_qty - lag(ask1_qty) over ({WB})) * ask1_price end end as ofi from flat)""",
    ["flat"],
)


@query("order_flow", "select symbol, session, snap_id, ofi, cum_ofi_5 from flow", ["flow"], "ofi cum_ofi_5")
def order_flow(spark, sf_dir):
    """Order-flow imbalance."""
    return o.order_flow(o.expand_levels(a.book(spark, sf_dir))).select("symbol", "session", "snap_id", "ofi", "cum_ofi_5")


@query(
    "kyle_lambda",
    f"""select symbol, session, snap_id, case when count(*) over w50 = 50 then coalesce(covar_samp(d, tilt) over w50 / nullif(var_samp(tilt) over w50, 0), 0) else 0 end * 1e6 as lambda_e6 from
    (select *, coalesce(mid - lag(mid) over ({WB}), 0) as d from (select *, (bid1_price + ask1_price) / 2 as mid from flow)) window w50 as ({WB} rows between 49 preceding and current row)""",
    ["flow"],
    "lambda_e6",
)
def kyle_lambda(spark, sf_dir):
    """Rolling price impact of the book's tilt over 50 snapshots."""
    x = o.order_flow(o.expand_levels(a.book(spark, sf_dir))).withColumn("mid", (F.col("bid1_price") + F.col("ask1_price")) / 2)
    return o.kyle_lambda(x, "mid", "tilt", ["ts_ms", "snap_id"]).select("symbol", "session", "snap_id", (F.col("kyle_lambda") * 1e6).alias("lambda_e6"))


def _mids(spark, sf_dir):
    x = o.expand_levels(a.book(spark, sf_dir), 1)
    return x.withColumn("mid", (F.col("bid1_price") + F.col("ask1_price")) / 2).withColumn("spread", F.col("ask1_price") - F.col("bid1_price"))


view("mids", "select symbol, session, ts_ms, snap_id, (bid1_price + ask1_price) / 2 as mid, ask1_price - bid1_price as spread from flat", ["flat"])
view("mids1", "select symbol, session, ts_ms, arg_max(mid, snap_id) as mid, arg_max(spread, snap_id) as spread from mids group by all", ["mids"])


@query(
    "asof_book_to_events",
    "select e.symbol, e.session, e.ts_ms, e.vwap, m.ts_ms as asof_time, m.mid, case when m.mid is not null then least(greatest((e.vwap - m.mid) / greatest(m.spread, 1e-8::double * m.mid), -5), 5) end as trade_vs_mid from oev e asof left join mids1 m on e.symbol = m.symbol and e.session = m.session and e.ts_ms >= m.ts_ms",
    ["oev", "mids1"],
    "vwap mid trade_vs_mid",
)
def asof_book_to_events(spark, sf_dir):
    """The last snapshot at or before each event, and the price against its mid."""
    x = asof.asof(events(spark, sf_dir).select("symbol", "session", "ts_ms", "vwap"), _mids(spark, sf_dir), ["symbol", "session"], "ts_ms", "ts_ms", ["mid", "spread"], "snap_id")
    floor = F.greatest(F.col("spread"), F.col("mid") * 1e-8)
    return x.select("symbol", "session", "ts_ms", "vwap", "asof_time", "mid", F.when(F.col("mid").isNotNull(), F.least(F.greatest((F.col("vwap") - F.col("mid")) / floor, F.lit(-5.0)), F.lit(5.0))).alias("trade_vs_mid"))


@query(
    "trades_to_snapshots",
    """select symbol, session, snap_ts, count(*) as n_events, sum(total_qty) as qty from (select e.symbol, e.session, e.total_qty, coalesce(m.ts_ms, f.first_ts) as snap_ts from oev e
    asof left join mids1 m on e.symbol = m.symbol and e.session = m.session and e.ts_ms >= m.ts_ms left join (select symbol, session, min(ts_ms) as first_ts from mids1 group by all) f on e.symbol = f.symbol and e.session = f.session) where snap_ts is not null group by all""",
    ["oev", "mids1"],
    "qty",
)
def trades_to_snapshots(spark, sf_dir):
    """Events summed by snapshot, early ones with the first."""
    m = _mids(spark, sf_dir)
    x = asof.asof(events(spark, sf_dir).select("symbol", "session", "ts_ms", "total_qty"), m, ["symbol", "session"], "ts_ms", "ts_ms", ["mid"], "snap_id")
    first = m.groupBy("symbol", "session").agg(F.min("ts_ms").alias("first_ts"))
    x = x.join(first, ["symbol", "session"], "left").withColumn("snap_ts", F.coalesce("asof_time", "first_ts")).where("snap_ts is not null")
    return x.groupBy("symbol", "session", "snap_ts").agg(F.count("*").alias("n_events"), F.sum("total_qty").alias("qty"))


@query(
    "first_liquidation_after",
    """select t.symbol, t.history_id, l.event_ts_ms as asof_time, l.price as liq_price, case when l.event_ts_ms is not null and l.event_ts_ms <= t.event_ts_ms + 3600000 then sign(l.price - t.price)::int else 0 end as direction
    from (select user_id % 16 as u, * from trades) t asof left join (select u, event_ts_ms, arg_min(price, history_id) as price from (select user_id % 16 as u, * from trades where trade_class = 'liquidation') group by all) l on t.u = l.u and t.event_ts_ms < l.event_ts_ms""",
    ["trades"],
    "liq_price",
)
def first_liquidation_after(spark, sf_dir):
    """The first liquidation after a trade, and its direction within an hour."""
    t = a.trades(spark, sf_dir).withColumn("u", F.col("user_id") % 16).withColumn("after", F.col("event_ts_ms") + 1)
    liq = t.where("trade_class = 'liquidation'").withColumn("liq_price", F.col("price"))
    x = asof.asof(t.select("u", "symbol", "history_id", "event_ts_ms", "price", "after"), liq.select("u", "event_ts_ms", "history_id", "liq_price"), ["u"], "after", "event_ts_ms", ["liq_price"], "history_id", forward=True)
    near = F.col("asof_time") <= F.col("event_ts_ms") + 3_600_000
    return x.select("symbol", "history_id", "asof_time", "liq_price", F.when(near, F.signum(F.col("liq_price") - F.col("price")).cast("int")).otherwise(0).alias("direction"))


@query(
    "liquidation_in_horizon",
    "select symbol, history_id, exists (select 1 from trades l where l.trade_class = 'liquidation' and l.user_id % 16 = t.user_id % 16 and l.event_ts_ms > t.event_ts_ms and l.event_ts_ms <= t.event_ts_ms + 600000) as liquidated from trades t",
    ["trades"],
)
def liquidation_in_horizon(spark, sf_dir):
    """Whether a liquidation follows within ten minutes."""
    t = a.trades(spark, sf_dir).withColumn("u", F.col("user_id") % 16)
    return t.select("symbol", "history_id", asof.exists_within(t, F.col("trade_class") == "liquidation", ["u"], "event_ts_ms", 600_000).alias("liquidated"))


@query(
    "liquidation_bursts",
    """select symbol, start_ms, end_ms, n_trades, qty, notional, start_price, end_price, move_bps, sign(move_bps)::int as direction from (select *, ln(end_price / start_price) * 10000 as move_bps from (
    select symbol, burst, min(ts_ms) as start_ms, max(ts_ms) as end_ms, count(*) as n_trades, sum(qty) as qty, sum(qty * price) as notional, arg_min(price, (ts_ms, tie)) as start_price, arg_max(price, (ts_ms, tie)) as end_price from (
    select *, sum(coalesce(new_, 0)) over (partition by symbol order by ts_ms, tie) as burst from (select *, (ts_ms - lag(ts_ms) over (partition by symbol order by ts_ms, tie) > 1800000)::int as new_ from
    (select 'S' || (user_id % 4) as symbol, event_ts_ms as ts_ms, price, qty, history_id as tie from trades where trade_class = 'liquidation'))) group by all) where n_trades >= 2 and start_price > 0 and end_price > 0) where abs(move_bps) >= 10""",
    ["trades"],
    "qty notional start_price end_price move_bps",
)
def liquidation_bursts(spark, sf_dir):
    """Bursts of liquidations by gap, of 10 basis points at least."""
    t = a.trades(spark, sf_dir).where("trade_class = 'liquidation'")
    return o.bursts(t.select(F.concat(F.lit("S"), F.col("user_id") % 4).alias("symbol"), F.col("event_ts_ms").alias("ts_ms"), "price", "qty", F.col("history_id").alias("tie")), 1_800_000).drop("burst")


def _sweep_sql(size):
    return f"""select symbol, snap_id, sum(px) >= {size} - 1e-9 as fillable, case when sum(px) >= {size} - 1e-9 then {size}::double / sum(greatest(least(px, {size} - before), 0) / ask) end as avg_price,
    case when sum(px) >= {size} - 1e-9 then ({size}::double / sum(greatest(least(px, {size} - before), 0) / ask) / any_value(mid) - 1) * 10000 end as slip_bps from (
    select l.*, ask * ask_qty as px, coalesce(sum(ask * ask_qty) over (partition by l.snap_id order by i rows between unbounded preceding and 1 preceding), 0) as before, m.mid from levels l join mids m using (snap_id)) group by symbol, snap_id"""


@query("book_sweep", _sweep_sql(5000), ["levels", "mids"], "avg_price slip_bps", digits=4)
def book_sweep(spark, sf_dir):
    """P5: cost of sweeping 5,000 from the asks."""
    b = a.book(spark, sf_dir).withColumn("mid", (F.col("bids")[0]["price"] + F.col("asks")[0]["price"]) / 2)
    return b.withColumn("s", o.sweep_cost(F.col("asks"), 5000, F.col("mid"), 1)).select("symbol", "snap_id", "s.fillable", "s.avg_price", "s.slip_bps")
