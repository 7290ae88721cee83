"""Queries of taking and making against the book, and of springs at the least return."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import economics as ec
from marketflow.operators import order_events as o
from marketflow.plans.event_queries import events
from marketflow.plans.feature_queries import event_table
from marketflow.registry import query, view
from marketflow.sources import adapters as a

LENGTH, STRIDE, HORIZONS, SIZES, OFFSETS = 20, 10, [5, 20], [1000.0, 20000.0], [1.0, 500.0, 5000.0]
view("ec_idx", "select symbol, session, ts_ms, vwap, row_number() over (partition by symbol, session order by ts_ms) - 1 as idx from oev", ["oev"])
view("ec_best", "select symbol, session, ts_ms, snap_id, max(case when bid > 0 and bid_qty > 0 then bid end) as bid, min(case when ask > 0 and ask_qty > 0 then ask end) as ask from levels group by all", ["levels"])
view(
    "ec_anchor",
    f"""select e.symbol, e.session, e.idx - {LENGTH - 1} as window_start, e.ts_ms as anchor_ts, e.vwap, e.idx, (m.bid + m.ask) / 2 as mid, m.snap_id from ec_idx e
    asof join (select symbol, session, ts_ms, max(snap_id) as snap_id, arg_max(bid, snap_id) as bid, arg_max(ask, snap_id) as ask from ec_best group by all) m on e.symbol = m.symbol and e.session = m.session and e.ts_ms >= m.ts_ms
    where e.idx >= {LENGTH - 1} and (e.idx - {LENGTH - 1}) % {STRIDE} = 0""",
    ["ec_idx", "ec_best"],
)


def _leg(side, sign):
    return f"""select s.snap_id, size_usd, sum(px) >= size_usd - 1e-9 as ok, case when sum(px) >= size_usd - 1e-9 then (size_usd / sum(greatest(least(px, size_usd - before), 0) / p) / any_value(mid) - 1) * 10000 * {sign} end as slip from (
    select l.snap_id, l.{side} as p, l.{side} * l.{side}_qty as px, size_usd, coalesce(sum(l.{side} * l.{side}_qty) over (partition by l.snap_id, size_usd order by i rows between unbounded preceding and 1 preceding), 0) as before, mid from levels l join (select distinct snap_id, mid from ec_anchor) using (snap_id), (select unnest({SIZES})::double as size_usd)) s group by s.snap_id, size_usd"""


_TAKER = f"""select x.symbol, x.session, window_start, anchor_ts, b.size_usd, h.horizon::int as horizon, b.ok and s.ok as fillable, b.slip as slip_buy_bps, s.slip as slip_sell_bps, (abs(b.slip) + abs(s.slip)) / 2 as slip_avg_bps, abs(ln(f.vwap / x.vwap)) * 10000 as edge_bps,
    abs(ln(f.vwap / x.vwap)) * 10000 - (2 * 4.0::double + (abs(b.slip) + abs(s.slip)) / 2 * 2) as headroom_bps from ec_anchor x join ({_leg('ask', 1)}) b using (snap_id) join ({_leg('bid', -1)}) s using (snap_id, size_usd), (select unnest({HORIZONS}) as horizon) h
    left join ec_idx f on f.symbol = x.symbol and f.session = x.session and f.idx = x.idx + h.horizon"""


def _inputs(spark, sf_dir):
    return events(spark, sf_dir), a.book(spark, sf_dir)


@query("taker_rows", _TAKER, ["ec_anchor", "ec_idx", "levels"], "slip_buy_bps slip_sell_bps slip_avg_bps edge_bps headroom_bps", digits=4)
def taker_rows(spark, sf_dir):
    """M5: windows by size and horizon, taken on both sides."""
    return ec.taker_rows(*_inputs(spark, sf_dir), LENGTH, STRIDE, HORIZONS, SIZES, 4.0)


view(
    "ec_maker",
    f"""select *, case when bid_filled and bid_price > 0 then (mid_at_horizon - bid_price) / bid_price * 1e4::double end as realized_bid_pnl_bps, case when ask_filled and ask_price > 0 then (ask_price - mid_at_horizon) / ask_price * 1e4::double end as realized_ask_pnl_bps from (
    select x.symbol, x.session, window_start, anchor_ts, x.mid as anchor_mid, h.horizon::int as horizon, offset_bps, x.mid * (1 - offset_bps / 1e4::double) as bid_price, x.mid * (1 + offset_bps / 1e4::double) as ask_price, f.ts_ms as fill_horizon_ts, x.mid * exp(ln(f.vwap / x.vwap)) as mid_at_horizon,
    coalesce((select min(ask) from ec_best m where m.symbol = x.symbol and m.session = x.session and m.ts_ms between x.anchor_ts and f.ts_ms) <= x.mid * (1 - offset_bps / 1e4::double), false) as bid_filled,
    coalesce((select max(bid) from ec_best m where m.symbol = x.symbol and m.session = x.session and m.ts_ms between x.anchor_ts and f.ts_ms) >= x.mid * (1 + offset_bps / 1e4::double), false) as ask_filled
    from ec_anchor x, (select unnest({HORIZONS}) as horizon) h join ec_idx f on f.symbol = x.symbol and f.session = x.session and f.idx = x.idx + h.horizon, (select unnest({OFFSETS})::double as offset_bps))""",
    ["ec_anchor", "ec_idx", "ec_best"],
)


@query("maker_rows", "select * from ec_maker", ["ec_maker"], "anchor_mid bid_price ask_price mid_at_horizon realized_bid_pnl_bps realized_ask_pnl_bps", digits=4)
def maker_rows(spark, sf_dir):
    """M6: limits around the mid of each window, whether they fill, and what a fill is worth later."""
    return ec.maker_rows(*_inputs(spark, sf_dir), LENGTH, STRIDE, HORIZONS, OFFSETS)


_SIDE = lambda s: f"avg(realized_{s}_pnl_bps) as mean_pnl_{s}_filled, quantile_cont(realized_{s}_pnl_bps, 0.5) as median_pnl_{s}_filled, quantile_cont(realized_{s}_pnl_bps, 0.25) as q25_pnl_{s}_filled, quantile_cont(realized_{s}_pnl_bps, 0.75) as q75_pnl_{s}_filled"


@query(
    "adverse_cells",
    f"""select *, (fill_rate_bid * coalesce(mean_pnl_bid_filled, 0) + fill_rate_ask * coalesce(mean_pnl_ask_filled, 0)) / 2 - 2 * 1.5::double as unconditional_maker_pnl_bps, case when mean_pnl_either_filled = 0 then 'inf'::double else 0.5 + 1.5 / mean_pnl_either_filled end as model_accuracy_breakeven from (
    select symbol, horizon, offset_bps, count(*) as n_windows, avg(bid_filled::int::double) as fill_rate_bid, avg(ask_filled::int::double) as fill_rate_ask, avg((bid_filled or ask_filled)::int::double) as fill_rate_either, {_SIDE('bid')}, {_SIDE('ask')} from ec_maker group by all)
    left join (select symbol, horizon, offset_bps, avg(v) as mean_pnl_either_filled, quantile_cont(v, 0.5) as median_pnl_either_filled from (select symbol, horizon, offset_bps, unnest([realized_bid_pnl_bps, realized_ask_pnl_bps]) as v from ec_maker) where v is not null group by all) using (symbol, horizon, offset_bps)""",
    ["ec_maker"],
    "fill_rate_bid fill_rate_ask fill_rate_either mean_pnl_bid_filled median_pnl_bid_filled q25_pnl_bid_filled q75_pnl_bid_filled mean_pnl_ask_filled median_pnl_ask_filled q25_pnl_ask_filled q75_pnl_ask_filled mean_pnl_either_filled median_pnl_either_filled unconditional_maker_pnl_bps model_accuracy_breakeven",
    digits=4,
)
def adverse_cells(spark, sf_dir):
    """What fills are worth by symbol, horizon and offset."""
    return ec.adverse_cells(maker_rows(spark, sf_dir), ["symbol", "horizon", "offset_bps"], 1.5)


view(
    "springs",
    """select symbol, session, ts_ms, full_ as has, case when full_ then m.r end as min_return, case when full_ then m.e end as evr_at_min, case when full_ then m.p end as is_open_at_min, coalesce(full_ and m.r < -0.5 * dev and m.e > 1 and m.p > 0.5 and near_ > 0, false) as spring from (
    select symbol, session, ts_ms, i > 50 as full_, min({'r': log_return, 'i': i, 'e': effort_vs_result, 'p': is_open}) over (w rows between 50 preceding and current row) as m, case when i >= 10 then stddev_samp(log_return) over (w rows between 999 preceding and current row) else 1e-6 end as dev,
    avg(log_return) over (w rows between 10 preceding and current row) as near_ from (select *, row_number() over (partition by symbol, session order by ts_ms) as i from feats) window w as (partition by symbol, session order by ts_ms))""",
    ["feats"],
)


@query("spring_rows", "select symbol, session, ts_ms, min_return, evr_at_min, is_open_at_min, spring from springs", ["springs"], "min_return evr_at_min is_open_at_min")
def spring_rows(spark, sf_dir):
    """The least return of 51 events with what its row had."""
    return ec.spring_argmin(event_table(spark, sf_dir), 0.5).select("symbol", "session", "ts_ms", "min_return", "evr_at_min", "is_open_at_min", "spring")


@query("spring_rates", "select symbol, count(min_return) as windows, count(*) filter (spring) as fires, count(*) filter (spring) / greatest(count(min_return), 1)::double as rate from springs group by symbol", ["springs"], "rate")
def spring_rates(spark, sf_dir):
    """How often springs fire."""
    return ec.spring_rates(ec.spring_argmin(event_table(spark, sf_dir), 0.5), ["symbol"])


view("pc_t", "select 'S' || (user_id % 4) as symbol, (event_ts_ms // 86400000)::int as session, event_ts_ms as ts_ms, price, qty, history_id as tie, trade_class from trades", ["trades"])
view("pc_e", "select symbol, session, ts_ms, vwap, row_number() over (partition by symbol, session order by ts_ms) - 1 as idx from (select symbol, session, ts_ms, sum(price * qty) / sum(qty) as vwap from pc_t group by all)", ["pc_t"])
view(
    "pc_b",
    """select *, sign(move_bps)::int as direction from (select symbol, session, start_ms, end_ms, n_trades, notional, ln(p1 / p0) * 10000 as move_bps from (select symbol, session, b, min(ts_ms) as start_ms, max(ts_ms) as end_ms, count(*) as n_trades, sum(qty * price) as notional, arg_min(price, (ts_ms, tie)) as p0, arg_max(price, (ts_ms, tie)) as p1 from (
    select *, sum(coalesce(n_, 0)) over (partition by symbol, session order by ts_ms, tie) as b from (select *, (ts_ms - lag(ts_ms) over (partition by symbol, session order by ts_ms, tie) > 1800000)::int as n_ from pc_t where trade_class = 'liquidation')) group by all) where n_trades >= 2 and p0 > 0 and p1 > 0) where abs(move_bps) >= 10""",
    ["pc_t"],
)
view(
    "pc_rows",
    """select *, -m as gross_reversion_bps, m as gross_continuation_bps, -m - 8 as net_reversion_bps, -m - 8 > 0 as net_reversion_positive from (select b.*, x.idx as anchor_idx, d as delay_events, h as horizon, ln(q.vwap / p.vwap) as forward_log_return, sign(move_bps) * ln(q.vwap / p.vwap) * 10000 as m from pc_b b
    asof join pc_e x on b.symbol = x.symbol and b.session = x.session and b.end_ms >= x.ts_ms, (select unnest([0, 2])::int as d) d, (select unnest([1, 5])::int as h) h join pc_e p on p.symbol = b.symbol and p.session = b.session and p.idx = x.idx + d join pc_e q on q.symbol = b.symbol and q.session = b.session and q.idx = x.idx + d + h)""",
    ["pc_b", "pc_e"],
)


def _cascades(spark, sf_dir):
    day = F.expr("event_ts_ms div 86400000").cast("int")
    t = a.trades(spark, sf_dir).select(F.concat(F.lit("S"), F.col("user_id") % 4).alias("symbol"), day.alias("session"), F.col("event_ts_ms").alias("ts_ms"), "price", "qty", F.col("history_id").alias("tie"), "trade_class")
    key = F.split("symbol", "\\|")
    found = o.bursts(t.where("trade_class = 'liquidation'").withColumn("symbol", F.concat_ws("|", "symbol", "session")), 1_800_000)
    found = found.select(key[0].alias("symbol"), key[1].cast("int").alias("session"), "start_ms", "end_ms", "n_trades", "notional", "move_bps", "direction")
    prices = t.groupBy("symbol", "session", "ts_ms").agg((F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("vwap"))
    return ec.post_cascade_rows(found, prices, [0, 2], [1, 5], 8.0)


@query("post_cascade_rows", "select symbol, session, start_ms, end_ms, n_trades, notional, move_bps, direction, anchor_idx, delay_events, horizon, forward_log_return, 8.0::double as round_trip_cost_bps, gross_continuation_bps, gross_reversion_bps, net_reversion_bps, net_reversion_positive from pc_rows", ["pc_rows"], "notional move_bps forward_log_return gross_continuation_bps gross_reversion_bps net_reversion_bps")
def post_cascade_rows(spark, sf_dir):
    """M4: bursts of a symbol's day by delay and horizon."""
    return _cascades(spark, sf_dir)


@query("burst_regimes", "select horizon, delay_events, count(*) as n_events, count(distinct session) as n_days, count(distinct symbol) as n_symbols, median(net_reversion_bps) as median_net_bps, avg(net_reversion_bps) as mean_net_bps, avg((net_reversion_bps > 0)::int::double) as frac_positive, median(gross_reversion_bps) as median_gross_reversion_bps from pc_rows group by all", ["pc_rows"], "median_net_bps mean_net_bps frac_positive median_gross_reversion_bps")
def burst_regimes(spark, sf_dir):
    """What follows bursts, by horizon and delay."""
    return ec.burst_regime_summary(_cascades(spark, sf_dir), ["horizon", "delay_events"])


_FEES, _ACCURACIES = [-0.5, 1.5, 400.0], [0.55, 0.6]


@query(
    "maker_sensitivity",
    f"""select maker_fee_bps, accuracy, count(*) filter (alive) as n_cells_alive, count(*) filter (alive and touched > 0.5) as n_cells_alive_with_fill_proxy, coalesce(array_to_string(list_transform((list({{'m': -med, 'l': label}} order by -med, label) filter (alive))[1:5], lambda s: s.l || '(' || printf('%+.2f', -s.m) || 'bp)'), ', '), '') as top_5_cells_by_median_headroom
    from (select *, med > 0 and pos > 0.5 as alive, symbol || ':$' || floor(size_usd / 1000)::bigint || 'k:H' || horizon as label from (select symbol, size_usd, horizon, maker_fee_bps, accuracy, median((2 * accuracy - 1) * edge_bps - 2 * maker_fee_bps) as med, avg(((2 * accuracy - 1) * edge_bps - 2 * maker_fee_bps > 0)::int::double) as pos, avg((edge_bps >= 1)::int::double) as touched
    from ({_TAKER}), (select unnest({_FEES})::double as maker_fee_bps), (select unnest({_ACCURACIES})::double as accuracy) where fillable and edge_bps is not null group by all)) group by all""",
    ["ec_anchor", "ec_idx", "levels"],
)
def maker_sensitivity(spark, sf_dir):
    """Cells that survive a grid of fees and accuracies."""
    return ec.maker_sensitivity(taker_rows(spark, sf_dir), _FEES, _ACCURACIES)
