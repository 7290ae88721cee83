"""Queries over event features, their windows and labels; the SQL states each step as the domain defines it."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import event_features as ef
from marketflow.operators import order_events as o
from marketflow.plans import event_queries  # noqa: F401  its views
from marketflow.registry import query, view
from marketflow.sources import adapters as a
from marketflow.sources import store
from marketflow.sources.shared import shared, written

W = "partition by symbol, session order by ts_ms"
WB = "partition by symbol, session order by ts_ms, snap_id"
FR = f"over ({W} rows between 999 preceding and current row)"
#: Sessions from here on are deduplicated by taker; sessions from HOLDOUT on are not to be touched.
ERA, HOLDOUT = 1996, 2100
#: Book features are cut to so many digits before labels compare them, so that no label hangs on a last bit.
DIGITS = 9


def _fixed(df, columns):
    return df.withColumns({c: F.round(F.col(c), DIGITS) for c in columns})


SNAP = ["log_spread", "imbalance_l1", "imbalance_l5", "depth_ratio", "delta_imbalance_l1", "cum_ofi_5"]
view("era", f"select * exclude (n_) from (select *, row_number() over (partition by symbol, session, ts_ms, qty, price order by recv_ms, order_id, l_linenumber) as n_ from fills) where case when session < {ERA} then n_ = 1 else event_type = 'fulfill_taker' end", ["fills"])
view(
    "era_events",
    """select * from (select *, count(*) over (partition by symbol, session) as size_ from (
    select symbol, session, ts_ms, sum(qty) as total_qty, sum(qty * price) / sum(qty) as vwap, avg((side in ('open_long', 'close_short'))::int::double) as is_open_frac, count(*) as n_fills,
    abs(arg_max(price, (recv_ms, order_id, l_linenumber)) - arg_min(price, (recv_ms, order_id, l_linenumber))) as book_walk_abs,
    sum(case when side in ('open_long', 'close_short') then 1 else -1 end * qty * price) as signed_notional from era group by all)) where size_ >= 400""",
    ["era"],
)
view(
    "snaps",
    f"""select * from (select b.symbol, b.session, b.ts_ms, b.snap_id, mid, spread, {', '.join(f'round({c}, {DIGITS}) as {c}' for c in SNAP)}, count(*) over (partition by b.symbol, b.session) as n_
    from bookf b join (select symbol, session, snap_id, cum_ofi_5 from flow) f on b.symbol = f.symbol and b.session = f.session and b.snap_id = f.snap_id) where n_ >= 2""",
    ["bookf", "flow"],
)
view("snaps1", "select symbol, session, ts_ms, max(snap_id) as snap_id from snaps group by all", ["snaps"])
view("paired", "select e.*, m.snap_id from era_events e asof left join snaps1 m on e.symbol = m.symbol and e.session = m.session and e.ts_ms >= m.ts_ms", ["era_events", "snaps1"])
view(
    "kyled",
    f"""select * from (select *, case when count(*) over w50 = 50 then coalesce(covar_samp(d, cum) over w50 / nullif(var_samp(cum) over w50, 0), 0) else 0 end as kyle_lambda from (
    select *, coalesce(mid - lag(mid) over ({WB}), 0) as d, sum(f) over ({WB}) as cum from (
    select s.*, coalesce(x.v, 0) + case when row_number() over (partition by s.symbol, s.session order by s.ts_ms, s.snap_id) = 1 then coalesce(y.v, 0) else 0 end as f from snaps s
    left join (select symbol, session, snap_id, sum(signed_notional) as v from paired group by all) x on s.symbol = x.symbol and s.session = x.session and s.snap_id = x.snap_id
    left join (select symbol, session, sum(signed_notional) as v from paired where snap_id is null group by all) y on s.symbol = y.symbol and s.session = y.session))
    window w50 as ({WB} rows between 49 preceding and current row))""",
    ["snaps", "paired"],
)
view(
    "lined",
    """select * exclude (m_) from (select p.* exclude (snap_id, size_), k.snap_id, k.mid, k.spread, k.log_spread, k.imbalance_l1, k.imbalance_l5, k.depth_ratio, k.delta_imbalance_l1, k.kyle_lambda, k.cum_ofi_5, count(*) over (partition by p.symbol, p.session) as m_
    from paired p join kyled k on p.symbol = k.symbol and p.session = k.session and p.snap_id = k.snap_id) where m_ >= 400""",
    ["paired", "kyled"],
)
view(
    "feats",
    f"""select *, is_open_frac as is_open, ln(n_fills) as num_fills, book_walk_abs / greatest(spread, 1e-8::double * mid) as book_walk, least(greatest((vwap - mid) / greatest(spread, 1e-8::double * mid), -5), 5) as trade_vs_mid,
    case when first_ then 0 else least(greatest(log_total_qty - ln(abs_return / greatest(median_return, 1e-10::double) + 1e-6::double), -5), 5) end as effort_vs_result,
    least(greatest(least((log_qty - avg(log_qty) {FR}) / greatest(coalesce(stddev_samp(log_qty) {FR}, 0), 0.1), (abs_return - avg(abs_return) {FR}) / greatest(coalesce(stddev_samp(abs_return) {FR}, 0), 0.1)), 0), 5) as climax_score
    from (select *, ln(total_qty / greatest(quantile_cont(total_qty, 0.5) {FR}, 1e-6::double)) as log_total_qty, quantile_cont(abs_return, 0.5) {FR} as median_return, ln(greatest(total_qty, 1e-6::double)) as log_qty from (
    select *, abs(log_return) as abs_return from (select *, case when lag(vwap) over ({W}) is null then 0 else ln(vwap / greatest(lag(vwap) over ({W}), 1e-6::double)) end as log_return, lag(ts_ms) over ({W}) is null as first_,
    ln(coalesce(ts_ms - lag(ts_ms) over ({W}), 0) + 1.0::double) as time_delta, coalesce(ln(lag(ts_ms) over ({W}) - lag(ts_ms, 200) over ({W}) + 1.0::double), 0) as prev_seq_time_span from lined)))""",
    ["lined"],
)
_q = lambda c, p: f"case when count(*) {FR} >= 100 then quantile_cont({c}, {p}) {FR} end"
_m = lambda f, c: f"case when count(*) {FR} >= 10 then {f}({c}) {FR} end"
_z = lambda c: f"({c} - coalesce({_m('avg', c)}, 0)) / greatest(coalesce({_m('stddev_samp', c)}, 1e-10::double), 1e-10::double)"
_LAST = lambda n, f: f"case when count(*) over ({W} rows between {n - 1} preceding and current row) = {n} then {f}(log_return) over ({W} rows between {n - 1} preceding and current row) end"
view(
    "labelled",
    f"""select *, {', '.join(f'case when lead(vwap, {h}) over ({W}) is not null then (lead(vwap, {h}) over ({W}) > vwap)::int end as dir_h{h}' for h in o.HORIZONS)},
    coalesce(log_spread > {_q('log_spread', 0.9)} and abs(depth_ratio) > {_q('abs(depth_ratio)', 0.9)}, false)::int as wy_stress,
    coalesce(kyle_lambda > {_q('kyle_lambda', 0.75)} and abs(cum_ofi_5) > {_q('abs(cum_ofi_5)', 0.5)} and sign(cum_ofi_5) <> 0 and sign(cum_ofi_5) = sign(lag(cum_ofi_5) over ({W})) and sign(cum_ofi_5) = sign(lag(cum_ofi_5, 2) over ({W})), false)::int as wy_informed_flow,
    coalesce({_z('total_qty')} > 2 and {_z('abs_return')} > 2, false)::int as wy_climax,
    coalesce({_LAST(50, 'min')} < -3 * coalesce({_m('stddev_samp', 'log_return')}, 1e-10::double) and effort_vs_result > 1 and is_open > 0.5 and {_LAST(10, 'avg')} > 0, false)::int as wy_spring,
    coalesce(effort_vs_result > {_q('effort_vs_result', 0.9)} and abs_return < {_q('abs_return', 0.5)}, false)::int as wy_absorption from feats""",
    ["feats"],
)
_OUT = [*[c for c in ef.FEATURES if c != "kyle_lambda"], "lambda_e6"]


def placed_table(spark, sf_dir):
    return ef.event_features(a.fills(spark, sf_dir), a.book(spark, sf_dir), ERA, HOLDOUT, snaps=lambda book: _fixed(ef.snapshots(book), SNAP))


def event_table(spark, sf_dir):
    return placed_table(spark, sf_dir).drop("event_idx", "n_events")


def _scaled(x):
    return x.withColumn("lambda_e6", F.col("kyle_lambda") * 1e6).drop("kyle_lambda")


@query(
    "event_features",
    f"select symbol, session, ts_ms, {', '.join(c if c != 'lambda_e6' else 'kyle_lambda * 1e6 as lambda_e6' for c in _OUT)}, {', '.join(f'dir_h{h}' for h in o.HORIZONS)}, {', '.join(ef.LABELS)} from labelled",
    ["labelled"],
    " ".join(_OUT),
)
def event_features(spark, sf_dir):
    """Features and labels of all events of all sessions."""
    return _scaled(event_table(spark, sf_dir))


@query("trade_features", f"select symbol, session, ts_ms, {', '.join(ef.TRADE)} from feats", ["feats"], " ".join(ef.TRADE))
def trade_features(spark, sf_dir):
    """G1: the nine trade features over 1,000 events."""
    return event_table(spark, sf_dir).select("symbol", "session", "ts_ms", *ef.TRADE)


@query("wyckoff_labels", f"select symbol, session, ts_ms, {', '.join(ef.LABELS)} from labelled", ["labelled"])
def wyckoff_labels(spark, sf_dir):
    """Five labels by causal quantiles."""
    return event_table(spark, sf_dir).select("symbol", "session", "ts_ms", *ef.LABELS)


@query("kyle_lambda_trade", "select symbol, session, snap_id, kyle_lambda * 1e6 as lambda_e6 from kyled", ["kyled"], "lambda_e6")
def kyle_lambda_trade(spark, sf_dir):
    """Price impact of the trades' cumulative signed notional, per snapshot."""
    ev = written(ef.min_rows(o.order_events(ef.dedup_by_era(a.fills(spark, sf_dir), ERA)).select("symbol", "session", "ts_ms", "signed_notional"), 400))
    snaps = ef.snapshots(a.book(spark, sf_dir)).select("symbol", "session", "ts_ms", "snap_id", "mid")
    return ef.impacts(snaps, ev, 50, 20_000).select("symbol", "session", "snap_id", (F.col("kyle_lambda") * 1e6).alias("lambda_e6"))


def _windowed(stride):
    return f"select e.* replace (kyle_lambda * 1e6 as kyle_lambda), w as window_start, idx - w as pos from (select *, row_number() over ({W}) - 1 as idx, count(*) over (partition by symbol, session) as n from labelled) e, range(0, 100000, {stride}) t(w) where w <= idx and idx < w + 200 and w + 200 <= n"


view("wins50", _windowed(50), ["labelled"])
view("wins200", _windowed(200), ["labelled"])
_N = 200.0
_NAME = {c: c if c != "kyle_lambda" else "lambda_e6" for c in ef.FEATURES}
_STATS = [f"{_NAME[c]}_{s}" for s in ("mean", "std", "skew", "kurt", "last") for c in ef.FEATURES if f"{c}_{s}" not in ef.PRUNED]
_AG = ", ".join(
    f"avg({c}) as {_NAME[c]}_mean, stddev_pop({c}) as {_NAME[c]}_std, case when stddev_pop({c}) < 1e-12 then 0 else (avg(pow({c} - m_{c}, 3)) / pow(stddev_pop({c}), 3)) * {(_N * (_N - 1)) ** 0.5 / (_N - 2)!r}::double end as {_NAME[c]}_skew, "
    f"case when stddev_pop({c}) < 1e-12 then 0 else {(_N - 1) / ((_N - 2) * (_N - 3))!r}::double * ({_N + 1}::double * (avg(pow({c} - m_{c}, 4)) / pow(stddev_pop({c}), 4) - 3) + 6) end as {_NAME[c]}_kurt, arg_max({c}, idx) as {_NAME[c]}_last"
    for c in ef.FEATURES
)


@query(
    "flat_features",
    f"select symbol, session, window_start, {', '.join(_STATS)} from (select symbol, session, window_start, {_AG} from (select *, {', '.join(f'avg({c}) over (partition by symbol, session, window_start) as m_{c}' for c in ef.FEATURES)} from wins50) group by all)",
    ["wins50"],
    " ".join(_STATS),
    digits=4,
)
def flat_features(spark, sf_dir):
    """K3: 83 moments of windows of 200 events, every 50."""
    return o.flat_features(_scaled(placed_table(spark, sf_dir)), [_NAME[c] for c in ef.FEATURES], o.LENGTH, o.STRIDE).drop(*ef.PRUNED)


_ENDS = [*[f"dir_h{h}" for h in o.HORIZONS], *ef.LABELS]


@query(
    "window_rows",
    f"select symbol, session, window_start, pos, min(ts_ms) over v as first_ts, ts_ms, {', '.join(c if c != 'lambda_e6' else 'kyle_lambda as lambda_e6' for c in _OUT)}, {', '.join(f'max(case when pos = 199 then {c} end) over v as {c}' for c in _ENDS)} from wins200 window v as (partition by symbol, session, window_start)",
    ["wins200"],
    " ".join(_OUT),
)
def window_rows(spark, sf_dir):
    """K2: the events of each window of 200, with the labels of its last event."""
    return _scaled(ef.window_rows(placed_table(spark, sf_dir), 200, 200))


@query(
    "window_wyckoff",
    """select symbol, session, window_start, (avg(effort_vs_result) filter (pos >= 100) > 1.5 and stddev_pop(log_return) filter (pos >= 100) < 0.5 * (stddev_pop(log_return) + 1e-12::double) and avg(log_total_qty) filter (pos >= 100) > 0.5)::int as is_absorption,
    (max(climax_score) filter (pos >= 150) > 2.5 and avg(log_return) filter (pos >= 150) > 0 and avg(log_return) filter (pos between 50 and 149) > 0)::int as is_buying_climax,
    (max(climax_score) filter (pos >= 150) > 2.5 and avg(log_return) filter (pos >= 150) < 0 and avg(log_return) filter (pos between 50 and 149) < 0)::int as is_selling_climax,
    (max(climax_score) filter (pos >= 150) > 3 and stddev_pop(log_return) filter (pos >= 100) > 1.5 * (stddev_pop(log_return) + 1e-12::double))::int as is_stressed, max(climax_score) filter (pos >= 150) as climax_seed from wins200 group by all""",
    ["wins200"],
    "climax_seed",
)
def window_wyckoff(spark, sf_dir):
    """K4: labels of whole windows."""
    return ef.window_wyckoff(placed_table(spark, sf_dir))


@query("taker_fills", "select symbol, session, count(*) as n from fills where event_type = 'fulfill_taker' group by all", ["fills"])
def taker_fills(spark, sf_dir):
    """Fills of the taking side, counted by session."""
    return ef.filter_taker(a.fills(spark, sf_dir)).groupBy("symbol", "session").agg(F.count("*").alias("n"))


@query(
    "event_feature_store",
    "select symbol, session, count(*) as n, sum(case when session % 3 = 0 then 2 else 1 end * log_return) as log_return from labelled where symbol <> 'P7' group by all",
    ["labelled"],
    "log_return",
)
def event_feature_store(spark, sf_dir):
    """Features written by symbol and session, a delta of a third of the sessions, and a pruned read."""
    path = shared(spark)
    rows = store.write_event_features(event_table(spark, sf_dir), path)
    again = store.write_event_features(written(rows.where("session % 3 = 0").withColumn("log_return", F.col("log_return") * 2)), path)
    return again.where("symbol <> 'P7'").groupBy("symbol", "session").agg(F.count("*").alias("n"), F.sum("log_return").alias("log_return"))
