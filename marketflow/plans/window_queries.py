"""Queries over book bars, flow windows, touches, embeddings, verdicts and checks of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import event_features as ef
from marketflow.operators import order_events as o
from marketflow.operators import window_studies as ws
from marketflow.plans import regime_queries, silver_queries  # noqa: F401  their views
from marketflow.plans.feature_queries import event_table, placed_table
from marketflow.registry import QUERIES, query, view
from marketflow.sources import adapters as a
from marketflow.sources import raw


@query(
    "book_bars",
    """select event_type as symbol, event_ts_ms // 3600000 * 3600000 as bucket_start_ms, count(*) as book_updates, avg((ask - bid) / ((bid + ask) / 2) * 10000) as avg_book_spread_bps, avg(3 * k + 6.0::double) as avg_bid_depth_l5,
    avg(case when k % 10 = 0 then 0 else 2 * k + 3.0::double end) as avg_ask_depth_l5, 6.0::double as avg_bid_orders_l5, avg(case when k % 10 = 0 then 0 else 3.0::double end) as avg_ask_orders_l5, arg_min(event_id, (event_ts_ms, event_id)) as first_book_nonce, arg_max(event_id, (event_ts_ms, event_id)) as last_book_nonce
    from (select *, px * (1 + -1 * 0.001::double * 1) as bid, case when k % 10 <> 0 then px * (1 + 1 * 0.001::double * 1) end as ask from px) group by all""",
    ["px"],
    "avg_book_spread_bps avg_bid_depth_l5 avg_ask_depth_l5 avg_bid_orders_l5 avg_ask_orders_l5",
)
def book_bars(spark, sf_dir):
    """Hourly bars of books."""
    return ws.book_bars(raw.dispatch(a.raw_lines(spark, sf_dir))["book"], F.expr(f"event_ts_ms div {a.HOUR_MS} * {a.HOUR_MS}"))


@query("cause_counts", "select event_ts_ms // 86400000 as day, trade_class as cause, count(*) as n, count(distinct symbol) as symbols from trades group by all", ["trades"])
def cause_counts(spark, sf_dir):
    """Trades and symbols by day and cause."""
    return a.trades(spark, sf_dir).groupBy(F.expr("event_ts_ms div 86400000").alias("day"), F.col("trade_class").alias("cause")).agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


_S = ["open_long", "open_short", "close_long", "close_short"]


@query(
    "flow_imbalance",
    f"""select *, (open_long - open_short) / nullif(open_long + open_short, 0) as open_imbalance, (open_long + close_short - open_short - close_long) / nullif(open_long + close_short + open_short + close_long, 0) as flow_imbalance from (
    select symbol, session, idx // 200 * 200 as window_start, {', '.join(f'sum({s}) as {s}' for s in _S)} from (select *, row_number() over (partition by symbol, session order by ts_ms) - 1 as idx, count(*) over (partition by symbol, session) as n from (
    select symbol, session, ts_ms, {', '.join(f"sum(case when side = '{s}' then qty else 0 end) as {s}" for s in _S)} from dedup group by all)) where idx // 200 * 200 + 200 <= n group by all)""",
    ["dedup"],
    " ".join([*_S, "open_imbalance", "flow_imbalance"]),
)
def flow_imbalance(spark, sf_dir):
    """Quantity by side and its imbalance in windows of events."""
    return ws.flow_imbalance(o.dedup_counterparty(a.fills(spark, sf_dir)), 200)


@query("lag_correlation", "select symbol, count(*) as windows, avg(log_return) as log_return_autocorr, avg(log_total_qty) as log_total_qty_autocorr from (select symbol, session, window_start, corr(log_return, r5) as log_return, corr(log_total_qty, q5) as log_total_qty from (select *, lag(log_return, 5) over v as r5, lag(log_total_qty, 5) over v as q5 from wins200 window v as (partition by symbol, session, window_start order by pos)) group by all) group by symbol", ["wins200"], "log_return_autocorr log_total_qty_autocorr")
def lag_correlation(spark, sf_dir):
    """Correlation of features with themselves five events before."""
    return ws.lag_correlation(ef.window_rows(placed_table(spark, sf_dir), 200, 200), ["symbol"], ["log_return", "log_total_qty"])


@query(
    "quote_touch",
    """select e.symbol, e.session, e.ts_ms, min(m.ask) <= any_value(e.bid_limit) as bid_filled_, coalesce(min(m.ask) <= any_value(e.bid_limit), false) as bid_filled, coalesce(max(m.bid) >= any_value(e.ask_limit), false) as ask_filled from (select symbol, session, ts_ms, vwap * 0.5::double as bid_limit, vwap * 3::double as ask_limit from oev) e
    left join (select symbol, session, ts_ms, mid - spread / 2 as bid, mid + spread / 2 as ask from mids) m on e.symbol = m.symbol and e.session = m.session and m.ts_ms between e.ts_ms and e.ts_ms + 3600000 group by all""".replace("min(m.ask) <= any_value(e.bid_limit) as bid_filled_, ", ""),
    ["oev", "mids"],
)
def quote_touch(spark, sf_dir):
    """Whether limits of either side are touched within an hour."""
    ev = o.order_events(o.dedup_counterparty(a.fills(spark, sf_dir))).select("symbol", "session", "ts_ms", (F.col("vwap") * 0.5).alias("bid_limit"), (F.col("vwap") * 3).alias("ask_limit"))
    x = o.expand_levels(a.book(spark, sf_dir), 1)
    mid, spread = (F.col("bid1_price") + F.col("ask1_price")) / 2, F.col("ask1_price") - F.col("bid1_price")
    return ws.touched(ev, x.select("symbol", "session", "ts_ms", (mid - spread / 2).alias("best_bid"), (mid + spread / 2).alias("best_ask")), ["symbol", "session"], 3_600_000).drop("bid_limit", "ask_limit")


@query("cost_attach", "select history_id, t.qty, c.cost from trades t left join (select symbol, event_ts_ms // 3600000 as hour, avg(spread_bps) as cost from bbo where symbol <> 'signup' group by all) c on t.symbol = c.symbol and t.event_ts_ms // 3600000 = c.hour", ["trades", "bbo"], "qty cost")
def cost_attach(spark, sf_dir):
    """Each trade with its hour's mean spread, if there is one."""
    hour = F.expr("event_ts_ms div 3600000").alias("hour")
    costs = a.bbo(spark, sf_dir).where("symbol <> 'signup'").groupBy("symbol", hour).agg(F.avg("spread_bps").alias("cost"))
    return ws.attach_cost(a.trades(spark, sf_dir).withColumn("hour", hour), costs, ["symbol", "hour"]).select("history_id", "qty", "cost")


@query("cross_symbol_pairs", "select a.bucket_start_ms, a.symbol as symbol_a, b.symbol as symbol_b, a.last_mid as key_a, b.last_mid as key_b from bars a join bars b on a.bucket_start_ms = b.bucket_start_ms and a.symbol < b.symbol where a.symbol <> 'signup' and b.symbol <> 'signup'", ["bars"], "key_a key_b")
def cross_symbol_pairs(spark, sf_dir):
    """Bars of different symbols in the same hour, without the held-out symbol."""
    from marketflow.operators import regime as r

    bars = r.regime_bars(a.bbo(spark, sf_dir), a.trades(spark, sf_dir), a.prices(spark, sf_dir), a.HOUR_MS).where("symbol <> 'signup'")
    return ws.cross_symbol_pairs(bars, ["bucket_start_ms"], "last_mid")


@query(
    "consecutive_distance",
    """select label, vec_id, distance, (distance - m) / nullif(sqrt(greatest((squares - distance * distance) / nullif(n - 1, 0) - m * m, 0)), 0) as jump_z from (select *, (total - distance) / nullif(n - 1, 0) as m from (select *, count(distance) over (partition by label) as n, sum(distance) over (partition by label) as total, sum(distance * distance) over (partition by label) as squares from (
    select label, vec_id, list_distance(embedding::double[], lag(embedding::double[]) over (partition by label order by vec_id)) as distance from embeddings)))""",
    None,
    "distance jump_z",
    digits=5,
)
def consecutive_distance(spark, sf_dir):
    """Steps between successive embeddings, and which stand out."""
    return ws.consecutive_distance(a.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


_C = "select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding::double[]) as v from embeddings"
_G = lambda p, q: f"(select sum(g * g) from (select a.i, b.i as j, sum(a.v * b.v) as g from cen a join cen b using (vec_id) where {p.format('a')} and {q.format('b')} group by a.i, b.i))"
view("cen", f"select vec_id, i, v - avg(v) over (partition by i) as v from ({_C})")


@query("linear_cka", f"select {_G('{}.i <= 32', '{}.i > 32')} / sqrt({_G('{}.i <= 32', '{}.i <= 32')} * {_G('{}.i > 32', '{}.i > 32')}) as cka", ["cen"], "cka")
def linear_cka(spark, sf_dir):
    """Alignment of the two halves of the embeddings."""
    e = a.table(spark, sf_dir, "embeddings")
    return ws.linear_cka(e.select(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b")), "a", "b")


@query("state_counts", "select d.state, count(s.state) as n from (values ('fresh'), ('active'), ('dormant'), ('retired')) d(state) left join (select case when k < 20 then 'fresh' when k < 80 then 'active' else 'dormant' end as state from ev) s using (state) group by d.state", ["ev"])
def state_counts(spark, sf_dir):
    """Rows by state, with zeros."""
    k = F.col("k")
    return ws.state_counts(a.events(spark, sf_dir).select(F.when(k < 20, "fresh").when(k < 80, "active").otherwise("dormant").alias("state")), "state", ["fresh", "active", "dormant", "retired"])


@query(
    "feature_checks",
    f"""select unnest(['finite', 'monotone', 'tail_mask', 'range']) as "check", unnest([count(*) filter (f), count(*) filter (m), count(*) filter (t), count(*) filter (r)]) as bad, unnest([case when count(*) filter (f) = 0 then 'OK' else 'CRITICAL' end, case when count(*) filter (m) = 0 then 'OK' else 'CRITICAL' end, case when count(*) filter (t) = 0 then 'OK' else 'CRITICAL' end, case when count(*) filter (r) = 0 then 'OK' else 'WARN' end]) as severity from (
    select {' or '.join(f'{c} is null or not isfinite({c})' for c in ef.FEATURES)} as f, coalesce(ts_ms <= lag(ts_ms) over w, false) as m, {' or '.join(f'(dir_h{h} is null) <> (count(*) over (partition by symbol, session) - row_number() over w < {h})' for h in o.HORIZONS)} as t,
    not (is_open between 0 and 1 and climax_score between 0 and 5 and effort_vs_result between -5 and 5 and trade_vs_mid between -5 and 5) as r from labelled window w as (partition by symbol, session order by ts_ms))""",
    ["labelled"],
)
def feature_checks(spark, sf_dir):
    """The feature table's constraints."""
    return ws.feature_checks(event_table(spark, sf_dir), ef.FEATURES, o.HORIZONS)


@query("overlay_verdict", "select 'INSUFFICIENT_SAMPLE_DIAGNOSTIC' as verdict from (select count(distinct event_ts_ms // 86400000) as d from ev) where d < 60", ["ev"])
def overlay_verdict(spark, sf_dir):
    """The verdict on the overlay's scorecard, which asks for 60 days."""
    card = QUERIES["overlay_scorecard"](spark, sf_dir).withColumn("delta_sortino", F.lit(0.0))
    return ws.overlay_verdict(card, min_days=60)
