"""Queries over streams: tables replayed in slices of time, with late rows, each slice a run from the checkpoint.

One row in seven comes a slice late, within the watermark's delay; one in 53 comes last, and may be behind it. What no
watermark has closed at the end is added from the batch form and flagged.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import asof
from marketflow.operators import regime as r
from marketflow.operators import studies as s
from marketflow.plans import silver_queries  # noqa: F401  its views
from marketflow.registry import query, view
from marketflow.sources import adapters as a
from marketflow.sources import raw
from marketflow.sources.shared import shared
from marketflow.streaming import bars as st
from marketflow.streaming.asof import stream_asof
from marketflow.streaming.replay import accepted, arrivals, replay, with_open

H = a.HOUR_MS
LATE, LATE_MS = "12 days", 12 * 24 * H


def _span(spark, sf_dir):
    lo, hi = a.events(spark, sf_dir).agg(F.min("event_ts_ms"), F.max("event_ts_ms")).first()
    return (lo or 0, hi or 0)


def _come(rows, span, seen="recv_ms"):
    """rows with the slice they arrive in."""
    behind = F.when(F.col(seen) % 53 == 0, 2).when(F.col(seen) % 7 == 0, 1).otherwise(0)
    return arrivals(rows, "event_ts_ms", behind, span)


_SLICE = "least(2, 3 * (event_ts_ms - lo) // (hi - lo + 1) + case when recv_ms % 53 = 0 then 2 when recv_ms % 7 = 0 then 1 else 0 end)"
view("span", "select min(event_ts_ms) as lo, max(event_ts_ms) as hi from ev", ["ev"])
for _t in ("trades", "bbo", "prices"):
    view(f"{_t}_slices", f"select {_t}.*, {_SLICE} as slice from {_t}, span", [_t, "span"])
view("marks", f"select s as slice, (select max(event_ts_ms) from trades_slices where slice < s) - {LATE_MS} as wm from range(3) t(s)", ["trades_slices"])
for _t in ("trades", "bbo", "prices"):
    view(f"{_t}_come", f"select * from {_t}_slices join marks using (slice)", [f"{_t}_slices", "marks"])
_END = f"(select hi - {LATE_MS} from span)"


@query(
    "stream_asof",
    f"""select e.symbol, e.history_id, e.event_ts_ms, e.price, q.event_ts_ms as asof_time, q.mid, e.event_ts_ms <= {_END} as is_final from (select * from trades_come where wm is null or event_ts_ms > wm) e
    asof left join (select symbol, event_ts_ms, arg_max(mid, last_order_id) as mid from bbo_come where last_order_id % 3 = 0 and (wm is null or event_ts_ms > wm) group by all) q on e.symbol = q.symbol and e.event_ts_ms >= q.event_ts_ms""",
    ["trades_come", "bbo_come", "span"],
    "price mid",
)
def stream_asof_query(spark, sf_dir):
    """Each trade with the last of a third of the quotes, both as streams."""
    span = _span(spark, sf_dir)
    t = _come(a.trades(spark, sf_dir), span).select("symbol", "history_id", "event_ts_ms", "price", "__slice")
    q = _come(a.bbo(spark, sf_dir).where("last_order_id % 3 = 0"), span).select("symbol", "event_ts_ms", "last_order_id", "mid", "__slice")
    final = replay({"trades": t, "quotes": q}, shared(spark), lambda x: stream_asof(x["trades"], x["quotes"], ["symbol"], "event_ts_ms", ["mid"], "last_order_id", LATE))
    on_time = lambda rows: accepted(rows, t, "event_ts_ms", LATE_MS).drop("__slice")
    whole = asof.asof(on_time(t), on_time(q), ["symbol"], "event_ts_ms", "event_ts_ms", ["mid"], "last_order_id")
    return with_open(final, whole.where(F.col("event_ts_ms") > span[1] - LATE_MS), ["history_id"])


def _closed(size):
    return f"bucket_start_ms + {size} <= {_END}"


_BARS = "count(*) as trade_count, sum(qty) as trade_qty, sum(notional) as trade_notional, count(*) filter (trade_class = 'liquidation') as liquidation_count"
view("live_bars", f"select symbol, event_ts_ms // {H} * {H} as bucket_start_ms, {_BARS} from trades_come where wm is null or event_ts_ms // {H} * {H} + {H} > wm group by all", ["trades_come"])


@query("stream_bars", f"select *, {_closed(H)} as is_final from live_bars", ["live_bars", "span"], "trade_qty trade_notional")
def stream_bars(spark, sf_dir):
    """Hourly bars as a stream: final ones once the watermark has closed them, later ones as provisional."""
    span = _span(spark, sf_dir)
    t = a.trades(spark, sf_dir)
    final = replay({"trades": _come(t, span)}, shared(spark), lambda x: st.stream_bars(x["trades"], late=LATE))
    return with_open(final, st.stream_bars(t, late=LATE).where(F.col("bucket_start_ms") + H > span[1] - LATE_MS), ["symbol", "bucket_start_ms"])


@query(
    "stream_batch_parity",
    f"""select name, count(*) as compared, count(*) filter (abs(a - b) > 1e-6) as different from (select unnest(['trade_count', 'trade_qty', 'trade_notional']) as name, unnest([l.trade_count::double, l.trade_qty, l.trade_notional]) as a,
    unnest([w.trade_count::double, w.trade_qty, w.trade_notional]) as b from live_bars l join bars w using (symbol, bucket_start_ms) where {_closed(H)}) group by name""",
    ["live_bars", "bars", "span"],
)
def stream_batch_parity(spark, sf_dir):
    """The stream's final bars against the batch's, number by number; rows behind the watermark make the difference."""
    live = stream_bars(spark, sf_dir).where("is_final")
    batch = r.regime_bars(a.bbo(spark, sf_dir), a.trades(spark, sf_dir), a.prices(spark, sf_dir), H).where("trade_count is not null")
    return s.parity(live, batch, ["symbol", "bucket_start_ms"], ["trade_count", "trade_qty", "trade_notional"], 1e-6)


@query(
    "stream_sliding_bars",
    f"""select symbol, bucket_start_ms, count(*) as trade_count, sum(qty) as trade_qty, {_closed(2 * H)} as is_final from (select *, unnest([event_ts_ms // {H} * {H}, event_ts_ms // {H} * {H} - {H}]) as bucket_start_ms from trades_come)
    where wm is null or bucket_start_ms + {2 * H} > wm group by all""",
    ["trades_come", "span"],
    "trade_qty",
)
def stream_sliding_bars(spark, sf_dir):
    """Two-hour bars every hour."""
    span = _span(spark, sf_dir)
    t = a.trades(spark, sf_dir)
    bars = lambda x: st.stream_bars(x, "2 hours", "1 hour", LATE).select("symbol", "bucket_start_ms", "trade_count", "trade_qty")
    final = replay({"trades": _come(t, span)}, shared(spark), lambda x: bars(x["trades"]))
    return with_open(final, bars(t).where(F.col("bucket_start_ms") + 2 * H > span[1] - LATE_MS), ["symbol", "bucket_start_ms"])


@query("stream_dedup", "select symbol, history_id, event_ts_ms, qty from trades", ["trades"], "qty")
def stream_dedup(spark, sf_dir):
    """S3: a stream in which a third of the rows comes twice, the second time a slice later."""
    span = _span(spark, sf_dir)
    t = _come(a.trades(spark, sf_dir), span)
    again = t.where("history_id % 3 = 0").withColumn("__slice", F.least(F.lit(2), F.col("__slice") + 1))
    out = replay({"trades": t.unionByName(again)}, shared(spark), lambda x: st.stream_dedup(x["trades"], ["symbol", "history_id"], "60 days").drop("ts"))
    return out.select("symbol", "history_id", "event_ts_ms", "qty")


view("liq_come", f"select * from trades_slices join (select s as slice, (select max(event_ts_ms) from trades_slices where slice < s and trade_class = 'liquidation') - {LATE_MS} as wm from range(3) t(s)) using (slice) where trade_class = 'liquidation'", ["trades_slices"])


def _sessions(rows):
    return f"""select *, sum(coalesce((event_ts_ms - before >= {H})::int, 0)) over (partition by symbol order by event_ts_ms, history_id) as b from (
    select *, lag(event_ts_ms) over (partition by symbol order by event_ts_ms, history_id) as before from {rows})"""


view("liq_mark", f"select s as slice, (select max(event_ts_ms) from liq_come where slice < s) - {LATE_MS} as wm from range(4) t(s)", ["liq_come"])
# what a run has closed takes no later row: the sessions of the first two slices that the third finds closed are apart
view("liq_early", f"select *, max(event_ts_ms) over (partition by symbol, b) + {H} <= (select wm from liq_mark where slice = 2) as closed from ({_sessions('(select * from liq_come where slice < 2 and (wm is null or event_ts_ms + ' + str(H) + ' > wm))')})", ["liq_come", "liq_mark"])
view("liq_late", f"{_sessions('(select symbol, event_ts_ms, history_id, qty from liq_early where not coalesce(closed, false) union all select symbol, event_ts_ms, history_id, qty from liq_come where slice = 2 and (wm is null or event_ts_ms + ' + str(H) + ' > wm))')}", ["liq_come", "liq_early"])
_BURST = "count(*) as n_trades, sum(qty) as qty, min(event_ts_ms) as start_ms, max(event_ts_ms) as end_ms"


@query(
    "stream_bursts",
    f"""select symbol, n_trades, qty, start_ms, end_ms, end_ms + {H} <= (select wm from liq_mark where slice = 3) as is_final from (select symbol, {_BURST} from liq_early where closed group by symbol, b union all select symbol, {_BURST} from liq_late group by symbol, b) where n_trades >= 2""",
    ["liq_early", "liq_late", "liq_mark"],
    "qty",
)
def stream_bursts(spark, sf_dir):
    """Bursts of liquidations as session windows; open ones are flagged."""
    span = _span(spark, sf_dir)
    t = _come(a.trades(spark, sf_dir).where(r.is_liquidation(["trade_class"])), span)
    final = replay({"trades": t}, shared(spark), lambda x: st.stream_bursts(x["trades"], "1 hour", LATE))
    return with_open(final, st.open_bursts(t, H, LATE_MS), ["symbol", "start_ms"])


@query("stream_latest", "select symbol, count(*) as n, max(event_ts_ms) as event_ts_ms, arg_max(price, (event_ts_ms, history_id)) as price, arg_max(qty, (event_ts_ms, history_id)) as qty from trades group by symbol", ["trades"], "price qty")
def stream_latest(spark, sf_dir):
    """The newest trade of each symbol, kept up to date."""
    t = _come(a.trades(spark, sf_dir), _span(spark, sf_dir))
    return replay({"trades": t}, shared(spark), lambda x: st.stream_latest(x["trades"], ["price", "qty"]), mode="complete")


@query(
    "stream_staleness",
    "select symbol, (select max(event_ts_ms) from trades) - m as age_ms, case when m is null then 'missing' when (select max(event_ts_ms) from trades) - m > 600000 then 'stale' else 'fresh' end as state from (select distinct symbol from trades) left join (select symbol, max(event_ts_ms) as m from trades where symbol <> 'signup' group by symbol) using (symbol)",
    ["trades"],
)
def stream_staleness(spark, sf_dir):
    """Which symbols have been silent for ten minutes, or always."""
    t, span = a.trades(spark, sf_dir), _span(spark, sf_dir)
    latest = replay({"trades": _come(t.where("symbol <> 'signup'"), span)}, shared(spark), lambda x: st.stream_latest(x["trades"], ["price"]), mode="complete")
    return st.staleness(latest, span[1], 600_000, t)


@query("stream_silver", "select event_ts_ms, event_ts_ms + event_id % 50 as recv_ms, event_type as symbol, px + k / 100::double as high, k as trade_count from px", ["px"], "high")
def stream_silver(spark, sf_dir):
    """Raw lines normalised as they arrive."""
    at = lambda c: F.get_json_object("value", f"$.{c}").cast("long").alias(c)
    lines = _come(a.raw_lines(spark, sf_dir).select("value", at("event_ts_ms"), at("recv_ms")), _span(spark, sf_dir)).select("value", "__slice")
    return replay({"lines": lines}, shared(spark), lambda x: raw.dispatch(x["lines"])["candle"]).select("event_ts_ms", "recv_ms", "symbol", "high", "trade_count")


LIMITS = r.GovernorThresholds(min_trade_count=2, max_spread_bps=120, min_top_depth_notional=4_000, skip_toxicity_score=0.8, max_mark_oracle_basis_abs_bps=60)
_IN = f"wm is null or event_ts_ms // {H} * {H} + {H} > wm"


@query(
    "stream_governor",
    f"""select symbol, bucket_start_ms, case when coalesce(bbo_updates, 0) < 1 or coalesce(trade_count, 0) < 2 or coalesce(trade_notional, 0) < 1 or coalesce(price_updates, 0) < 1 then 'SKIP_STALE_DATA' when coalesce(avg_spread_bps, 120) >= 120 then 'SKIP_WIDE_SPREAD'
    when coalesce(depth, 0) < 4000 then 'SKIP_LOW_DEPTH' when coalesce(imbalance, 0.8) >= 0.8 then 'SKIP_TOXIC_REGIME' when coalesce(abs(basis), 60) >= 60 then 'SKIP_MARK_ORACLE_DISLOCATION' else 'TRADABLE_DIAGNOSTIC' end as governor_decision, {_closed(H)} as is_final
    from (select symbol, event_ts_ms // {H} * {H} as bucket_start_ms, count(*) as bbo_updates, avg(spread_bps) as avg_spread_bps, avg(top_bid_notional) + avg(top_ask_notional) as depth from bbo_come where {_IN} group by all)
    full join (select symbol, event_ts_ms // {H} * {H} as bucket_start_ms, count(*) as trade_count, sum(notional) as trade_notional, abs(sum(user_id % 3 - 1)) / count(*)::double as imbalance from trades_come where {_IN} group by all) using (symbol, bucket_start_ms)
    full join (select symbol, event_ts_ms // {H} * {H} as bucket_start_ms, count(*) as price_updates, arg_max(mark_oracle_basis_bps, (event_ts_ms, recv_ms)) as basis from prices_come where {_IN} group by all) using (symbol, bucket_start_ms)""",
    ["bbo_come", "trades_come", "prices_come", "span"],
)
def stream_governor(spark, sf_dir):
    """Decisions on a stream's bars of all channels. Ranks over a whole table are nothing for a stream: the bar's imbalance stands for toxicity."""
    span = _span(spark, sf_dir)
    signed = a.trades(spark, sf_dir).withColumns({"signed_qty": (F.col("user_id") % 3 - 1).cast("double"), "qty": F.lit(1.0)})
    tables = {"bbo": a.bbo(spark, sf_dir), "trades": signed, "prices": a.prices(spark, sf_dir)}

    def decided(x, late=None):
        bars = r.regime_bars(x["bbo"], x["trades"], x["prices"], H, late).withColumn("toxicity_score", F.col("abs_trade_imbalance"))
        return r.governor(bars, LIMITS).select("symbol", "bucket_start_ms", "governor_decision")

    final = replay({k: _come(t, span) for k, t in tables.items()}, shared(spark), lambda x: decided(x, LATE))
    return with_open(final, decided(tables).where(F.col("bucket_start_ms") + H > span[1] - LATE_MS), ["symbol", "bucket_start_ms"])
