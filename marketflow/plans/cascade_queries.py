"""Queries of windows and the liquidations that follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import cascades as ca
from marketflow.operators import order_events as o
from marketflow.plans.event_queries import events
from marketflow.registry import query, view
from marketflow.sources import adapters as a

LENGTH, STRIDE, HORIZONS = 20, 10, [5, 20]
view("cw_idx", "select symbol, session, ts_ms, vwap, total_qty, row_number() over (partition by symbol, session order by ts_ms) - 1 as idx from oev", ["oev"])
view("cw_liq", "select symbol, session, ts_ms, arg_min(price, order_id) as price from fills where l_linenumber = 7 group by all", ["fills"])
view(
    "cw_rows",
    f"""select e.symbol, e.session, e.idx - {LENGTH - 1} as window_start, e.ts_ms as anchor_ts, e.vwap as anchor_vwap, h::int as horizon, f.ts_ms as end_ts, ln(f.vwap / e.vwap) as fwd, l.ts_ms as liq_ts, l.price as liq_price from (select * from cw_idx where idx >= {LENGTH - 1} and (idx - {LENGTH - 1}) % {STRIDE} = 0) e
    asof left join cw_liq l on e.symbol = l.symbol and e.session = l.session and e.ts_ms < l.ts_ms, (select unnest({HORIZONS}) as h) h join cw_idx f on f.symbol = e.symbol and f.session = e.session and f.idx = e.idx + h""",
    ["cw_idx", "cw_liq"],
)


def _anchors(spark, sf_dir):
    liq = a.fills(spark, sf_dir).where("l_linenumber = 7").select(*o.DAY, "ts_ms", "price", F.col("order_id").alias("tie"))
    return ca.anchors(events(spark, sf_dir), liq, LENGTH, STRIDE, HORIZONS)


@query("cascade_directions", "select symbol, session, window_start, anchor_ts, anchor_vwap, horizon, end_ts, fwd, case when liq_ts <= end_ts then sign(liq_price - anchor_vwap)::int else 0 end as direction from cw_rows", ["cw_rows"], "anchor_vwap fwd")
def cascade_directions(spark, sf_dir):
    """M9: windows with the direction of the first liquidation within the horizon."""
    return ca.direction_dataset(_anchors(spark, sf_dir))


_F = ["log_return", "total_qty"]
view("cw_flat", f"select symbol, session, w as window_start, {', '.join(f'avg({c}) as {c}_mean, stddev_pop({c}) as {c}_std, arg_max({c}, idx) as {c}_last' for c in _F)} from (select *, coalesce(ln(vwap / lag(vwap) over (partition by symbol, session order by idx)), 0) as log_return, count(*) over (partition by symbol, session) as n from cw_idx), range(0, 100000, {STRIDE}) t(w) where w <= idx and idx < w + {LENGTH} and w + {LENGTH} <= n group by all", ["cw_idx"])


@query(
    "cascade_windows",
    """select * exclude (m, liq_ts, liq_price), coalesce(liq_ts <= end_ts, false)::int as real_label, coalesce(m > case when count(m) over w >= 10 then quantile_cont(m, 0.9) over w end, false)::int as synthetic_label from (select *, abs(fwd) as m from cw_rows) join cw_flat using (symbol, session, window_start)
    window w as (partition by symbol, session, horizon order by window_start rows between 49 preceding and current row)""",
    ["cw_rows", "cw_flat"],
    "anchor_vwap fwd " + " ".join(f"{c}_{s}" for c in _F for s in ("mean", "std", "last")),
)
def cascade_windows(spark, sf_dir):
    """M8: windows with features, forward returns, and labels of real and of synthetic cascades."""
    w = o.ordered("ts_ms")
    x = events(spark, sf_dir).withColumn("log_return", F.coalesce(F.log(F.col("vwap") / F.lag("vwap").over(w)), F.lit(0.0)))
    flat = o.flat_features(x, _F, LENGTH, STRIDE).select(*o.DAY, "window_start", *[f"{c}_{s}" for c in _F for s in ("mean", "std", "last")])
    return ca.cascade_windows(_anchors(spark, sf_dir), flat, 50, 10)
