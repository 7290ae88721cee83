"""Queries over context, validation, evaluation, manifests, ledgers, raw logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import regime as r
from marketflow.operators import studies as s
from marketflow.plans import silver_queries  # noqa: F401  its views
from marketflow.registry import query, view
from marketflow.sources import adapters as a
from marketflow.sources import raw
from marketflow.sources.shared import shared


view("refbars", "select symbol, event_ts_ms // 3600000 * 3600000 as bucket_start_ms, arg_max(price, (event_ts_ms, history_id)) as reference_mid, avg(qty) / 1e6 as reference_funding from trades where user_id % 2 = 1 group by all", ["trades"])


def _reference(spark, sf_dir):
    t = a.trades(spark, sf_dir).where("user_id % 2 = 1")
    return t.groupBy("symbol", r.bucket(a.HOUR_MS)).agg(F.max_by("price", F.struct("event_ts_ms", "history_id")).alias("reference_mid"), (F.avg("qty") / 1e6).alias("reference_funding"))


view("ctx", "select s.symbol, s.bucket_start_ms, r.symbol is not null as covered, case when reference_mid > 0 then (last_mid / reference_mid - 1) * 10000 end as premium_bps, funding - reference_funding as funding_divergence from bars s left join refbars r using (symbol, bucket_start_ms)", ["bars", "refbars"])


def _bars(spark, sf_dir):
    return r.regime_bars(a.bbo(spark, sf_dir), a.trades(spark, sf_dir), a.prices(spark, sf_dir), a.HOUR_MS)


@query("reference_context", "select * from ctx", ["ctx"], "premium_bps funding_divergence")
def reference_context(spark, sf_dir):
    """State beside a reference market."""
    return s.reference_context(_bars(spark, sf_dir), _reference(spark, sf_dir)).select("symbol", "bucket_start_ms", "covered", "premium_bps", "funding_divergence")


@query("reference_summary", "select symbol, count(*) as n, count(*) filter (covered) as covered, avg(premium_bps) as mean_premium_bps, avg(abs(funding_divergence)) as mean_abs_divergence from ctx group by symbol", ["ctx"], "mean_premium_bps mean_abs_divergence")
def reference_summary(spark, sf_dir):
    """Coverage and premium by symbol."""
    x = s.reference_context(_bars(spark, sf_dir), _reference(spark, sf_dir))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("covered").alias("covered"), F.avg("premium_bps").alias("mean_premium_bps"), F.avg(F.abs("funding_divergence")).alias("mean_abs_divergence"))


@query(
    "market_beta",
    """select b.symbol, b.bucket_start_ms, b.mid_return_bps, x.mid_return_bps as major_a, y.mid_return_bps as major_b, case when x.mid_return_bps is not null and y.mid_return_bps is not null then 'both'
    when x.mid_return_bps is not null or y.mid_return_bps is not null then 'partial' else 'none' end as coverage, (x.mid_return_bps + y.mid_return_bps) / 2 as market_return_bps
    from bars b left join (select * from bars where symbol = 'click') x using (bucket_start_ms) left join (select * from bars where symbol = 'view') y using (bucket_start_ms)""",
    ["bars"],
    "mid_return_bps major_a major_b market_return_bps",
)
def market_beta(spark, sf_dir):
    """The majors' mean return beside every bar."""
    return s.market_beta(_bars(spark, sf_dir), ("click", "view"))


view("cal", "select event_ts_ms as event_ms, event_type || '-' || (k % 7) as event_type, case k % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as severity, event_ts_ms - k * 60000 as start_ms, event_ts_ms + 3600000 as end_ms from ev where event_type = 'error' and k >= 95", ["ev"])


@query(
    "event_risk",
    """select bucket_start_ms, coalesce(n, 0)::bigint as n_active, case r when 1 then 'low' when 2 then 'medium' when 3 then 'high' end as max_severity, coalesce(t, '') as types from (select distinct bucket_start_ms from bars) left join
    (select bucket_start_ms, count(*) as n, max(case severity when 'low' then 1 when 'medium' then 2 else 3 end) as r, array_to_string(list_sort(list_distinct(list(event_type))), ';') as t
     from (select distinct bucket_start_ms from bars) join cal on bucket_start_ms between start_ms and end_ms group by all) using (bucket_start_ms)""",
    ["bars", "cal"],
)
def event_risk(spark, sf_dir):
    """Buckets inside calendar windows."""
    e = a.events(spark, sf_dir).where("event_type = 'error' and k >= 95")
    cal = e.select(
        F.col("event_ts_ms").alias("event_ms"), F.concat_ws("-", "event_type", F.col("k") % 7).alias("event_type"), F.element_at(F.array(*map(F.lit, s.SEVERITIES)), (F.col("k") % 3 + 1).cast("int")).alias("severity"),
        (F.col("event_ts_ms") - F.col("k") * 60_000).alias("start_ms"), (F.col("event_ts_ms") + 3_600_000).alias("end_ms"),
    )
    return s.event_risk(_bars(spark, sf_dir), cal)


@query(
    "manifest_diff",
    """select coalesce(p.c_custkey, c.c_custkey) as c_custkey, case when p.c_custkey is null then 'new' when c.c_custkey is null then 'removed' when p.f is not distinct from c.f then 'unchanged' else 'changed' end as change
    from (select c_custkey, c_acctbal as f from customer where c_custkey % 10 <> 0) p full join (select c_custkey, case when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end as f from customer where c_custkey % 10 <> 1) c on p.c_custkey = c.c_custkey""",
)
def manifest_diff(spark, sf_dir):
    """Changes between two manifests."""
    c = a.table(spark, sf_dir, "customer")
    now = c.where("c_custkey % 10 <> 1").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("f"))
    return s.manifest_diff(c.where("c_custkey % 10 <> 0").select("c_custkey", F.col("c_acctbal").alias("f")), now, "c_custkey", "f")


view("inv", "select regexp_replace(url, '^[a-z]+://', '') as key, strlen(html) as size_bytes, page_id, page_id % 5 as channel, page_id % 3 as day from pages")


def _inventory(spark, sf_dir):
    p = a.table(spark, sf_dir, "pages")
    return p.select(F.regexp_replace("url", "^[a-z]+://", "").alias("key"), F.octet_length("html").cast("long").alias("size_bytes"), "page_id", (F.col("page_id") % 5).alias("channel"), (F.col("page_id") % 3).alias("day"))


@query(
    "sidecar_pairing",
    """with objects as (select key || '#' || page_id as key from inv where page_id % 11 <> 0 union all select key || '#' || page_id || '.sha256' from inv where page_id % 9 <> 0)
    select key, 'missing_sidecar' as problem from objects where not ends_with(key, '.sha256') and key || '.sha256' not in (select key from objects)
    union all select left(key, -7), 'orphan_sidecar' from objects where ends_with(key, '.sha256') and left(key, -7) not in (select key from objects)""".replace("with objects as", "select * from (with objects as") + ")",
    ["inv"],
)
def sidecar_pairing(spark, sf_dir):
    """Payloads and sidecars without their partner."""
    i = _inventory(spark, sf_dir).withColumn("key", F.concat_ws("#", "key", "page_id"))
    return s.sidecar_pairing(i.where("page_id % 11 <> 0").select("key").unionByName(i.where("page_id % 9 <> 0").select(F.concat("key", F.lit(".sha256")).alias("key"))))


@query("inventory_coverage", "select channel, day, grouping(channel, day) as level, count(*) as n_objects, sum(size_bytes)::bigint as n_bytes, max(key) as latest from inv group by grouping sets ((channel), (day), (channel, day), ())", ["inv"])
def inventory_coverage(spark, sf_dir):
    """Coverage by grouping sets."""
    return s.inventory_coverage(_inventory(spark, sf_dir))


@query(
    "pair_mismatch",
    "select symbol, session, 'left' as only_in from (select symbol, session from fills except select symbol, session from levels) union all select symbol, session, 'right' from (select symbol, session from levels except select symbol, session from fills)",
    ["fills", "levels"],
)
def pair_mismatch(spark, sf_dir):
    """Sessions that only one side has."""
    return s.mismatched_pairs(a.fills(spark, sf_dir), a.book(spark, sf_dir), ["symbol", "session"])


view("rets", "select event_type as symbol, event_ts_ms, event_id as id, hour(ts::timestamp) as hour, strftime(ts::timestamp, '%Y-%m-%d') as date, value - 50 as strategy_return_bps, (k - 50) / 10::double as baseline_return_bps from ev", ["ev"])


def _returns(spark, sf_dir):
    e = a.events(spark, sf_dir)
    return e.select(F.col("event_type").alias("symbol"), "event_ts_ms", F.col("event_id").alias("id"), F.hour("ts").alias("hour"), F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("value") - 50).alias("strategy_return_bps"), ((F.col("k") - 50) / 10).alias("baseline_return_bps"))


@query(
    "drawdown",
    """select symbol, sum(v) as total, min(d) as max_drawdown from (select *, c - max(c) over (partition by symbol order by date) as d from (select *, sum(v) over (partition by symbol order by date) as c from
    (select symbol, date, sum(strategy_return_bps) as v from rets group by all))) group by symbol""",
    ["rets"],
    "total max_drawdown",
)
def drawdown(spark, sf_dir):
    """Deepest fall of the daily curve."""
    return s.drawdown(_returns(spark, sf_dir).groupBy("symbol", "date").agg(F.sum("strategy_return_bps").alias("v")), "symbol", "date", "v")


view("dates", "select date, row_number() over (order by date) - 1 as i from (select distinct date from rets)", ["rets"])
view("wfw", "select s // 3 as \"window\", a.date as train_start, b.date as test_start, c.date as test_end from range(0, 1000, 3) t(s) join dates a on a.i = s join dates b on b.i = s + 12 join dates c on c.i = s + 16", ["dates"])


@query("walk_forward_windows", "select * from wfw", ["wfw"])
def walk_forward_windows(spark, sf_dir):
    """Purged train and test windows."""
    return s.walk_forward_windows(_returns(spark, sf_dir), 10, 2, 5, 3)


view("oos", 'select * from rets join wfw on date between test_start and test_end', ["rets", "wfw"])
_conc = lambda c, name: f'(select "window", max(n) / sum(n)::double as max_{name}_concentration from (select "window", {c}, count(*) as n from oos group by all) group by all)'


@query(
    "walk_forward_scorecard",
    f"""select *, net_pnl_bps - baseline_pnl_bps as excess_vs_baseline_bps from (select "window", count(*) as test_rows, count(distinct date) as distinct_test_days, count(distinct symbol) as distinct_symbols, sum(strategy_return_bps) as net_pnl_bps, sum(baseline_return_bps) as baseline_pnl_bps,
    avg(strategy_return_bps) as mean_return_bps, case when min(strategy_return_bps) < 0 then avg(strategy_return_bps) / sqrt(avg(pow(least(strategy_return_bps, 0), 2))) when avg(strategy_return_bps) > 0 then 'inf'::double when avg(strategy_return_bps) < 0 then '-inf'::double end as sortino from oos group by all)
    join (select "window", min(c - p) as max_drawdown_bps from (select *, max(c) over (partition by "window" order by event_ts_ms, id) as p from (select *, sum(strategy_return_bps) over (partition by "window" order by event_ts_ms, id) as c from oos)) group by all) using ("window")
    join {_conc('date', 'day')} using ("window") join {_conc('symbol', 'symbol')} using ("window") join {_conc('hour', 'hour')} using ("window")""",
    ["oos"],
    "net_pnl_bps baseline_pnl_bps mean_return_bps sortino max_drawdown_bps excess_vs_baseline_bps max_day_concentration max_symbol_concentration max_hour_concentration",
)
def walk_forward_scorecard(spark, sf_dir):
    """Scorecard of test windows."""
    x = _returns(spark, sf_dir)
    return s.walk_forward_scorecard(x, s.window_dates(x, 10, 2, 5, 3))


@query("oos_rows", "select distinct id, symbol, date from oos", ["oos"])
def oos_rows(spark, sf_dir):
    """Rows inside any test window, once."""
    x = _returns(spark, sf_dir)
    return s.oos_rows(x, s.window_dates(x, 10, 2, 5, 3)).select("id", "symbol", "date")


view("scored", "select event_type as symbol, k as score, (value > 60 or (value > 40 and k > 50))::int as label from ev", ["ev"])


def _scored(spark, sf_dir):
    return a.events(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.col("k").alias("score"), ((F.col("value") > 60) | ((F.col("value") > 40) & (F.col("k") > 50))).cast("int").alias("label"))


view("aucs", "select symbol, sum(p)::bigint as positives, sum(n)::bigint as negatives, sum(p * (below + n / 2.0::double)) / nullif(sum(p) * sum(n), 0)::double as auc from (select *, coalesce(sum(n) over (partition by symbol order by score rows between unbounded preceding and 1 preceding), 0) as below from (select symbol, score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from scored group by all)) group by symbol", ["scored"])


@query("auc", "select * from aucs", ["aucs"], "auc")
def auc(spark, sf_dir):
    """Tie-aware area under the curve."""
    return s.auc(_scored(spark, sf_dir), "symbol", "score", "label")


@query("benjamini_hochberg", "select symbol, positives, negatives, auc, least(min(q0) over (order by auc, symbol rows between current row and unbounded following), 1.0) as q from (select *, auc * count(*) over () / row_number() over (order by auc, symbol) as q0 from aucs)", ["aucs"], "auc q")
def benjamini_hochberg(spark, sf_dir):
    """Step-up adjustment."""
    return s.benjamini_hochberg(s.auc(_scored(spark, sf_dir), "symbol", "score", "label"), "auc", "symbol")


@query("subsample_windows", "select symbol, history_id from (select *, row_number() over (partition by symbol, event_ts_ms // 86400000 order by md5('5:' || history_id), history_id) as n from trades) where n <= 20", ["trades"])
def subsample_windows(spark, sf_dir):
    """K7, K8: a seeded sample per symbol and day."""
    t = a.trades(spark, sf_dir).withColumn("day", F.expr("event_ts_ms div 86400000"))
    return s.sample_per_group(t, ["symbol", "day"], F.col("history_id"), 20, 5).select("symbol", "history_id")


view("lfills", "select 'U' || user_id as symbol, event_ts_ms as ts_ms, history_id as fill_id, case when trade_class = 'liquidation' then 'funding' when signed_qty > 0 then 'buy' else 'sell' end as side, price, qty as quantity, case when qty::bigint % 2 = 0 then 'maker' else 'taker' end as liquidity, qty / 100 - 0.3 as funding_payment from trades", ["trades"])
view(
    "ledger0",
    """select *, price * quantity as notional, case when side = 'funding' then 0 when liquidity = 'maker' then price * quantity * 1.5::double / 10000 else price * quantity * 4.0::double / 10000 end as fee_paid,
    case when side = 'funding' then funding_payment else 0 end as funding_paid, sum(case side when 'buy' then quantity when 'sell' then -quantity else 0 end) over (partition by symbol order by ts_ms, fill_id) as position_after_fill,
    row_number() over (partition by symbol order by ts_ms, fill_id) as n from lfills""",
    ["lfills"],
)
view(
    "ledger1",
    """select * from (with recursive steps as (
    select symbol, 0::bigint as n, 0::double as cost, 0::double as gain from ledger0 group by symbol union all
    select l.symbol, l.n, case when side = 'buy' and position_after_fill > 0 then (cost * (position_after_fill - quantity) + notional) / position_after_fill when side = 'sell' and position_after_fill <= 0 then 0 else cost end,
    case when side = 'sell' then (price - cost) * least(quantity, greatest(position_after_fill + quantity, 0)) else 0 end from steps s join ledger0 l on l.symbol = s.symbol and l.n = s.n + 1) select * from steps where n > 0)""",
    ["ledger0"],
)
view(
    "ledger",
    """select *, equity - max(equity) over (order by ts_ms, fill_id) as drawdown from (select *, cumulative_realized_pnl - cumulative_fees_paid - cumulative_funding_paid as cumulative_net_pnl, 1000 + cumulative_realized_pnl - cumulative_fees_paid - cumulative_funding_paid as equity from (
    select l.symbol, ts_ms, fill_id, side, price, quantity, notional, fee_paid, funding_paid, position_after_fill, cost as average_cost, gain as realized_pnl_on_fill, sum(gain) over (order by ts_ms, fill_id) as cumulative_realized_pnl,
    sum(fee_paid) over (order by ts_ms, fill_id) as cumulative_fees_paid, sum(funding_paid) over (order by ts_ms, fill_id) as cumulative_funding_paid from ledger0 l join ledger1 s on l.symbol = s.symbol and l.n = s.n))""",
    ["ledger0", "ledger1"],
)


def _ledger(spark, sf_dir):
    t = a.trades(spark, sf_dir)
    side = F.when(F.col("trade_class") == "liquidation", "funding").when(F.col("signed_qty") > 0, "buy").otherwise("sell")
    liquidity = F.when(F.col("qty").cast("long") % 2 == 0, "maker").otherwise("taker")
    fills = t.select(F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.col("event_ts_ms").alias("ts_ms"), F.col("history_id").alias("fill_id"), side.alias("side"), "price", F.col("qty").alias("quantity"), liquidity.alias("liquidity"), (F.col("qty") / 100 - 0.3).alias("funding_payment"))
    return s.paper_ledger(fills, 1000.0)


@query("paper_ledger", "select * from ledger", ["ledger"], "price quantity notional fee_paid funding_paid position_after_fill average_cost realized_pnl_on_fill cumulative_realized_pnl cumulative_fees_paid cumulative_funding_paid cumulative_net_pnl equity drawdown", digits=4)
def paper_ledger(spark, sf_dir):
    """M1: positions, average costs, fees, funding, equity and drawdown after every fill."""
    return _ledger(spark, sf_dir)


@query("ledger_positions", "select symbol, arg_max(position_after_fill, (ts_ms, fill_id)) as quantity, arg_max(average_cost, (ts_ms, fill_id)) as average_cost from ledger group by symbol", ["ledger"], "quantity average_cost", digits=4)
def ledger_positions(spark, sf_dir):
    """M1: final positions."""
    return s.ledger_positions(_ledger(spark, sf_dir))


@query("ledger_summary", "select *, realized_pnl - fees_paid - funding_paid as net_pnl, 1000 + realized_pnl - fees_paid - funding_paid as ending_equity from (select sum(realized_pnl_on_fill) as realized_pnl, sum(fee_paid) as fees_paid, sum(funding_paid) as funding_paid, min(drawdown) as max_drawdown, count(*) as fills, count(distinct symbol) as symbols from ledger)", ["ledger"], "realized_pnl fees_paid funding_paid max_drawdown net_pnl ending_equity", digits=4)
def ledger_summary(spark, sf_dir):
    """M1: totals of the ledger."""
    return s.ledger_summary(_ledger(spark, sf_dir), 1000.0)


@query(
    "round_trip_costs",
    """select *, round(net_pnl / initial_notional * 10000, 10) as net_return_bps from (select *, round(gross_pnl - fees_paid - slippage_paid - adverse_selection_paid - funding_paid, 10) as net_pnl from (
    select history_id, price * qty as initial_notional, fees as fee_bps_total, round(sgn * ((price + 1) - price) * qty, 10) as gross_pnl, round(price * qty * fees / 10000, 10) as fees_paid, round(price * qty * (coalesce(slip, 1.0::double) * 2) / 10000, 10) as slippage_paid,
    round(price * qty * (0.5::double * 2) / 10000, 10) as adverse_selection_paid, round(sgn * (price * qty) * 0.1::double / 10000 * hours, 10) as funding_paid from (
    select *, case when signed_qty > 0 then 1 else -1 end as sgn, case when qty::bigint % 2 = 0 then 1.5::double else 4.0::double end + case when qty::bigint % 3 = 0 then 1.5::double else 4.0::double end as fees, case when qty::bigint % 5 <> 0 then qty / 40 end as slip, qty::bigint % 24 as hours from trades)))""",
    ["trades"],
    "initial_notional fee_bps_total gross_pnl fees_paid slippage_paid adverse_selection_paid funding_paid net_pnl net_return_bps",
)
def round_trip_costs(spark, sf_dir):
    """Result of round trips after fees, slippage, adverse selection and funding."""
    q = F.col("qty").cast("long")
    t = a.trades(spark, sf_dir).select(
        "history_id", F.when(F.col("signed_qty") > 0, "long").otherwise("short").alias("side"), F.when(q % 2 == 0, "maker").otherwise("taker").alias("entry_liquidity"), F.when(q % 3 == 0, "maker").otherwise("taker").alias("exit_liquidity"),
        F.col("price").alias("entry_price"), (F.col("price") + 1).alias("exit_price"), F.col("qty").alias("quantity"), (q % 24).alias("hold_hours"), F.when(q % 5 != 0, F.col("qty") / 40).alias("slippage_bps_per_side"), F.lit(None).cast("double").alias("adverse_selection_bps_per_side"),
    )
    out = s.round_trip_costs(t, slippage_bps=1.0, adverse_bps=0.5, funding_bps_per_hour=0.1)
    return out.select("history_id", "initial_notional", "fee_bps_total", "gross_pnl", "fees_paid", "slippage_paid", "adverse_selection_paid", "funding_paid", "net_pnl", "net_return_bps")


@query("silver_trades", "select event_ts_ms, recv_ms, symbol, 'trades' as channel, price, qty, signed_qty, notional, direction, trade_class, history_id from trades", ["trades"], "price qty signed_qty notional")
def silver_trades(spark, sf_dir):
    """Raw gzip JSON lines written, read and normalised, and the silver table written and read."""
    t = a.trades(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    data = F.to_json(F.struct(F.col("symbol").alias("s"), text("qty").alias("a"), text("price").alias("p"), F.col("direction").alias("d"), F.col("trade_class").alias("tc"), F.col("event_ts_ms").alias("t"), F.col("history_id").alias("h")))
    record = F.struct("recv_ms", "event_ts_ms", F.lit("trades").alias("channel"), "symbol", data.alias("data"))
    path = shared(spark)
    raw.write_raw(t.select(F.lit("trades").alias("channel"), "symbol", F.date_format(F.timestamp_millis("event_ts_ms"), "yyyy-MM-dd").alias("date"), record.alias("record")), f"{path}/raw")
    raw.write_silver(raw.normalize_trades(raw.scan_raw(spark, f"{path}/raw", ["trades"])), f"{path}/silver")
    return raw.scan_silver(spark, f"{path}/silver", "trades").drop("date")


@query("channel_quality", "select 'trades' as channel, count(*) as n, count(distinct symbol) as symbols, min(event_ts_ms) as first_ms, max(event_ts_ms) as last_ms, 0::bigint as incomplete, (count(*) - count(distinct (symbol, event_ts_ms)))::bigint as repeated from trades union all select 'bbo', count(*), count(distinct symbol), min(event_ts_ms), max(event_ts_ms), 0, (count(*) - count(distinct (symbol, event_ts_ms)))::bigint from bbo", ["trades", "bbo"])
def channel_quality(spark, sf_dir):
    """Rows, symbols, time range and repeats by channel."""
    cols = lambda df, name: df.select("symbol", "event_ts_ms", F.lit(name).alias("channel"))
    return raw.channel_quality(cols(a.trades(spark, sf_dir), "trades").unionByName(cols(a.bbo(spark, sf_dir), "bbo")))
