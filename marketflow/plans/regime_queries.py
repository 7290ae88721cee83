"""Queries over regime state: bars, toxicity, governor, eligibility, overlay."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.functions.quantiles import group_quantiles
from marketflow.operators import regime as r
from marketflow.registry import query, view
from marketflow.sources import adapters as a
from marketflow.sources import store
from marketflow.sources.shared import shared, written

H = a.HOUR_MS
HORIZONS = {"1": 1, "6": 6, "24": 24}

view("bbo_b", f"select *, event_ts_ms // {H} * {H} as bucket_start_ms from bbo", ["bbo"])
view("trades_b", f"select *, event_ts_ms // {H} * {H} as bucket_start_ms from trades", ["trades"])
view("prices_b", f"select *, event_ts_ms // {H} * {H} as bucket_start_ms from prices", ["prices"])
view(
    "bars",
    """select symbol, bucket_start_ms, bbo_updates, avg_spread_bps, max_spread_bps, avg_top_bid_notional, avg_top_ask_notional, first_mid, last_mid, order_id_delta,
    trade_count, trade_qty, signed_trade_qty, trade_notional, liquidation_count, liquidation_notional, mark_oracle_basis_bps, funding, open_interest, price_updates,
    case when first_mid <> 0 then (last_mid / first_mid - 1) * 10000 end as mid_return_bps, bbo_updates / 60.0::double as bbo_churn_per_min,
    avg_top_bid_notional + avg_top_ask_notional as top_depth_notional,
    case when trade_count is not null then coalesce(abs(signed_trade_qty) / nullif(trade_qty, 0), 0) end as abs_trade_imbalance, abs(mark_oracle_basis_bps) as mark_oracle_basis_abs_bps
    from (select symbol, bucket_start_ms, count(*) as bbo_updates, avg(spread_bps) as avg_spread_bps, max(spread_bps) as max_spread_bps, avg(top_bid_notional) as avg_top_bid_notional,
      avg(top_ask_notional) as avg_top_ask_notional, arg_min(mid, (event_ts_ms, recv_ms, last_order_id)) as first_mid, arg_max(mid, (event_ts_ms, recv_ms, last_order_id)) as last_mid,
      arg_max(last_order_id, (event_ts_ms, recv_ms, last_order_id)) - arg_min(last_order_id, (event_ts_ms, recv_ms, last_order_id)) as order_id_delta from bbo_b group by all)
    full join (select symbol, bucket_start_ms, count(*) as trade_count, sum(qty) as trade_qty, sum(signed_qty) as signed_trade_qty, sum(notional) as trade_notional,
      sum((trade_class = 'liquidation')::bigint)::bigint as liquidation_count, sum(case when trade_class = 'liquidation' then notional else 0 end) as liquidation_notional from trades_b group by all)
      using (symbol, bucket_start_ms)
    full join (select symbol, bucket_start_ms, arg_max(mark_oracle_basis_bps, (event_ts_ms, recv_ms)) as mark_oracle_basis_bps, arg_max(funding, (event_ts_ms, recv_ms)) as funding,
      arg_max(open_interest, (event_ts_ms, recv_ms)) as open_interest, count(*) as price_updates from prices_b group by all) using (symbol, bucket_start_ms)""",
    ["bbo_b", "trades_b", "prices_b"],
)
view("vol", "select *, coalesce(stddev_samp(mid_return_bps) over (partition by symbol order by bucket_start_ms rows between 4 preceding and current row), 0) as realized_vol_bps from bars", ["bars"])
_RANKS = " + ".join(
    f"(case when min(round(coalesce({m}, 0) * 1.0::double, 8)) over () = max(round(coalesce({m}, 0) * 1.0::double, 8)) over () then 0 else (rank() over (order by round(coalesce({m}, 0) * 1.0::double, 8)) + (count(*) over (partition by round(coalesce({m}, 0) * 1.0::double, 8)) - 1) / 2.0::double) / count(*) over () end)"
    for m in r.TOXICITY_METRICS
)
view("state", f"select *, ({_RANKS}) / 6 as toxicity_score from vol", ["vol"])
view(
    "governed",
    """select *, case when coalesce(bbo_updates, 0) < 1 or coalesce(trade_count, 0) < 1 or coalesce(trade_notional, 0) < 1 or coalesce(price_updates, 0) < 1 then 'SKIP_STALE_DATA'
    when coalesce(avg_spread_bps, 40) >= 40 then 'SKIP_WIDE_SPREAD' when coalesce(top_depth_notional, 0) < 1000 then 'SKIP_LOW_DEPTH' when coalesce(toxicity_score, 0.9) >= 0.9 then 'SKIP_TOXIC_REGIME'
    when coalesce(mark_oracle_basis_abs_bps, 100) >= 100 then 'SKIP_MARK_ORACLE_DISLOCATION' else 'TRADABLE_DIAGNOSTIC' end as governor_decision from state""",
    ["state"],
)
_path = []
for _n, _k in HORIZONS.items():
    _f = f"over (partition by symbol order by bucket_start_ms rows between 1 following and {_k} following)"
    _ok = f"count(last_mid) {_f} = {_k} and last_mid > 0"
    _path.append(
        f"case when {_ok} then (lead(last_mid, {_k}) over (partition by symbol order by bucket_start_ms) / last_mid - 1) * 10000 end as forward_return_{_n}_bps, "
        f"case when {_ok} then (min(last_mid) {_f} / last_mid - 1) * 10000 end as long_adverse_excursion_{_n}_bps, case when {_ok} then -(max(last_mid) {_f} / last_mid - 1) * 10000 end as short_adverse_excursion_{_n}_bps"
    )
view("paths", f"select *, {', '.join(_path)} from state", ["state"])
view("deciled", "select *, least(greatest(ceil(row_number() over (order by toxicity_score, symbol, bucket_start_ms) / count(*) over ()::double * 10)::bigint, 1), 10) as toxicity_decile from paths", ["paths"])
view(
    "long_paths",
    " union all ".join(f"select symbol, bucket_start_ms, toxicity_score, toxicity_decile, '{n}' as horizon, forward_return_{n}_bps as fwd, long_adverse_excursion_{n}_bps as long_adverse, short_adverse_excursion_{n}_bps as short_adverse from deciled where forward_return_{n}_bps is not null" for n in HORIZONS),
    ["deciled"],
)


_STATES: dict = {}


def state(spark, sf_dir):
    """The regime state of a folder's tables, written once in an application and read by all queries that stand on it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATES:
        _STATES[key] = store.write_regime_state(_state(spark, sf_dir), shared(spark))
    return _STATES[key]


def _state(spark, sf_dir):
    return r.regime_state(a.bbo(spark, sf_dir), a.trades(spark, sf_dir), a.prices(spark, sf_dir), H)


BAR_DOUBLES = "avg_spread_bps max_spread_bps avg_top_bid_notional avg_top_ask_notional first_mid last_mid trade_qty signed_trade_qty trade_notional liquidation_notional mark_oracle_basis_bps funding open_interest mid_return_bps bbo_churn_per_min top_depth_notional abs_trade_imbalance mark_oracle_basis_abs_bps"


@query("bbo_bars", "select symbol, bucket_start_ms, bbo_updates, avg_spread_bps, max_spread_bps, first_mid, last_mid, order_id_delta, mid_return_bps, bbo_churn_per_min, top_depth_notional from bars where bbo_updates is not null", ["bars"], "avg_spread_bps max_spread_bps first_mid last_mid mid_return_bps bbo_churn_per_min top_depth_notional")
def bbo_bars(spark, sf_dir):
    """E5: quote bars."""
    b = r.regime_bars(a.bbo(spark, sf_dir), a.trades(spark, sf_dir), a.prices(spark, sf_dir), H).where("bbo_updates is not null")
    return b.select("symbol", "bucket_start_ms", "bbo_updates", "avg_spread_bps", "max_spread_bps", "first_mid", "last_mid", "order_id_delta", "mid_return_bps", "bbo_churn_per_min", "top_depth_notional")


@query("regime_bars", "select * from bars", ["bars"], BAR_DOUBLES)
def regime_bars(spark, sf_dir):
    """All channels' bars in one aggregation."""
    return r.regime_bars(a.bbo(spark, sf_dir), a.trades(spark, sf_dir), a.prices(spark, sf_dir), H)


@query("regime_state", "select symbol, bucket_start_ms, realized_vol_bps, toxicity_score, trade_count, liquidation_count from state", ["state"], "realized_vol_bps toxicity_score")
def regime_state(spark, sf_dir):
    """State with realised volatility and toxicity."""
    return state(spark, sf_dir).select("symbol", "bucket_start_ms", "realized_vol_bps", "toxicity_score", "trade_count", "liquidation_count")


@query("governor_decisions", "select symbol, bucket_start_ms, governor_decision, case when governor_decision = 'TRADABLE_DIAGNOSTIC' then 'diagnostic_only' else 'skip' end as governor_action from governed", ["governed"])
def governor_decisions(spark, sf_dir):
    """Fail-closed rule cascade."""
    return r.governor(state(spark, sf_dir)).select("symbol", "bucket_start_ms", "governor_decision", "governor_action")


@query(
    "governor_summary",
    f"""select place, governor_decision, coalesce(n, 0)::bigint as rows, case when governor_decision <> 'TRADABLE_DIAGNOSTIC' then coalesce(n, 0) else 0 end::bigint as skip_rows,
    coalesce(n, 0) / sum(coalesce(n, 0)) over ()::double as row_share, case when coalesce(n, 0) > 0 and governor_decision <> 'TRADABLE_DIAGNOSTIC' then 1.0::double else 0.0::double end as skip_rate
    from (values {', '.join(f"({i}, '{d}')" for i, d in enumerate(r.DECISIONS))}) as names(place, governor_decision) left join (select governor_decision, count(*) as n from governed group by all) using (governor_decision)""",
    ["governed"],
    "row_share skip_rate",
)
def governor_summary(spark, sf_dir):
    """Decision counts and shares; the flagship."""
    return r.governor_summary(r.governor(state(spark, sf_dir)))


LOOSE = r.EligibilityThresholds(min_days=20, min_observations=300, min_median_top_depth_notional=5_000.0, max_median_spread_bps=110.0, min_median_bbo_updates_per_min=1.0, max_p95_spread_bps=190.0)
view("stateday", "select *, strftime(make_timestamp(bucket_start_ms * 1000), '%Y-%m-%d') as day from state", ["state"])
view(
    "elig",
    """select *, concat_ws(';', case when not sample_gate_pass then 'sample' end, case when not liquidity_gate_pass then 'liquidity' end, case when not spread_cost_gate_pass then 'spread_cost' end,
    case when not activity_gate_pass then 'activity' end, case when not stability_gate_pass then 'stability' end, case when not concentration_gate_pass then 'concentration' end) as failure_reasons,
    sample_gate_pass and liquidity_gate_pass and spread_cost_gate_pass and activity_gate_pass and stability_gate_pass and concentration_gate_pass as eligible from (
    select *, n_days >= 20 and n_observations >= 300 as sample_gate_pass, median_top_depth_notional >= 5000 as liquidity_gate_pass, median_spread_bps <= 110 as spread_cost_gate_pass,
    median_trade_notional_per_min >= 25 and median_bbo_updates_per_min >= 1 as activity_gate_pass, p95_spread_bps <= 190 and mean_toxicity_score <= 0.75 as stability_gate_pass,
    max_day_observation_concentration <= 0.25 as concentration_gate_pass from (
    select symbol, count(*) as n_observations, median(coalesce(top_depth_notional, 0)) as median_top_depth_notional, median(coalesce(avg_spread_bps, 0)) as median_spread_bps, quantile_cont(coalesce(avg_spread_bps, 0), 0.95) as p95_spread_bps,
    median(coalesce(trade_notional, 0)) as median_trade_notional_per_min, median(coalesce(bbo_updates, 0)::double) as median_bbo_updates_per_min, avg(toxicity_score) as mean_toxicity_score from stateday group by symbol)
    join (select symbol, max(n) / sum(n)::double as max_day_observation_concentration, count(*) as n_days from (select symbol, day, count(*) as n from stateday group by all) group by symbol) using (symbol))""",
    ["stateday"],
)


@query("symbol_eligibility", "select * from elig", ["elig"], "median_top_depth_notional median_spread_bps p95_spread_bps median_trade_notional_per_min median_bbo_updates_per_min mean_toxicity_score max_day_observation_concentration")
def symbol_eligibility(spark, sf_dir):
    """Six gates per symbol."""
    return r.symbol_eligibility(state(spark, sf_dir), LOOSE)


@query("gate_counts", " union all ".join(f"select '{g}' as gate, count(*) filter ({g}_gate_pass) as passing, count(*) as symbols from elig" for g in r.GATES), ["elig"])
def gate_counts(spark, sf_dir):
    """Symbols that pass each gate."""
    return r.gate_counts(r.symbol_eligibility(state(spark, sf_dir), LOOSE))


@query("eligibility_verdict", "select case when bool_or(eligible) then 'HAS_ELIGIBLE_SYMBOLS_DIAGNOSTIC' when not bool_or(sample_gate_pass) then 'INSUFFICIENT_SAMPLE_DIAGNOSTIC' else 'NO_ELIGIBLE_SYMBOLS_DIAGNOSTIC' end as verdict from elig", ["elig"])
def eligibility_verdict(spark, sf_dir):
    """Overall verdict."""
    return r.eligibility_verdict(r.symbol_eligibility(state(spark, sf_dir), LOOSE))


def _paths(spark, sf_dir):
    return r.toxicity_deciles(r.forward_paths(state(spark, sf_dir), HORIZONS))


_PATH_COLS = [f"{c}_{n}_bps" for n in HORIZONS for c in ("forward_return", "long_adverse_excursion", "short_adverse_excursion")]


@query("forward_paths", f"select symbol, bucket_start_ms, toxicity_decile, {', '.join(_PATH_COLS)} from deciled", ["deciled"], " ".join(_PATH_COLS))
def forward_paths(spark, sf_dir):
    """Forward paths and toxicity deciles."""
    return _paths(spark, sf_dir).select("symbol", "bucket_start_ms", "toxicity_decile", *_PATH_COLS)


_RISK = "avg({w}fwd{e}) as {p}mean_forward_return, median({w}fwd{e}) as {p}median_forward_return, quantile_cont({w}long_adverse{e}, 0.05) as {p}p05_long_adverse, quantile_cont({w}short_adverse{e}, 0.05) as {p}p05_short_adverse, sqrt(avg({w}pow(least(fwd, 0), 2){e})) as {p}downside_deviation"
_R5 = ["mean_forward_return", "median_forward_return", "p05_long_adverse", "p05_short_adverse", "downside_deviation"]


@query(
    "bucket_risk",
    f"select *, mean_forward_return / nullif(downside_deviation, 0) as sortino_proxy from (select horizon, toxicity_decile, count(*) as n_obs, count(distinct symbol) as n_symbols, {_RISK.format(w='', e='', p='')} from long_paths group by all)",
    ["long_paths"],
    " ".join([*_R5, "sortino_proxy"]),
)
def bucket_risk(spark, sf_dir):
    """Risk by horizon and decile."""
    return r.bucket_risk(r.long_horizons(_paths(spark, sf_dir), list(HORIZONS)))


CUTOFFS = [0.8, 0.9, 0.95]
_DAY = "strftime(make_timestamp(bucket_start_ms * 1000), '%Y-%m-%d')"


@query(
    "overlay_scorecard",
    f"""select *, n_baseline - n_accepted as n_removed, n_accepted / n_baseline::double as retention_rate, (acc_downside_deviation - base_downside_deviation) / nullif(base_downside_deviation, 0) * 100 as delta_downside_pct,
    acc_p05_long_adverse - base_p05_long_adverse as delta_p05_long, acc_p05_short_adverse - base_p05_short_adverse as delta_p05_short, n_days >= 30 and n_baseline - n_accepted >= 100 as sample_gate_pass,
    n_accepted / n_baseline::double >= 0.7 as retention_gate_pass from (
    select horizon, cutoff, threshold, count(*) as n_baseline, count(*) filter (ok) as n_accepted, count(distinct {_DAY}) as n_days, count(distinct case when not ok then {_DAY} end) as removed_days,
    {_RISK.format(w='', e='', p='base_')}, {_RISK.format(w='case when ok then ', e=' end', p='acc_')}, {_RISK.format(w='case when not ok then ', e=' end', p='rem_')} from (
    select *, toxicity_score < threshold as ok from long_paths join (select horizon, cutoff, quantile_cont(toxicity_score, cutoff) as threshold from long_paths, (values (0.8::double), (0.9::double), (0.95::double)) as c(cutoff) group by all) using (horizon)) group by all)""".replace(
        "select horizon, cutoff, quantile_cont(toxicity_score, cutoff) as threshold from long_paths, (values (0.8::double), (0.9::double), (0.95::double)) as c(cutoff) group by all",
        " union all ".join(f"select horizon, {c}::double as cutoff, quantile_cont(toxicity_score, {c}) as threshold from long_paths group by all" for c in CUTOFFS),
    ),
    ["long_paths"],
    " ".join(["threshold", "retention_rate", "delta_downside_pct", "delta_p05_long", "delta_p05_short", *[p + c for p in ("base_", "acc_", "rem_") for c in _R5]]),
)
def overlay_scorecard(spark, sf_dir):
    """Accepted against removed rows by toxicity cutoff."""
    return r.overlay_scorecard(r.long_horizons(_paths(spark, sf_dir), list(HORIZONS)), CUTOFFS)


@query("symbol_toxicity", "select symbol, count(*) as n_obs, avg(toxicity_score) as mean_toxicity, quantile_cont(toxicity_score, 0.95) as p95_toxicity, max(toxicity_score) as max_toxicity from state group by all", ["state"], "mean_toxicity p95_toxicity max_toxicity")
def symbol_toxicity(spark, sf_dir):
    """Toxicity by symbol."""
    x = written(state(spark, sf_dir))
    out = x.groupBy("symbol").agg(F.count("*").alias("n_obs"), F.avg("toxicity_score").alias("mean_toxicity"), F.max("toxicity_score").alias("max_toxicity"))
    return out.join(group_quantiles(x, ["symbol"], {"p95_toxicity": (F.col("toxicity_score"), 0.95)}), "symbol")


@query("hour_toxicity", f"select bucket_start_ms // {H} % 24 as hour, count(*) as n_obs, avg(toxicity_score) as mean_toxicity, avg(avg_spread_bps) as mean_spread_bps from state group by all", ["state"], "mean_toxicity mean_spread_bps")
def hour_toxicity(spark, sf_dir):
    """Toxicity by UTC hour."""
    return state(spark, sf_dir).groupBy(F.expr(f"bucket_start_ms div {H} % 24").alias("hour")).agg(F.count("*").alias("n_obs"), F.avg("toxicity_score").alias("mean_toxicity"), F.avg("avg_spread_bps").alias("mean_spread_bps"))


@query("highest_toxicity", "select symbol, bucket_start_ms, toxicity_score from state order by toxicity_score desc, symbol, bucket_start_ms limit 50", ["state"], "toxicity_score")
def highest_toxicity(spark, sf_dir):
    """L2: the report of the 50 most toxic buckets."""
    return state(spark, sf_dir).select("symbol", "bucket_start_ms", "toxicity_score").orderBy(F.desc("toxicity_score"), "symbol", "bucket_start_ms").limit(50)
