"""Queries of audits: lineage with planted gaps, a candidate table with planted faults, lifecycles of symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import archives as ar
from marketflow.operators import audits as au
from marketflow.plans import regime_queries  # noqa: F401  its views
from marketflow.registry import query, view
from marketflow.sources import adapters as a

H = a.HOUR_MS
_DAY = "strftime(make_timestamp(event_ts_ms * 1000), '%Y-%m-%d')"
# planted: lines without a time, a symbol with silver rows and bars missing, one with notional a little off, one whose bars lack trades
view("l_raw", f"select 'S' || user_id % 40 as symbol, {_DAY} as date, case when history_id % 501 = 0 then null else event_ts_ms end as event_ts_ms, notional, history_id % 3 as file from trades", ["trades"])
view("l_silver", f"select 'S' || user_id % 40 as symbol, {_DAY} as date, event_ts_ms, case when user_id % 40 = 7 then notional * 1.001::double else notional end as notional from trades where not (user_id % 40 = 3 and history_id % 5 = 0) and history_id % 501 <> 0", ["trades"])
view("l_bars", f"select 'S' || user_id % 40 as symbol, {_DAY} as date, event_ts_ms // {H} as bucket, count(*) filter (not (user_id % 40 = 11 and history_id % 7 = 0)) as trade_count, coalesce(sum(notional) filter (not (user_id % 40 = 11 and history_id % 7 = 0)), 0) as trade_notional from trades where user_id % 40 <> 3 and history_id % 501 <> 0 group by all", ["trades"])


def _lineage_sql(by):
    k = ", ".join(by)
    return f"""select * , case when m_all <> 0 then 'median_nonzero' when silver_trade_rows <= 0 then 'no_silver_trades' when silver_trade_rows <> regime_trade_count_sum then 'regime_trade_count_mismatch'
    when raw_trade_rows <> silver_trade_rows or abs(rv - sv) > 1e-6 + 1e-9 * greatest(abs(rv), abs(sv)) then 'sparse_trade_minutes_with_raw_silver_gap' when coalesce(active / nullif(regime_rows, 0)::double, 0) <= 0.5 then 'sparse_trade_minutes_not_missing_trade_lineage' else 'zero_median_unexplained' end as reason from (
    select {k}, coalesce(raw_trade_rows, 0) as raw_trade_rows, coalesce(rv, 0) as rv, coalesce(raw_buckets, 0) as raw_buckets, coalesce(raw_bad, 0) as raw_bad, coalesce(raw_files, 0) as raw_files, coalesce(silver_trade_rows, 0) as silver_trade_rows, coalesce(sv, 0) as sv, coalesce(silver_buckets, 0) as silver_buckets, coalesce(silver_bad, 0) as silver_bad,
    coalesce(regime_rows, 0) as regime_rows, coalesce(active, 0) as active, coalesce(regime_trade_count_sum, 0)::bigint as regime_trade_count_sum, coalesce(gv, 0) as gv, coalesce(m_all, 0) as m_all, coalesce(m_active, 0) as m_active
    from (select {k}, count(event_ts_ms) as raw_trade_rows, sum(case when event_ts_ms is not null then notional end) as rv, count(distinct case when event_ts_ms is not null then (date, event_ts_ms // {H}) end) as raw_buckets, count(*) - count(event_ts_ms) as raw_bad, count(distinct case when event_ts_ms is not null then (date, file) end) as raw_files from l_raw group by all)
    full join (select {k}, count(*) as silver_trade_rows, sum(notional) as sv, count(distinct (date, event_ts_ms // {H})) as silver_buckets, 0 as silver_bad from l_silver group by all) using ({k})
    full join (select {k}, count(*) as regime_rows, count(*) filter (trade_count > 0) as active, sum(trade_count) as regime_trade_count_sum, sum(trade_notional) as gv, median(trade_notional) as m_all, median(trade_notional) filter (trade_count > 0) as m_active from l_bars group by all) using ({k}))"""


_NOTES = """list_filter([case when raw_trade_rows <> silver_trade_rows then 'raw_silver_trade_row_mismatch' end, case when abs(rv - sv) > 1e-6 + 1e-9 * greatest(abs(rv), abs(sv)) then 'raw_silver_notional_mismatch' end, case when silver_trade_rows <> regime_trade_count_sum then 'silver_regime_trade_count_mismatch' end,
    case when abs(sv - gv) > 1e-6 + 1e-9 * greatest(abs(sv), abs(gv)) then 'silver_regime_notional_mismatch' end, case when raw_trade_rows <= 0 and silver_trade_rows > 0 then 'silver_trades_without_local_raw_sample' end, case when raw_bad > 0 then 'raw_invalid_event_ts_rows' end, case when silver_bad > 0 then 'silver_invalid_event_ts_rows' end,
    case when reason = 'sparse_trade_minutes_not_missing_trade_lineage' then 'median_zero_explained_by_sparse_trade_minutes' end, case when reason = 'zero_median_unexplained' then 'zero_median_unexplained' end], lambda x: x is not null)"""
view("l_symbols", f"select *, {_NOTES} as notes from ({_lineage_sql(['symbol'])})", ["l_raw", "l_silver", "l_bars"])
view("l_dates", f"select *, {_NOTES} as notes from ({_lineage_sql(['symbol', 'date'])})", ["l_raw", "l_silver", "l_bars"])


def _lineage(spark, sf_dir, by):
    t = a.trades(spark, sf_dir)
    u, k = F.col("user_id") % 40, F.col("history_id")
    date = F.date_format(F.timestamp_millis("event_ts_ms"), "yyyy-MM-dd")
    t = t.select(F.concat(F.lit("S"), u).alias("symbol"), date.alias("date"), "event_ts_ms", "notional", "history_id", u.alias("u"))
    k, u = F.col("history_id"), F.col("u")
    raw = t.withColumn("event_ts_ms", F.when(k % 501 != 0, F.col("event_ts_ms"))).withColumn("file", k % 3)
    kept = t.where(k % 501 != 0)
    silver = kept.where(~((u == 3) & (k % 5 == 0))).withColumn("notional", F.when(u == 7, F.col("notional") * 1.001).otherwise(F.col("notional")))
    lost = (u == 11) & (k % 7 == 0)
    bars = kept.where(u != 3).groupBy("symbol", "date", F.expr(f"event_ts_ms div {H}").alias("bucket")).agg(F.count_if(~lost).alias("trade_count"), F.sum(F.when(~lost, F.col("notional"))).alias("trade_notional"))
    config = au.LineageConfig(bucket_ms=H)
    return au.lineage(au.trade_lineage(raw, by, "raw", H, "file"), au.trade_lineage(silver, by, "silver", H), au.regime_lineage(bars, by), by, config)


_LINEAGE = """raw_trade_rows, rv as raw_trade_notional_sum, raw_buckets as raw_trade_bucket_count, raw_bad as raw_invalid_event_ts_rows, raw_files as raw_trade_files, silver_trade_rows, sv as silver_trade_notional_sum, silver_buckets as silver_trade_bucket_count, regime_rows, active as regime_trade_active_rows, regime_trade_count_sum,
    gv as regime_trade_notional_sum, m_all as regime_trade_notional_median_all_rows, m_active as regime_trade_notional_median_active_rows, raw_trade_rows - silver_trade_rows as raw_silver_row_delta, silver_trade_rows - regime_trade_count_sum as silver_regime_trade_count_delta, coalesce(active / nullif(regime_rows, 0)::double, 0) as regime_trade_active_row_share,
    reason as activity_median_zero_reason, array_to_string(notes, ';') as diagnostic_notes"""
_LINEAGE_DOUBLES = "raw_trade_notional_sum silver_trade_notional_sum regime_trade_notional_sum regime_trade_notional_median_all_rows regime_trade_notional_median_active_rows regime_trade_active_row_share"


def _lineage_columns(x, by):
    return x.withColumn("diagnostic_notes", F.array_join("diagnostic_notes", ";")).drop("raw_silver_notional_delta_abs", "silver_regime_notional_delta_abs", "silver_invalid_event_ts_rows")


@query("lineage_by_symbol", f"select symbol, {_LINEAGE} from l_symbols", ["l_symbols"], _LINEAGE_DOUBLES)
def lineage_by_symbol(spark, sf_dir):
    """Raw lines, silver rows and bars of every symbol, with planted gaps, and what they mean."""
    return _lineage_columns(_lineage(spark, sf_dir, ["symbol"]), ["symbol"])


@query("lineage_by_date", f"select symbol, date, {_LINEAGE} from l_dates", ["l_dates"], _LINEAGE_DOUBLES)
def lineage_by_date(spark, sf_dir):
    """The same by symbol and date."""
    return _lineage_columns(_lineage(spark, sf_dir, ["symbol", "date"]), ["symbol", "date"])


@query("lineage_verdict", f"select case when count(*) = 0 then 'LINEAGE_AUDIT_NO_DATA_DIAGNOSTIC' when bool_or(list_has_any(notes, {au.LINEAGE_FAILURES})) then 'LINEAGE_AUDIT_FAIL_DIAGNOSTIC' else 'LINEAGE_AUDIT_PASS_DIAGNOSTIC' end as verdict from l_symbols", ["l_symbols"])
def lineage_verdict(spark, sf_dir):
    """The verdict."""
    return au.lineage_verdict(_lineage(spark, sf_dir, ["symbol"]))


_CELL = f"symbol, {_DAY} as date"
view("s_old", f"select {_CELL}, event_ts_ms, history_id, price, qty, direction from trades", ["trades"])
view(
    "s_new",
    f"""select {_CELL}, event_ts_ms, case when history_id % 89 = 0 then null else history_id end as history_id, price, case when history_id % 67 = 0 then qty + 1 else qty end as qty, direction from trades where history_id % 43 <> 0 and not (symbol = 'signup' and {_DAY} = (select max({_DAY}) from trades))
    union all select {_CELL}, event_ts_ms, history_id, price, qty, direction from trades where history_id % 71 = 0 and history_id % 43 <> 0 and not (symbol = 'signup' and {_DAY} = (select max({_DAY}) from trades))""",
    ["trades"],
)
_ALL = "symbol, date, event_ts_ms, history_id, price, qty, direction"
view(
    "side_cells",
    f"""select symbol, date, coalesce(old_rows, 0) as canonical_rows, coalesce(new_rows, 0) as candidate_rows, coalesce(miss, 0) = 0 and coalesce(extra, 0) = 0 as same, coalesce(miss, 0)::bigint as missing_rows, coalesce(extra, 0)::bigint as extra_rows, coalesce(nulls, 0) as key_nulls, coalesce(dup_keys, 0)::bigint as duplicate_keys, coalesce(dup_rows, 0)::bigint as duplicate_rows
    from (select symbol, date, count(*) as old_rows from s_old group by all) full join (select symbol, date, count(*) as new_rows, count(*) filter (history_id is null) as nulls from s_new group by all) using (symbol, date)
    left join (select symbol, date, sum(greatest(d, 0)) as miss, sum(greatest(-d, 0)) as extra from (select {_ALL}, sum(s) as d from (select *, 1 as s from s_old union all select *, -1 from s_new) group by all) group by all) using (symbol, date)
    left join (select symbol, date, sum(n - 1) as dup_keys from (select symbol, date, event_ts_ms, history_id, count(*) as n from s_new group by all) group by all) using (symbol, date)
    left join (select symbol, date, sum(n - 1) as dup_rows from (select {_ALL}, count(*) as n from s_new group by all) group by all) using (symbol, date)""",
    ["s_old", "s_new"],
)
view("side_failed", "select *, list_filter([case when candidate_rows = 0 and canonical_rows > 0 then 'coverage_missing' end, case when missing_rows > 0 then 'rows_missing' end, case when extra_rows > 0 then 'rows_extra' end, case when key_nulls > 0 then 'key_nulls' end, case when duplicate_keys > 0 then 'duplicate_keys' end, case when duplicate_rows > 0 then 'duplicate_rows' end], lambda x: x is not null) as failed from side_cells", ["side_cells"])


def _sides(spark, sf_dir):
    t, k = a.trades(spark, sf_dir), F.col("history_id")
    old = t.select("symbol", F.date_format(F.timestamp_millis("event_ts_ms"), "yyyy-MM-dd").alias("date"), "event_ts_ms", "history_id", "price", "qty", "direction", "recv_ms")
    newest = old.agg(F.max("date")).first()[0]
    kept = old.where((k % 43 != 0) & ~((F.col("symbol") == "signup") & (F.col("date") == newest)))
    new = kept.withColumns({"qty": F.when(k % 67 == 0, F.col("qty") + 1).otherwise(F.col("qty")), "history_id": F.when(k % 89 != 0, k)}).unionByName(kept.where(k % 71 == 0)).withColumn("recv_ms", F.col("recv_ms") + 1)
    return au.side_by_side(old, new, ["symbol", "date"], ["symbol", "event_ts_ms", "history_id"], ["recv_ms"])


@query("side_by_side", "select * exclude (failed), array_to_string(failed, ';') as failures from side_failed", ["side_failed"])
def side_by_side(spark, sf_dir):
    """A table against a candidate with lost, changed, repeated and keyless rows, and a lost day."""
    return _sides(spark, sf_dir).withColumn("failures", F.array_join("failures", ";"))


@query("side_by_side_verdict", "select symbol, count(*) as cells, count(*) filter (not same) as cells_differing, array_to_string(list_sort(list_distinct(flatten(list(failed)))), ';') as failures, case when max(len(failed)) = 0 then 'PASS' else 'FAIL' end as verdict from side_failed group by symbol", ["side_failed"])
def side_by_side_verdict(spark, sf_dir):
    """The verdict by symbol."""
    return au.side_by_side_verdict(_sides(spark, sf_dir), ["symbol"]).withColumn("failures", F.array_join("failures", ";"))


_G = list(au.GATES)
_GATE = {"sample_gate_pass": "n_obs >= 40", "liquidity_gate_pass": "u % 7 <> 1", "spread_cost_gate_pass": "u % 5 <> 2", "activity_gate_pass": "u % 11 <> 3", "stability_gate_pass": "u % 13 <> 4", "concentration_gate_pass": "u % 17 <> 5"}
_PREVIOUS = "case u % 6 when 0 then 'ELIGIBLE' when 1 then 'PROBATION' when 2 then 'RETIRED' when 3 then 'COLLECTED' end"
view("lc_now", f"select u, 'U' || u as symbol, n_obs, n_days, {', '.join(f'{s} as {g}' for g, s in _GATE.items())}, case when u % 29 = 0 then true else {' and '.join(f'({s})' for s in _GATE.values())} end as eligible from (select user_id as u, count(*) as n_obs, count(distinct event_ts_ms // 86400000) as n_days from ev group by user_id)", ["ev"])
view(
    "lc",
    f"""select coalesce(n.symbol, p.symbol) as symbol, coalesce(p.state, 'NEW') as previous_state, n.symbol is not null as here, b.good is null as none_, coalesce(not b.good, false) as bad, n.* exclude (symbol) from (select * from lc_now where u % 8 <> 7) n
    full join (select symbol, {_PREVIOUS} as state from lc_now where u % 6 < 4) p on n.symbol = p.symbol left join (select symbol, u % 19 <> 6 as good from lc_now where u % 23 <> 9) b on coalesce(n.symbol, p.symbol) = b.symbol""",
    ["lc_now"],
)
_ODD = f"(eligible and not ({' and '.join(_G)}))"
_PLAIN = f"case when eligible and {' and '.join(_G)} and not bad and not none_ then 'ELIGIBLE' when bad or none_ or {_ODD} or not liquidity_gate_pass or not activity_gate_pass or not stability_gate_pass or not concentration_gate_pass then 'DISABLED' when n_days >= 10 and n_obs >= 30 then 'RESEARCHABLE' else 'COLLECTED' end"


@query(
    "symbol_lifecycle",
    f"""select symbol, previous_state, lifecycle_state, previous_state || '->' || lifecycle_state as transition, case when previous_state = 'RETIRED' then 'retired_override' when not here then 'missing_current_eligibility' else array_to_string(list_concat(case when len(first_) = 0 then ['collected_only'] else first_ end, list_filter([case when none_ then 'missing_post_cost_baseline' end, case when {_ODD} then 'inconsistent_eligibility_snapshot' end, case when fell then 'demoted_from_eligible' end], lambda x: x is not null)), ';') end as reason_codes,
    lifecycle_state = 'ELIGIBLE' as paper_trading_allowed_diagnostic, case when previous_state = 'RETIRED' or not here then 0 else n_days end as n_days, case when previous_state = 'RETIRED' or not here then 0 else n_obs end as n_observations from (
    select *, case when previous_state = 'RETIRED' then 'RETIRED' when not here then 'DISABLED' when fell then 'PROBATION' else plain end as lifecycle_state, list_filter([case when eligible then 'eligible' end, {', '.join(f"case when not {g} then '{w}' end" for g, w in au.GATES.items())}, case when bad then 'bad_post_cost_baseline' end], lambda x: x is not null) as first_
    from (select *, previous_state in ('ELIGIBLE', 'PROBATION') and plain in ('RESEARCHABLE', 'COLLECTED') as fell from (select *, {_PLAIN} as plain from lc)))""",
    ["lc"],
)
def symbol_lifecycle(spark, sf_dir):
    """Users as symbols, with gates, a previous state and a baseline by rule."""
    e = a.events(spark, sf_dir).groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("n_observations"), F.count_distinct(F.expr("event_ts_ms div 86400000")).alias("n_days"))
    x = e.withColumn("symbol", F.concat(F.lit("U"), "u")).withColumns({g: F.expr(s.replace("n_obs", "n_observations")) for g, s in _GATE.items()})
    gates = F.lit(True)
    for g in _G:
        gates = gates & F.col(g)
    x = x.withColumn("eligible", (F.col("u") % 29 == 0) | gates)
    previous = x.where("u % 6 < 4").select("symbol", F.expr(_PREVIOUS).alias("lifecycle_state"))
    baseline = x.where("u % 23 <> 9").select("symbol", F.when(F.col("u") % 19 != 6, "yes").otherwise("no").alias("post_cost_baseline_pass"))
    return au.symbol_lifecycle(x.where("u % 8 <> 7"), previous, baseline, au.LifecycleConfig(10, 30))


_NOW, _BACK = 1_706_000_000_000, 7 * 86_400_000
_TIMES = {"first_seen_ms": "event_ts_ms", "uploaded_ms": "case when k % 2 = 0 then event_ts_ms + 60000 end", "pruned_ms": "case when k % 5 = 0 then event_ts_ms + 3600000 end"}
view("file_states", f"select event_type as status, case when k < 30 then 'e' || (k % 4) end as error, case when event_id % 19 <> 0 then k * 100 end as size_bytes, {', '.join(f'{v} as {n}' for n, v in _TIMES.items())} from ev", ["ev"])
_SUM = "count(*) as files, coalesce(sum(size_bytes), 0)::bigint as bytes"


@query(
    "archive_states",
    f"""select 'status' as report, status as name, null::varchar as error, {_SUM} from file_states group by status union all select 'with_errors', null, null, {_SUM} from file_states where error is not null
    union all select 'errors_by_status', status, null, {_SUM} from file_states where error is not null group by status union all select * from (select 'top_errors', status, error, {_SUM} from file_states where error is not null group by status, error order by count(*) desc, status, error limit 5)
    union all {' union all '.join(f"select 'recent', '{n}', null, {_SUM} from file_states where {n} >= {_NOW - _BACK}" for n in _TIMES)}""",
    ["file_states"],
)
def archive_states(spark, sf_dir):
    """States of files, errors, recent activity."""
    e = a.events(spark, sf_dir)
    k = F.col("k")
    files = e.select(F.col("event_type").alias("status"), F.when(k < 30, F.concat(F.lit("e"), k % 4)).alias("error"), F.when(F.col("event_id") % 19 != 0, k * 100).alias("size_bytes"), *[F.expr(v).alias(n) for n, v in _TIMES.items()])
    return ar.state_rollups(files, list(_TIMES), _NOW, _BACK, 5)


@query(
    "archive_inventory",
    f"""select channel, symbol, count(distinct file) as file_count, count(*) as row_count, max(event_ts_ms) as latest_event_ts_ms, max(recv_ms) as latest_recv_ms, ({_NOW} - max(recv_ms)) / 1000::double as latest_age_s from (
    select 'trades' as channel, symbol, event_ts_ms, recv_ms, symbol || event_ts_ms // 86400000 as file from trades union all select 'bbo', case when symbol = 'error' then 'UNKNOWN' else symbol end, event_ts_ms, recv_ms, symbol || event_ts_ms // 3600000 from bbo) group by channel, symbol""",
    ["trades", "bbo"],
    "latest_age_s",
)
def archive_inventory(spark, sf_dir):
    """Files, rows and latest times by channel and symbol."""
    side = lambda t, name, ms: t.select(F.lit(name).alias("channel"), "symbol", "event_ts_ms", "recv_ms", F.concat("symbol", F.expr(f"event_ts_ms div {ms}")).alias("file"))
    both = side(a.trades(spark, sf_dir), "trades", 86_400_000).unionByName(side(a.bbo(spark, sf_dir), "bbo", 3_600_000).withColumn("symbol", F.when(F.col("symbol") != "error", F.col("symbol"))))
    return ar.inventory_report(both, _NOW, "file")
