"""Audits, stores and economics on small tables with nulls, ties, repeats and planted faults."""

import math

import pytest
from pyspark.sql import functions as F

from marketflow.operators import audits as au
from marketflow.operators import economics as ec
from marketflow.operators import studies as s
from marketflow.sources import store

NOW = "symbol string, eligible string, " + ", ".join(f"{g} boolean" for g in au.GATES) + ", n_days int, n_observations int"


def symbol(name, eligible=True, n_days=20, n_observations=2000, **gates):
    return (name, str(eligible), *[gates.get(g.removesuffix("_gate_pass"), True) for g in au.GATES], n_days, n_observations)


def test_lifecycle_of_every_transition(spark):
    now = spark.createDataFrame([
        symbol("good"), symbol("thin", False, liquidity=False), symbol("young", False, sample=False, n_days=3), symbol("study", False, sample=False), symbol("was", False, spread_cost=False),
        symbol("on", False, sample=False, n_days=1), symbol("bad"), symbol("odd", True, concentration=False), symbol("lost"), symbol("old"), symbol("plain", False), symbol("none"),
    ], NOW)
    before = spark.createDataFrame([("was", "ELIGIBLE"), ("on", "PROBATION"), ("old", "RETIRED"), ("gone", "ELIGIBLE"), ("dead", "RETIRED"), ("thin", "ELIGIBLE")], "symbol string, lifecycle_state string")
    base = spark.createDataFrame([(n, n != "bad") for n in ("good", "thin", "young", "study", "was", "on", "bad", "odd", "old", "plain", "none")], "symbol string, post_cost_baseline_pass boolean")
    got = {r.symbol: (r.transition, r.reason_codes) for r in au.symbol_lifecycle(now, before, base).collect()}
    assert got == {
        "good": ("NEW->ELIGIBLE", "eligible"), "none": ("NEW->ELIGIBLE", "eligible"), "thin": ("ELIGIBLE->DISABLED", "depth_too_thin"), "young": ("NEW->COLLECTED", "insufficient_days"), "study": ("NEW->RESEARCHABLE", "insufficient_days"),
        "was": ("ELIGIBLE->PROBATION", "spread_too_wide;demoted_from_eligible"), "on": ("PROBATION->PROBATION", "insufficient_days;demoted_from_eligible"), "bad": ("NEW->DISABLED", "eligible;bad_post_cost_baseline"),
        "odd": ("NEW->DISABLED", "eligible;too_concentrated;inconsistent_eligibility_snapshot"), "lost": ("NEW->DISABLED", "eligible;missing_post_cost_baseline"), "old": ("RETIRED->RETIRED", "retired_override"),
        "dead": ("RETIRED->RETIRED", "retired_override"), "gone": ("ELIGIBLE->DISABLED", "missing_current_eligibility"), "plain": ("NEW->RESEARCHABLE", "collected_only"),
    }
    alone = {r.symbol: r.lifecycle_state for r in au.symbol_lifecycle(now).collect()}
    assert alone["lost"] == alone["bad"] == "ELIGIBLE" and "gone" not in alone


@pytest.mark.parametrize("rows,before", [([symbol("a", "maybe")], []), ([symbol("a"), symbol("a")], []), ([symbol(" ")], []), ([symbol("a")], [("a", "SLEEPING")])])
def test_lifecycle_ends_on_unsound_input(spark, rows, before):
    with pytest.raises(Exception, match="eligibility|lifecycle"):
        au.symbol_lifecycle(spark.createDataFrame(rows, NOW), spark.createDataFrame(before, "symbol string, lifecycle_state string")).collect()


def test_side_by_side_counts_what_differs(spark):
    schema = "day int, k long, v double, src string"
    old = [(1, 1, 1.0, "a"), (1, 2, None, "a"), (1, 2, None, "b"), (2, 3, 3.0, "a"), (3, 4, 4.0, "a"), (None, 5, 5.0, "a"), (5, 8, 1.0, "a"), (5, 9, 2.0, "a")]
    new = [(1, 1, 1.0, "x"), (1, 2, None, "y"), (1, 2, None, "z"), (2, 3, 3.5, "a"), (None, None, 5.0, "a"), (4, 6, 6.0, "a"), (4, 6, 7.0, "a"), (5, 8, 2.0, "a"), (5, 9, 1.0, "a")]
    cells = au.side_by_side(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["day"], ["day", "k"], ["src"])
    got = {r.day: tuple(r)[1:-1] + (";".join(r.failures),) for r in cells.collect()}
    assert got == {
        1: (3, 3, True, 0, 0, 0, 1, 1, "duplicate_keys;duplicate_rows"), 2: (1, 1, False, 1, 1, 0, 0, 0, "rows_missing;rows_extra"), 3: (1, 0, False, 1, 0, 0, 0, 0, "coverage_missing;rows_missing"),
        None: (1, 1, False, 1, 1, 1, 0, 0, "rows_missing;rows_extra;key_nulls"), 4: (0, 2, False, 0, 2, 0, 1, 0, "rows_extra;duplicate_keys"), 5: (2, 2, False, 2, 2, 0, 0, 0, "rows_missing;rows_extra"),
    }
    same = au.side_by_side(spark.createDataFrame(old[3:5], schema), spark.createDataFrame(old[3:5], schema), ["day"], ["day", "k"])
    assert {r.verdict for r in au.side_by_side_verdict(same, ["day"]).collect()} == {"PASS"}
    with pytest.raises(ValueError, match="columns"):
        au.side_by_side(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema).drop("v"), ["day"], ["k"])


def test_lineage_notes(spark):
    schema = "symbol string, date string, event_ts_ms long, notional double"
    raw = [("a", "d", 1, 5.0), ("a", "d", 2, 5.0), ("b", "d", 1, 1.0), ("c", "d", None, 1.0), ("e", "d", 1, 100.0)]
    silver = [("a", "d", 1, 5.0), ("a", "d", 2, 5.0), ("d", "d", 1, 1.0), ("e", "d", 1, 100.0 + 1e-8)]
    bars = [("a", "d", 2, 10.0), ("a", "d", None, None), ("a", "d", 0, 0.0), ("d", "d", 2, 1.0), ("e", "d", 1, 100.0)]
    x = au.lineage(
        au.trade_lineage(spark.createDataFrame(raw, schema), ["symbol"], "raw", 60_000), au.trade_lineage(spark.createDataFrame(silver, schema), ["symbol"], "silver", 60_000),
        au.regime_lineage(spark.createDataFrame(bars, "symbol string, date string, trade_count long, trade_notional double"), ["symbol"]), ["symbol"],
    )
    got = {r.symbol: (r.activity_median_zero_reason, list(r.diagnostic_notes)) for r in x.collect()}
    assert got == {
        "a": ("sparse_trade_minutes_not_missing_trade_lineage", ["median_zero_explained_by_sparse_trade_minutes"]),
        "b": ("no_silver_trades", ["raw_silver_trade_row_mismatch", "raw_silver_notional_mismatch"]),
        "c": ("no_silver_trades", ["raw_invalid_event_ts_rows"]),
        "d": ("median_nonzero", ["raw_silver_trade_row_mismatch", "raw_silver_notional_mismatch", "silver_regime_trade_count_mismatch", "silver_trades_without_local_raw_sample"]),
        "e": ("median_nonzero", []),
    }
    assert au.lineage_verdict(x).first()[0] == "LINEAGE_AUDIT_FAIL_DIAGNOSTIC" and au.lineage_verdict(x.where("symbol in ('a', 'e')")).first()[0] == "LINEAGE_AUDIT_PASS_DIAGNOSTIC"
    assert au.lineage_verdict(x.where("false")).first()[0] == "LINEAGE_AUDIT_NO_DATA_DIAGNOSTIC"


LEVELS = "symbol string, session int, ts_ms long, snap_id long, bids array<struct<price: double, qty: double>>, asks array<struct<price: double, qty: double>>"


def test_anchors_and_touches_from_one_exchange_of_the_book(spark):
    events = spark.createDataFrame([("a", 1, 10 * k, 100.0 + k) for k in range(8)], "symbol string, session int, ts_ms long, vwap double")
    snap = lambda t, i, bid, ask: ("a", 1, t, i, [(bid, 5.0)] if bid else [], [(ask, 5.0), (ask + 1, 50.0)] if ask else [])
    book = spark.createDataFrame([snap(5, 1, 99.0, 101.0), snap(20, 2, 98.0, 102.0), snap(20, 3, 99.5, 100.5), snap(45, 4, 90.0, 91.0), snap(61, 5, None, 200.0)], LEVELS)
    rows = ec.maker_rows(events, book, 3, 2, [2, 4], [100.0, 1.0])
    got = {(r.window_start, r.horizon, r.offset_bps): r for r in rows.collect()}
    # anchors at 20, 40, 60; the book before them is snapshot 3, 3 and 4
    assert {(k[0], v.anchor_ts, v.anchor_mid) for k, v in got.items()} == {(0, 20, 100.0), (2, 40, 100.0)} and {k[:2] for k in got} == {(0, 2), (0, 4), (2, 2)}
    assert not got[0, 2, 100.0].bid_filled and got[0, 4, 100.0].bid_filled and got[2, 2, 100.0].bid_filled and not got[0, 2, 1.0].ask_filled
    r = got[0, 4, 100.0]
    assert abs(r.bid_price - 99.0) < 1e-9 and abs(r.realized_bid_pnl_bps - (100.0 * 106 / 102 - 99) / 99 * 1e4) < 1e-6 and r.realized_ask_pnl_bps is None
    taken = {(r.window_start, r.size_usd, r.horizon): r for r in ec.taker_rows(events, book, 3, 2, [2], [300.0, 1e6], 4.0).collect()}
    assert taken[0, 300.0, 2].fillable and not taken[0, 1e6, 2].fillable and taken[0, 1e6, 2].headroom_bps is None
    assert abs(taken[0, 300.0, 2].edge_bps - math.log(104 / 102) * 1e4) < 1e-9 and taken[4, 300.0, 2].edge_bps is None
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning(symbol") == 1  # events and book together, once
    cells = ec.adverse_cells(rows, ["symbol"], 1.5).collect()[0]
    filled = [v for r in got.values() for v in (r.realized_bid_pnl_bps, r.realized_ask_pnl_bps) if v is not None]
    assert cells.n_windows == 6 and abs(cells.mean_pnl_either_filled - sum(filled) / len(filled)) < 1e-9


def test_spring_takes_the_first_of_equal_least_returns(spark):
    rows = [("a", 1, t, -1.0 if t in (3, 9) else 0.05, 2.0 if t == 3 else 0.0, 1.0) for t in range(60)]
    x = spark.createDataFrame(rows, "symbol string, session int, ts_ms long, log_return double, effort_vs_result double, is_open double")
    got = {r.ts_ms: r for r in ec.spring_argmin(x, 3.0).collect()}
    assert got[49].min_return is None and not got[49].spring
    assert (got[53].min_return, got[53].evr_at_min, got[53].spring) == (-1.0, 2.0, True) and (got[54].evr_at_min, got[54].spring) == (0.0, False)
    rates = ec.spring_rates(ec.spring_argmin(x, 3.0), ["symbol"]).collect()[0]
    assert rates.windows == 10 and rates.fires == 4


def test_ledger_forgets_the_cost_of_a_position_that_rounding_leaves_open(spark):
    rows = [(1, "buy", 10.0, 0.1), (2, "buy", 20.0, 0.2), (3, "sell", 30.0, 0.3), (4, "buy", 50.0, 1.0)]
    fills = spark.createDataFrame([("a", t, t, side, p, q, "maker", 0.0) for t, side, p, q in rows], "symbol string, ts_ms long, fill_id long, side string, price double, quantity double, liquidity string, funding_payment double")
    got = {r.fill_id: r for r in s.paper_ledger(fills).collect()}
    assert got[3].position_after_fill == 0.0 and got[3].average_cost == 0.0 and got[4].average_cost == 50.0


def test_partitions_of_a_delta_replace_only_themselves(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5, 1.0), ("a", 2, 6, 2.0), ("b", 1, 7, None)], "symbol string, session int, ts_ms long, v double")
    store.write_event_features(rows, str(tmp_path))
    out = store.write_event_features(spark.createDataFrame([("a", 2, 9, 9.0)], rows.schema), str(tmp_path))
    assert sorted((r.symbol, r.session, r.ts_ms, r.v) for r in out.collect() if r.v) == [("a", 1, 5, 1.0), ("a", 2, 9, 9.0)] and out.count() == 3
    assert out.columns == rows.columns and "PartitionFilters: [isnotnull(symbol" in out.where(F.col("symbol") == "a")._jdf.queryExecution().executedPlan().toString()


def test_adverse_cells_work_their_rows_out_once(spark):
    rows = spark.createDataFrame([("a", True, False, 1.0, None), ("a", True, True, 3.0, -2.0), ("a", False, False, None, None)], "symbol string, bid_filled boolean, ask_filled boolean, realized_bid_pnl_bps double, realized_ask_pnl_bps double")
    x = ec.adverse_cells(rows, ["symbol"], 1.0)
    r = x.collect()[0]
    assert (r.n_windows, r.fill_rate_bid, r.fill_rate_ask, r.fill_rate_either) == (3, 2 / 3, 1 / 3, 2 / 3)
    assert (r.mean_pnl_bid_filled, r.median_pnl_bid_filled, r.q25_pnl_bid_filled, r.q75_pnl_bid_filled) == (2.0, 2.0, 1.5, 2.5)
    assert (r.mean_pnl_ask_filled, r.median_pnl_ask_filled, r.q25_pnl_ask_filled, r.median_pnl_either_filled) == (-2.0, -2.0, -2.0, 1.0)
    assert x._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_levels_are_fetched_by_anchors_only(spark):
    events = spark.createDataFrame([("a", 1, t, 10.0) for t in range(0, 60, 2)], "symbol string, session int, ts_ms long, vwap double")
    side = lambda p: [{"price": p, "qty": 50.0}]
    book = spark.createDataFrame([("a", 1, t, 10 * t + i, side(9.0 + i), side(11.0 + i)) for t in range(0, 60, 3) for i in (0, 1)], "symbol string, session int, ts_ms long, snap_id long, bids array<struct<price: double, qty: double>>, asks array<struct<price: double, qty: double>>")
    x = ec.anchored(events, book, 3, 2, [4], depth=True)
    assert {(r.bids[0].price, r.asks[0].price, r.anchor_mid) for r in x.collect()} == {(10.0, 12.0, 11.0)}
    assert "last_snap_id" in x._jdf.queryExecution().optimizedPlan().toString()


def test_impacts_of_trades_go_without_joins(spark):
    from marketflow import registry
    from marketflow.plans import feature_queries  # noqa: F401

    plan = registry.QUERIES["kyle_lambda_trade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # of orders and lines
