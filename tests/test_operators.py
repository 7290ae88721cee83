"""Operators on literal rows."""

import gzip
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketflow.functions.quantiles import group_quantiles
from marketflow.functions.ranks import mean_rank_share
from marketflow.functions.running import places, running
from marketflow.operators import asof
from marketflow.operators import evaluation as ev
from marketflow.operators import event_features as ef
from marketflow.operators import folds as fo
from marketflow.operators import order_events as o
from marketflow.operators import regime as r
from marketflow.operators import session_kernel as kernel
from marketflow.operators import studies as s
from marketflow.operators import validation as va
from marketflow.operators import window_studies as ws
from marketflow.sources import manifests as m
from marketflow.sources import raw
from marketflow.streaming.asof import stream_asof
from marketflow.streaming import bars
from marketflow.streaming.asof import stream_asof
from marketflow.streaming.replay import accepted, replay


def test_asof_takes_the_last_at_or_before_and_the_first_at_or_after(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 1), ("b", 7)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 5, 2, 2.0), ("a", 8, 3, 3.0)], "k string, q long, id long, v double")
    back = {(x.k, x.t): x.v for x in asof.asof(left, right, ["k"], "t", "q", ["v"], "id").collect()}
    assert back == {("a", 5): 2.0, ("a", 10): 3.0, ("a", 1): None, ("b", 7): None}
    ahead = {(x.k, x.t): x.v for x in asof.asof(left, right, ["k"], "t", "q", ["v"], "id", forward=True).collect()}
    assert ahead == {("a", 5): 1.0, ("a", 10): None, ("a", 1): 1.0, ("b", 7): None}


def test_interval_join_includes_both_bounds(spark):
    points = spark.createDataFrame([(0,), (10,), (25,), (26,)], "t long")
    spans = spark.createDataFrame([("x", 10, 25), ("y", 25, 25)], "n string, a long, b long")
    assert sorted((x.t, x.n) for x in asof.interval_join(points, spans, "t", "a", "b", 7).collect()) == [(10, "x"), (25, "x"), (25, "y")]


def test_mean_rank_share_shares_ties_and_zeroes_constants(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 2.0), (3, 9.0, 2.0), (4, 1.0, 2.0)], "id int, m double, c double")
    got = {x.id: (x.r, x.q) for x in mean_rank_share(mean_rank_share(df, ["id"], ["m"], "r"), ["id"], ["m", "c"], "q").collect()}
    assert got == {1: (2.5 / 4, 2.5 / 8), 2: (2.5 / 4, 2.5 / 8), 3: (1.0, 0.5), 4: (0.25, 0.125)}


def test_governor_fails_closed_on_null(spark):
    cols = "symbol string, bbo_updates double, trade_count double, trade_notional double, price_updates double, avg_spread_bps double, top_depth_notional double, toxicity_score double, mark_oracle_basis_abs_bps double"
    good = ("a", 5.0, 5.0, 5.0, 5.0, 1.0, 5000.0, 0.1, 1.0)
    rows = [good] + [good[:i] + (None,) + good[i + 1 :] for i in range(1, 9)]
    got = [x.governor_decision for x in r.governor(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["TRADABLE_DIAGNOSTIC"] + ["SKIP_STALE_DATA"] * 4 + ["SKIP_WIDE_SPREAD", "SKIP_LOW_DEPTH", "SKIP_TOXIC_REGIME", "SKIP_MARK_ORACLE_DISLOCATION"]
    with pytest.raises(ValueError):
        r.GovernorThresholds(max_spread_bps=0)


def test_bucket_sizes():
    assert [r.bucket_ms(x) for x in ("500ms", "30s", "1m", "5min")] == [500, 30_000, 60_000, 300_000]
    with pytest.raises(ValueError):
        r.bucket_ms("soon")


def test_bursts_split_only_above_the_gap(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, 1.0, 1), ("a", 10, 2.0, 1.0, 2), ("a", 21, 3.0, 1.0, 3), ("b", 0, 1.0, 1.0, 4)], "symbol string, ts_ms long, price double, qty double, tie long")
    got = o.bursts(rows, 10).collect()
    assert [(x.symbol, x.start_ms, x.end_ms, x.n_trades, x.direction) for x in got] == [("a", 0, 10, 2, 1)]


def test_sweep_cost_walks_the_levels(spark):
    df = spark.createDataFrame([([(10.0, 1.0), (11.0, 1.0)],)], "asks array<struct<price: double, qty: double>>")
    part, whole, over = (df.select(o.sweep_cost(F.col("asks"), size, F.lit(10.0), 1).alias("s")).first().s for size in (5, 21, 22))
    assert (part.fillable, part.avg_price, part.slip_bps) == (True, 10.0, 0.0)
    assert whole.fillable and whole.avg_price == pytest.approx(10.5) and not over.fillable and over.avg_price is None


FILL = "symbol string, ts_ms long, fill_id long, side string, price double, quantity double, liquidity string, funding_payment double"


def test_ledger_keeps_average_cost_and_goes_below_zero(spark):
    rows = [("a", 1, 1, "buy", 10.0, 2.0), ("a", 2, 2, "buy", 20.0, 2.0), ("a", 3, 3, "sell", 30.0, 1.0), ("a", 4, 4, "sell", 30.0, 9.0), ("a", 5, 5, "buy", 8.0, 10.0), ("a", 6, 6, "funding", 1.0, 1.0)]
    fills = spark.createDataFrame([(*x, "maker" if x[1] % 2 else "taker", 0.25) for x in rows], FILL)
    ledger = s.paper_ledger(fills, 100.0, maker_bps=0.0, taker_bps=10.0).cache()
    got = sorted((x.fill_id, x.position_after_fill, x.average_cost, x.realized_pnl_on_fill) for x in ledger.collect())
    assert got == [(1, 2.0, 10.0, 0.0), (2, 4.0, 15.0, 0.0), (3, 3.0, 15.0, 15.0), (4, -6.0, 0.0, 45.0), (5, 4.0, 20.0, 0.0), (6, 4.0, 20.0, 0.0)]
    total = s.ledger_summary(ledger, 100.0).first()
    fees = 20 * 2 / 1000 + 30 * 9 / 1000
    assert (total.realized_pnl, total.funding_paid, total.fills) == (60.0, 0.25, 6) and total.ending_equity == pytest.approx(159.75 - fees)
    assert total.max_drawdown == pytest.approx(-0.25)
    with pytest.raises(Exception, match="price must be positive"):
        s.paper_ledger(spark.createDataFrame([("a", 1, 1, "buy", 0.0, 2.0, "maker", 0.0)], FILL)).collect()


def test_round_trips_charge_both_sides(spark):
    cols = "side string, entry_liquidity string, exit_liquidity string, entry_price double, exit_price double, quantity double, hold_hours long, slippage_bps_per_side double, adverse_selection_bps_per_side double"
    rows = [("long", "taker", "taker", 100.0, 101.0, 2.0, 10, 1.0, 0.5), ("short", "maker", "taker", 100.0, 101.0, 2.0, 10, None, None)]
    a, b = s.round_trip_costs(spark.createDataFrame(rows, cols), funding_bps_per_hour=0.1).collect()
    assert (a.gross_pnl, a.fees_paid, a.slippage_paid, a.adverse_selection_paid, a.funding_paid) == (2.0, 0.16, 0.04, 0.02, 0.02)
    assert (b.gross_pnl, b.fee_bps_total, b.slippage_paid, b.funding_paid) == (-2.0, 5.5, 0.0, -0.02) and a.net_pnl == pytest.approx(1.76)


def test_running_values_cross_cells(spark):
    rows = spark.createDataFrame([("a", d, i, v) for i, (d, v) in enumerate([(0, 5.0), (0, -9.0), (1, 2.0), (2, None), (2, 4.0)])], "k string, day int, i int, v double")
    got = running(rows, ["k"], "day", ["i"], {"total": (F.col("v"), "sum"), "top": (F.col("v"), "max")}).orderBy("i").collect()
    assert [(x.total, x.top) for x in got] == [(5.0, 5.0), (-4.0, 5.0), (-2.0, 5.0), (-2.0, 5.0), (2.0, 5.0)]


def test_effort_stands_against_the_usual_return_and_starts_at_zero(spark):
    rows = [("a", 1, t, q, v, 1.0, 1, 0.5, 0.1, 10.0) for t, q, v in [(1, 2.0, 10.0), (3, 2.0, 10.1), (7, 4.0, 10.0), (8, 2.0, 10.1)]]
    x = spark.createDataFrame(rows, "symbol string, session int, ts_ms long, total_qty double, vwap double, is_open_frac double, n_fills long, book_walk_abs double, spread double, mid double")
    got = o.trade_features(x, width=1000, span=2).orderBy("ts_ms").collect()
    move = math.log(10.1 / 10.0)
    assert [r.effort_vs_result for r in got][:2] == [0.0, pytest.approx(-math.log(move / (move / 2) + 1e-6))]
    assert [r.log_total_qty for r in got] == pytest.approx([0.0, 0.0, math.log(2), 0.0]) and got[0].book_walk == pytest.approx(5.0)
    assert [r.time_delta for r in got] == pytest.approx([0.0, math.log(3), math.log(5), math.log(2)])
    assert [r.prev_seq_time_span for r in got] == pytest.approx([0.0, 0.0, math.log(3), math.log(5)])


def test_order_flow_signs_and_first_kyle_row(spark):
    flat = {f"{side}{i}_{what}": 0.0 for side in ("bid", "ask") for i in range(1, 11) for what in ("price", "qty")}
    rows = [{**flat, "symbol": "a", "session": 1, "ts_ms": t, "snap_id": t, "bid1_price": b, "bid1_qty": bq, "ask1_price": k, "ask1_qty": kq} for t, b, bq, k, kq in [(1, 10.0, 1.0, 11.0, 1.0), (2, 10.5, 2.0, 11.0, 3.0), (3, 10.0, 1.0, 11.5, 1.0), (4, 10.0, 4.0, 11.0, 2.0)]]
    got = o.order_flow(spark.createDataFrame(rows)).orderBy("ts_ms").collect()
    assert [x.ofi for x in got] == pytest.approx([0.0, 21.0 - 22.0, -21.0 - 33.0, 30.0 + 22.0])
    assert got[1].cum_ofi_5 == pytest.approx(-1.0 / (21.0 + 21.0 + 33.0))
    walk = spark.createDataFrame([("a", 1, t, float(t * t), float(t % 3)) for t in range(4)], "symbol string, session int, ts_ms long, mid double, flow double")
    slope = [x.kyle_lambda for x in o.kyle_lambda(walk, "mid", "flow", ["ts_ms"], 3).orderBy("ts_ms").collect()]
    assert slope[:2] == [0.0, 0.0] and slope[2] == pytest.approx(1.5)


def test_raw_scan_skips_blanks_and_reads_broken_gzip(spark, tmp_path):
    day = tmp_path / "channel=trades/symbol=BTC/date=2026-01-01"
    day.mkdir(parents=True)
    line = '{"recv_ms": 5, "event_ts_ms": 0, "channel": "trades", "symbol": "BTC", "data": "{\\"s\\":\\"BTC\\",\\"a\\":\\"2\\",\\"p\\":\\"1.5\\",\\"d\\":\\"close_short\\",\\"t\\":\\"7\\",\\"h\\":\\"1.9\\"}"}\n'
    (day / "a.jsonl.gz").write_bytes(gzip.compress((line + "\n  \n" + line.replace('1.5', 'x')).encode()))
    (day / "b.jsonl.gz").write_bytes(gzip.compress((line * 2000).encode())[:-20])
    got = raw.normalize_trades(raw.scan_raw(spark, str(tmp_path), ["trades"]))
    first = got.where("price is null").collect()
    assert len(first) == 1 and first[0].notional is None
    good = got.where("price is not null").first()
    assert (good.event_ts_ms, good.price, good.signed_qty, good.history_id) == (7, 1.5, 2.0, 1)


def test_dedup_ignores_the_side(spark):
    rows = [("a", 1, 10, 2.0, 5.0, "open_long", 1, 7, 11), ("a", 1, 10, 2.0, 5.0, "close_long", 1, 7, 12), ("a", 1, 10, 3.0, 5.0, "open_long", 1, 7, 11)]
    fills = spark.createDataFrame(rows, "symbol string, session int, ts_ms long, qty double, price double, side string, l_linenumber int, order_id long, recv_ms long")
    kept = o.dedup_counterparty(fills)
    assert sorted((x.qty, x.side) for x in kept.collect()) == [(2.0, "open_long"), (3.0, "open_long")]
    event = o.order_events(kept).first()
    assert (event.total_qty, event.vwap, event.n_fills, event.is_open_frac) == (5.0, 5.0, 2, 1.0)


def test_group_quantiles_interpolate_and_leave_out_nulls(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 9)] + [("b", None), ("b", 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: (x.low, x.mid) for x in group_quantiles(df, ["k"], {"low": (F.col("v"), 0.25), "mid": (F.col("v"), 0.5)}, bins=3).collect()}
    assert got == {"a": (1.0, 3.0), "b": (2.0, 2.0)}


def test_bools_times_and_listings(spark):
    df = spark.createDataFrame([(" Yes",), ("0",), (None,), ("maybe",)], "v string")
    assert [x[0] for x in df.select(m.parse_bool(F.col("v"))).collect()] == [True, False, False, None]
    times = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("2026-01-02",), ("soon",)], "v string")
    assert [str(x[0]) for x in times.select(m.parse_time(F.col("v"))).collect()] == ["2026-01-02 03:04:05", "2026-01-02 00:00:00", "None"]
    lines = spark.createDataFrame([("a/;0;x",), ("a/b.gz;7;2026-01-02",), (" ",)], "value string")
    assert [(x.key, x.size_bytes) for x in m.parse_listing(lines, "p/").collect()] == [("p/a/b.gz", 7)]
    with pytest.raises(Exception, match="malformed line"):
        m.parse_listing(spark.createDataFrame([("a;1",)], "value string")).collect()


def test_guards_raise(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3), ("a", 9)], "symbol string, session int")
    assert ef.holdout_guard(rows, 10).count() == 2 and ef.holdout_guard(rows, 9, consume=True).count() == 2
    with pytest.raises(Exception, match="held out"):
        ef.holdout_guard(rows, 9).collect()
    with pytest.raises(ValueError):
        ef.filter_taker(rows)
    with pytest.raises(ValueError):
        m.write_incremental(rows, rows, "/x/", ["symbol"], "/x")
    with pytest.raises(ValueError, match="missing"):
        m.required_columns(rows, ["symbol", "price"])
    costs = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "symbol string, cost double")
    with pytest.raises(Exception, match="unique"):
        ws.attach_cost(rows, costs, ["symbol"]).collect()


def test_folds_keep_the_embargo_and_short_keys_give_none(spark):
    n = spark.createDataFrame([("a", 100), ("b", 30)], "k string, n long")
    got = sorted((x.fold, x.role, x.first, x.last) for x in fo.walk_forward_folds(n, ["k"], 2, 10, 40, 20).collect())
    assert got == [(0, "test", 50, 74), (0, "train", 0, 39), (1, "test", 75, 99), (1, "train", 0, 64)]
    days = spark.createDataFrame([(d,) for d in range(7)], "day int")
    assert [x.fold for x in fo.day_folds(days, "day", 3).orderBy("day").collect()] == [0, 0, 0, 1, 1, 2, 2]


def test_touch_counts_both_ends_of_the_horizon(spark):
    anchors = spark.createDataFrame([("a", 10, 1.0, 9.0), ("a", 30, 1.0, 9.0)], "k string, ts_ms long, bid_limit double, ask_limit double")
    quotes = spark.createDataFrame([("a", 9, 9.5, 0.5), ("a", 20, 3.0, 1.0), ("a", 41, 9.5, 0.5)], "k string, ts_ms long, best_bid double, best_ask double")
    got = {x.ts_ms: (x.bid_filled, x.ask_filled) for x in ws.touched(anchors, quotes, ["k"], 10).collect()}
    assert got == {10: (True, False), 30: (False, False)}


def test_messages_with_keys_that_differ_by_case(spark):
    data = '{"s":"X","b":"1.0","B":"2","a":"3.0","A":"4","i":5,"li":6,"t":7}'.replace('"', '\\"')
    lines = spark.createDataFrame([(f'{{"recv_ms":1,"event_ts_ms":7,"channel":"bbo","symbol":"X","data":"{data}"}}',)], "value string")
    row = raw.normalize_bbo(lines).first()
    assert (row.bid_px, row.bid_qty, row.ask_px, row.ask_qty, row.mid, row.order_id) == (1.0, 2.0, 3.0, 4.0, 2.0, 5)
    schema = m.describe_schema(lines).first()
    assert (schema.position, schema.name, schema.type) == (0, "value", "string")


def test_what_is_null_adds_no_stress(spark):
    df = spark.createDataFrame([(100, 50.0, None, None), (900, None, -2000.0, 10.0)], "t long, s double, c double, b double")
    got = [x[0] for x in df.select(ev.stress_score(F.col("t"), F.col("s"), F.col("c"), F.col("b"))).collect()]
    assert got == pytest.approx([1.5, 7.1])


def test_stream_asof_over_restarts_with_late_rows_and_ties(spark, tmp_path):
    e = [("a", 10_000, 1, 0), ("a", 25_000, 2, 0), ("a", 70_000, 3, 1), ("a", 200_000, 4, 2), ("b", 5_000, 5, 0), ("a", 20_000, 6, 1), ("a", 1_000, 7, 2), ("a", 90_000, 2**53 + 1, 1)]
    q = [("a", 9_000, 1, 1.0, 0), ("a", 25_000, 2, 2.0, 0), ("a", 25_000, 3, 3.0, 1), ("a", 60_000, 4, None, 1), ("a", 195_000, 5, 5.0, 2), ("a", 69_000, 6, 6.0, 2), ("c", 1, 7, 7.0, 0), ("a", 300_000, 8, 8.0, 2)]
    events = spark.createDataFrame(e, "symbol string, t long, id long, __slice int")
    quotes = spark.createDataFrame(q, "symbol string, t long, tie long, mid double, __slice int")
    out = replay({"e": events, "q": quotes}, str(tmp_path), lambda x: stream_asof(x["e"], x["q"], ["symbol"], "t", ["mid"], "tie", "30 seconds"))
    got = {(r.symbol, r.t, r.id): (r.asof_time, r.mid) for r in out.collect()}
    # the first run's newest time is 25 s, the second's 90 s: the mark stands at 60 s when the third starts, and at 270 s in the end
    assert got == {
        ("a", 10_000, 1): (9_000, 1.0), ("a", 20_000, 6): (9_000, 1.0), ("a", 25_000, 2): (25_000, 3.0), ("b", 5_000, 5): (None, None),
        ("a", 70_000, 3): (69_000, 6.0), ("a", 90_000, 2**53 + 1): (69_000, 6.0), ("a", 200_000, 4): (195_000, 5.0),
    }


def test_accepted_drops_what_the_mark_has_passed(spark):
    rows = spark.createDataFrame([(100, 0), (50, 1), (95, 1), (200, 1), (150, 2), (195, 2)], "t long, __slice int")
    assert sorted(r.t for r in accepted(rows, rows, "t", 10).collect()) == [95, 100, 195, 200]
    assert accepted(rows.where("false"), rows.where("false"), "t", 10).count() == 0


def test_forward_asof_reads_no_frame_anew_for_every_row(spark):
    left = spark.createDataFrame([("a", t) for t in range(0, 40, 3)], "k string, t long")
    right = spark.createDataFrame([("a", q, q * 10 + n, n) for q in range(0, 30, 4) for n in (2, 1)], "k string, q long, v long, id long")
    found = asof.asof(left, right, ["k"], "t", "q", ["v"], "id", forward=True)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {(x.t, x.v) for x in found.collect()} == {(t, -(-t // 4) * 40 + 1 if t <= 28 else None) for t in range(0, 40, 3)}


def test_event_features_do_not_hang_on_the_length_of_spans(spark, monkeypatch):
    from marketflow.plans.feature_queries import ERA, HOLDOUT
    from marketflow.sources import adapters as a

    monkeypatch.setattr(o, "WIDTH", 60)
    monkeypatch.setattr(o, "HORIZONS", [10, 50])
    book, fills = (f(spark, "/root/testdata/sf0.01").where("symbol = 'P3' and session between 1995 and 1997").cache() for f in (a.book, a.fills))
    whole, cut = ({(r.symbol, r.session, r.ts_ms): tuple(r)[3:] for r in ef.event_features(fills, book, ERA, HOLDOUT, size=n).collect()} for n in (20_000, 250))
    assert len(whole) > 2000 and whole.keys() == cut.keys()
    names = [*ef.FEATURES, *[f"dir_h{h}" for h in o.HORIZONS], *ef.LABELS]
    differ = {n: sum((x[i] is None) != (cut[k][i] is None) or x[i] is not None and abs(x[i] - cut[k][i]) > 1e-6 for k, x in whole.items()) for i, n in enumerate(names)}
    assert not {n: c for n, c in differ.items() if c}
    flat = [o.flat_features(ef.event_features(fills, book, ERA, HOLDOUT), ["log_return"], 200, 50, size=n).collect() for n in (400, 3)]
    assert len(flat[0]) > 20 and sorted(flat[0]) == sorted(flat[1])


def test_quintile_edges_are_rounded_once(spark):
    """An edge between 1.8516216216216215 and the next double falls onto the former, so the latter lies above it."""
    values = [0.5272972972972974, 0.5891891891891892, 0.6772972972972973, 1.1032432432432433, 1.6202702702702703, 1.6362162162162162, 1.7143243243243242, 1.8056756756756756, 1.8164864864864865, 1.8516216216216215, 1.8516216216216217, 1.8745945945945945]
    values += [1.905945945945946, 1.9508108108108106, 2.024054054054054, 2.154864864864865, 2.6672972972972975, 2.9783783783783786, 3.0081081081081082, 3.2105405405405403, 3.3802702702702705, 3.6567567567567565, 3.9481081081081077, 4.294594594594595]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double")
    got = {(r.k, r.v): r.quintile for r in ev.quintiles(df, ["k"], "v").collect()}
    assert [got["a", v] for v in values] == [1] * 5 + [2] * 5 + [3] * 4 + [4] * 5 + [5] * 5
    assert got["b", None] == 0


def test_open_bursts_keep_late_rows_and_leave_closed_ones_apart(spark):
    """With a gap of 10 and a delay of 100 the second slice finds all up to 100 closed: a late row at 95 is taken, but not joined to the burst that ended at 88."""
    rows = [(0, 80), (0, 88), (0, 102), (0, 111), (0, 200), (1, 90), (1, 95), (1, 109)]
    arrived = spark.createDataFrame([("a", t, 1.0, s) for s, t in rows], "symbol string, event_ts_ms long, qty double, __slice int")
    got = bars.open_bursts(arrived, 10, 100, 2).select("n_trades", "qty", "start_ms", "end_ms").collect()
    assert [tuple(r) for r in got] == [(4, 4.0, 95, 111)]


def test_replay_works_its_tables_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = spark.range(30).selectExpr("id", "cast(id % 3 as int) as __slice").mapInArrow(counted, "id long, __slice int")
    out = replay({"t": t}, str(tmp_path), lambda x: x["t"])
    assert sorted(r.id for r in out.collect()) == list(range(30)) and seen.value == 30


def test_stream_asof_over_many_cells(spark, tmp_path):
    """Cells of 10 ms: quotes are carried over cells without any."""
    t = [(i, 7 * i, i // 20) for i in range(60)]
    events = spark.createDataFrame([("a", i, at, k) for i, at, k in t], "s string, id long, at long, __slice int")
    quotes = spark.createDataFrame([("a", i, at - at % 35 + 1, float(i), k) for i, at, k in t if i % 5 == 0], "s string, q long, at long, mid double, __slice int")
    got = replay({"e": events, "q": quotes}, str(tmp_path), lambda x: stream_asof(x["e"], x["q"], ["s"], "at", ["mid"], "q", "50 milliseconds", 10)).collect()
    want = {i: max((a for _, a in ((j, 7 * j - 7 * j % 35 + 1) for j in range(0, 60, 5)) if a <= 7 * i), default=None) for i in range(60)}
    assert len({r.id for r in got}) == len(got) > 40 and all(r.asof_time == want[r.id] for r in got)


def test_random_controls_hash_each_row_once(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 1.0).alias("v"))
    drawn = fo.random_controls(rows, "id", "v", 40, 3, 17)
    by_hash = lambda t: sorted(range(1000), key=lambda i: hashlib.md5(f"17:{t}:{i}".encode()).hexdigest())
    assert {r.control_id: (r.sampled_rows, r.net_pnl_bps) for r in drawn.collect()} == {t: (40, float(sum(by_hash(t)[:40]))) for t in (1, 2, 3)}
    assert "md5" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    few = fo.random_controls(rows.where("id < 7"), "id", "v", 40, 2, 17).collect()
    assert [(r.sampled_rows, r.net_pnl_bps) for r in few] == [(7, 21.0)] * 2
    same = fo.random_controls(rows.select(F.lit(1).alias("id"), "v"), "id", "v", 40, 3, 17).collect()  # one hash for all rows of a trial: no bound parts them
    assert [r.sampled_rows for r in same] == [40] * 3
    assert fo.random_controls(rows.where("id < 0"), "id", "v", 40, 2, 17).collect() == []


def test_totals_of_windows_come_from_the_cells_of_days(spark):
    rows = spark.range(600).selectExpr("concat('d', 10 + id % 7) as date", "id as event_ts_ms", "id", "concat('s', id % 3) as symbol", "cast(id % 5 as int) as hour", "double(id % 11 - 5) as strategy_return_bps", "double(id % 4) as baseline_return_bps")
    dates = spark.createDataFrame([(w, f"d{10 + w + k}") for w in (0, 2) for k in range(4)], "window int, date string")
    cells = s.day_cells(rows, ["strategy_return_bps", "baseline_return_bps"])
    got, want = s.window_totals(cells, dates), s.walk_forward_scorecard(rows, dates)
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.count() == 2
    oos = s.day_cells(s.oos_rows(rows, dates), ["strategy_return_bps", "baseline_return_bps"])
    long = va.baseline_scorecard(s.oos_rows(rows, dates), ["baseline_return_bps"])
    assert va.baseline_totals(oos, ["baseline_return_bps"]).collect() == long.select("baseline_column", "excess_vs_baseline_bps").collect()


def test_places_are_counted_in_cells_of_time(spark):
    """Times before 0 and cells without rows; a flag that only some rows have; two keys."""
    rows = [("a", t, i) for i, t in enumerate([-25, -3, 0, 4, 4, 9, 10, 57, 58, 400])] + [("b", 5, 0)]
    got = places(spark.createDataFrame(rows, "k string, t long, id long"), ["k"], "t", ["t", "id"], {"at": F.lit(True), "even": F.col("id") % 2 == 0}, 10).collect()
    assert {(r.k, r.id): (r.at, r.even, r.at_n, r.even_n) for r in got} == {("a", i): (i + 1, i // 2 + 1, 10, 5) for i in range(10)} | {("b", 0): (1, 1, 1, 1)}


def test_no_window_of_the_features_holds_a_session(spark):
    """Windows that follow one another each keep their whole group in memory, so groups are cells of time, spans or windows of events."""
    from marketflow.plans.feature_queries import ERA, HOLDOUT
    from marketflow.sources import adapters as a

    sf = "/root/testdata/sf0.001"
    found = ef.event_features(a.fills(spark, sf), a.book(spark, sf), ERA, HOLDOUT, least=50)
    for x in (found, ef.window_rows(found, 200, 200), o.flat_features(found, ["log_return"], 200, 50), ef.snapshots(a.book(spark, sf))):
        assert not re.search(r"windowspecdefinition\(symbol#\d+, session#\d+, ts_ms#\d+L? ASC", x._jdf.queryExecution().optimizedPlan().toString())
    n = found.groupBy("symbol", "session").agg(F.count("*").alias("n"), F.max("n_events").alias("most"), F.min("event_idx").alias("low"), F.max("event_idx").alias("high"), F.count_distinct("event_idx").alias("each")).collect()
    assert n and all((r.n, r.low, r.high, r.each) == (r.most, 0, r.most - 1, r.most) for r in n)


def test_trades_count_with_the_snapshot_before_them_and_early_ones_with_the_first(spark):
    """Snapshots of one time, trades at their time, before the first and after the last, over spans of 60."""
    t = [10 * (i // 2) + 100 for i in range(130)]
    snaps = [("a", 1, at, i, float(i * i % 17)) for i, at in enumerate(t)] + [("b", 1, 5, 0, 1.0)]
    trades = [("a", 1, at, float(at * 7 % 11 - 5)) for at in range(3, 900, 4)] + [("c", 1, 1, 1.0)]
    x = ef.impacts(spark.createDataFrame(snaps, "symbol string, session int, ts_ms long, snap_id long, mid double"), spark.createDataFrame(trades, "symbol string, session int, ts_ms long, signed_notional double"), 50, 60).collect()
    flow = [0.0] * len(t)
    for _, _, at, v in trades[:-1]:
        flow[max(sum(s <= at for s in t) - 1, 0)] += v
    want = kernel.price_impact(np.array([s[4] for s in snaps[:-1]]), np.cumsum(flow), 50)
    assert len(x) == len(t) and {r.snap_id: r["__at"] for r in x} == {i: i for i in range(len(t))}
    assert all(abs(r.kyle_lambda - want[r.snap_id]) < 1e-9 for r in x) and np.count_nonzero(want) > 50
