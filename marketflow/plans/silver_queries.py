"""Queries over raw messages of all channels and their silver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.registry import query, view
from marketflow.sources import adapters as a
from marketflow.sources import raw

BASE = "event_ts_ms, event_ts_ms + event_id % 50 as recv_ms, event_type as symbol"
view("px", "select *, 1 + value as px from ev", ["ev"])


def _silver(spark, sf_dir, channel):
    return raw.dispatch(a.raw_lines(spark, sf_dir))[channel]


@query(
    "silver_bbo",
    f"""select {BASE}, 'bbo' as channel, bid_px, k + 1::double as bid_qty, ask_px, 100 - k::double as ask_qty, (bid_px + ask_px) / 2 as mid, case when (bid_px + ask_px) / 2 <> 0 then (ask_px - bid_px) / ((bid_px + ask_px) / 2) * 10000 end as spread_bps,
    coalesce(bid_px, 0) * (k + 1) as top_bid_notional, ask_px * (100 - k) as top_ask_notional, event_id as order_id, event_id as last_order_id from (select *, case when k % 33 <> 0 then px * (1 - (k + 1) / 1e4::double) end as bid_px, px * (1 + (k + 1) / 1e4::double) as ask_px from px)""",
    ["px"],
    "bid_px bid_qty ask_px ask_qty mid spread_bps top_bid_notional top_ask_notional",
)
def silver_bbo(spark, sf_dir):
    """Quotes from raw messages."""
    return _silver(spark, sf_dir, "bbo")


_D = lambda n: ", ".join(f"{' + '.join(f'k + {i}' for i in range(1, min(n, 3) + 1))} + 0.0::double as bid_depth_l{n}, case when k % 10 = 0 then 0.0::double else {' + '.join(f'k + {i}' for i in range(1, min(n, 2) + 1))} + 0.0::double end as ask_depth_l{n}, {sum(range(1, min(n, 3) + 1))}::bigint as bid_orders_l{n}, case when k % 10 = 0 then 0 else {sum(range(1, min(n, 2) + 1))} end::bigint as ask_orders_l{n}" for n in [n])


@query(
    "silver_book",
    f"""select {BASE}, 'book' as channel, bid as bid_px_l1, ask as ask_px_l1, (bid + ask) / 2 as mid_l1, (ask - bid) / ((bid + ask) / 2) * 10000 as spread_bps_l1, {', '.join(_D(n) for n in (1, 5, 10))}, event_id as nonce
    from (select *, px * (1 + -1 * 0.001::double * 1) as bid, case when k % 10 <> 0 then px * (1 + 1 * 0.001::double * 1) end as ask from px)""",
    ["px"],
    "bid_px_l1 ask_px_l1 mid_l1 spread_bps_l1",
)
def silver_book(spark, sf_dir):
    """Books from nested levels."""
    return _silver(spark, sf_dir, "book")


@query(
    "silver_prices",
    f"""select {BASE}, 'prices' as channel, px as mid, px as mark, oracle, k / 1e6::double as funding, null::double as next_funding, value * 10 as open_interest, null::double as volume_24h, null::double as yesterday_price,
    case when oracle <> 0 then (px - oracle) / oracle * 10000 end as mark_oracle_basis_bps, case when oracle <> 0 then (px - oracle) / oracle * 10000 end as mid_oracle_basis_bps from (select *, case when k % 25 = 0 then 0 else px + (k - 50) / 1000::double end as oracle from px)""",
    ["px"],
    "mid mark oracle funding open_interest mark_oracle_basis_bps mid_oracle_basis_bps",
)
def silver_prices(spark, sf_dir):
    """Prices and their bases."""
    return _silver(spark, sf_dir, "prices")


@query(
    "silver_candles",
    f"""select {BASE}, 'candle' as channel, '1m' as "interval", event_ts_ms as start_ts_ms, event_ts_ms + 60000 as end_ts_ms, px as open, px + k / 100::double as high, px - k / 200::double as low, case when k % 40 <> 0 then px + 0.5::double end as close, k * 2.0::double as volume, k as trade_count from px""",
    ["px"],
    "open high low close volume",
)
def silver_candles(spark, sf_dir):
    """Candles; a price that is no number is null."""
    return _silver(spark, sf_dir, "candle")


@query("silver_quality", "select 'candle' as channel, count(*) as n, count(distinct event_type) as symbols, min(event_ts_ms) as first_ms, max(event_ts_ms) as last_ms, count(*) filter (k % 40 = 0) as incomplete, 0::bigint as repeated from ev", ["ev"])
def silver_quality(spark, sf_dir):
    """Quality of one channel, with nulls and repeats."""
    return raw.channel_quality(_silver(spark, sf_dir, "candle"), ["close"])


@query(
    "explode_messages",
    """select event_id + 0 as recv_ms, 'prices' as channel, case when n = 1 then event_type else 'ALL' end as symbol, case when n = 1 then event_ts_ms else event_id end as event_ts_ms, length(text) as raw_bytes, sha256(text) as raw_sha256
    from (select *, '{"channel":"prices","data":[{"s":"' || event_type || '","t":' || event_ts_ms || '},{"x":' || k || '}]}' as text from ev), range(1, 3) t(n)""",
    ["ev"],
)
def explode_messages(spark, sf_dir):
    """An envelope for each item of a message."""
    e = a.events(spark, sf_dir)
    text = F.concat(F.lit('{"channel":"prices","data":[{"s":"'), "event_type", F.lit('","t":'), "event_ts_ms", F.lit('},{"x":'), "k", F.lit("}]}"))
    return raw.explode_messages(e.select(F.col("event_id").alias("recv_ms"), text.alias("raw_text"))).drop("data")


@query(
    "missing_subscriptions",
    """select g.channel, g.symbol, g.parameter from (select channel, symbol, parameter from (select distinct event_type as symbol from ev), (values ('trades', ''), ('bbo', ''), ('candle', '1m'), ('candle', '5m'), ('mark_price_candle', '1m'), ('mark_price_candle', '5m'), ('book', '1'), ('book', '10')) t(channel, parameter) union all select 'prices', 'ALL', '') g
    where not exists (select 1 from ev where event_type = g.symbol and g.channel = 'trades' and k > 98)""",
    ["ev"],
)
def missing_subscriptions(spark, sf_dir):
    """Subscriptions of the grid without any message."""
    e = a.events(spark, sf_dir)
    seen = e.where("k > 98").select(F.lit("trades").alias("channel"), F.col("event_type").alias("symbol")).distinct()
    return raw.subscription_grid(e.select(F.col("event_type").alias("symbol")).distinct(), ["1m", "5m"], [1, 10]).join(seen, ["channel", "symbol"], "left_anti").select("channel", "symbol", "parameter")
