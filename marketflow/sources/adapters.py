"""The driver's tables as the domain's tables, and the same as SQL views for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.registry import view

HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")
    return e.withColumn("k", k).withColumn("event_ts_ms", F.expr("unix_micros(cast(ts as timestamp)) div 1000"))


view("ev", """select *, cast(regexp_extract(props, '"k": (\\d+)', 1) as bigint) as k, epoch_us(ts::timestamp) // 1000 as event_ts_ms from events""")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver trades: a row per event, symbol = event type."""
    e = events(spark, sf_dir)
    sign = F.when(F.col("event_type").isin("purchase", "signup"), -1).otherwise(1)
    side = F.create_map(*[F.lit(x) for p in SIDES.items() for x in p])
    return e.select(
        F.col("event_type").alias("symbol"),
        "event_ts_ms",
        (F.col("event_ts_ms") + F.col("event_id") % 50).alias("recv_ms"),
        (1 + F.col("value")).alias("price"),
        (1.0 + F.col("k")).alias("qty"),
        (sign * (1.0 + F.col("k"))).alias("signed_qty"),
        ((1 + F.col("value")) * (1.0 + F.col("k"))).alias("notional"),
        side[F.col("event_type")].alias("direction"),
        F.when(F.col("event_type") == "error", "liquidation").otherwise("normal").alias("trade_class"),
        F.col("event_id").alias("history_id"),
        F.col("user_id"),
    )


SIDES = {"click": "open_long", "view": "close_short", "purchase": "open_short", "signup": "close_long", "error": "open_long"}
view(
    "trades",
    """select event_type as symbol, event_ts_ms, event_ts_ms + event_id % 50 as recv_ms, 1 + value as price, 1.0::double + k as qty,
    case when event_type in ('purchase', 'signup') then -1 else 1 end * (1.0::double + k) as signed_qty, (1 + value) * (1.0::double + k) as notional,
    case event_type when 'click' then 'open_long' when 'view' then 'close_short' when 'purchase' then 'open_short' when 'signup' then 'close_long' else 'open_long' end as direction,
    case when event_type = 'error' then 'liquidation' else 'normal' end as trade_class, event_id as history_id, user_id from ev""",
    ["ev"],
)


def bbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver best quotes: a row per event."""
    e = events(spark, sf_dir)
    bid, ask = (1 + F.col("value")) * (1 - (F.col("k") + 1) / 1e4), (1 + F.col("value")) * (1 + (F.col("k") + 1) / 1e4)
    mid = (bid + ask) / 2
    return e.select(
        F.col("event_type").alias("symbol"),
        "event_ts_ms",
        (F.col("event_ts_ms") + F.col("event_id") % 50).alias("recv_ms"),
        bid.alias("bid_px"),
        ask.alias("ask_px"),
        mid.alias("mid"),
        F.when(mid != 0, (ask - bid) / mid * 10_000).alias("spread_bps"),
        (bid * (F.col("k") + 1)).alias("top_bid_notional"),
        (ask * (100 - F.col("k"))).alias("top_ask_notional"),
        F.col("event_id").alias("last_order_id"),
    )


view(
    "bbo",
    """select *, (bid_px + ask_px) / 2 as mid, case when (bid_px + ask_px) / 2 <> 0 then (ask_px - bid_px) / ((bid_px + ask_px) / 2) * 10000 end as spread_bps,
    bid_px * (k + 1) as top_bid_notional, ask_px * (100 - k) as top_ask_notional from (
    select event_type as symbol, event_ts_ms, event_ts_ms + event_id % 50 as recv_ms, (1 + value) * (1 - (k + 1) / 1e4::double) as bid_px,
    (1 + value) * (1 + (k + 1) / 1e4::double) as ask_px, event_id as last_order_id, k from ev)""",
    ["ev"],
)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver mark and oracle prices: the `view` events."""
    e = events(spark, sf_dir).where("event_type = 'view'")
    mark, oracle = 1 + F.col("value"), 1 + F.col("value") + (F.col("k") - 50) / 1000
    return e.select(
        F.col("event_type").alias("symbol"),
        "event_ts_ms",
        (F.col("event_ts_ms") + F.col("event_id") % 50).alias("recv_ms"),
        mark.alias("mark"),
        oracle.alias("oracle"),
        F.when(oracle != 0, (mark / oracle - 1) * 10_000).alias("mark_oracle_basis_bps"),
        (F.col("k") / 1e6).alias("funding"),
        (F.col("value") * 10).alias("open_interest"),
    )


view(
    "prices",
    """select event_type as symbol, event_ts_ms, event_ts_ms + event_id % 50 as recv_ms, 1 + value as mark, 1 + value + (k - 50) / 1000::double as oracle,
    case when 1 + value + (k - 50) / 1000::double <> 0 then ((1 + value) / (1 + value + (k - 50) / 1000::double) - 1) * 10000 end as mark_oracle_basis_bps,
    k / 1e6::double as funding, value * 10 as open_interest from ev where event_type = 'view'""",
    ["ev"],
)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy trades, with a twin of opposite side for each first line of an order."""
    x = table(spark, sf_dir, "lineitem")
    base = x.select(
        F.concat(F.lit("P"), F.col("l_partkey") % 8).alias("symbol"),
        F.year("l_shipdate").alias("session"),
        (F.expr("unix_millis(cast(l_shipdate as timestamp))") + (F.col("l_orderkey") % 86400) * 1000).alias("ts_ms"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "O", "open_long").otherwise("close_short"))
        .otherwise(F.when(F.col("l_linestatus") == "O", "open_short").otherwise("close_long"))
        .alias("side"),
        "l_linenumber",
        F.col("l_orderkey").alias("order_id"),
    ).withColumn("recv_ms", F.col("ts_ms") + F.col("l_linenumber"))
    flip = F.when(F.col("side") == "open_long", "open_short").when(F.col("side") == "open_short", "open_long").when(F.col("side") == "close_long", "close_short").otherwise("close_long")
    twins = base.where("l_linenumber = 1").withColumn("side", flip).withColumn("recv_ms", F.col("recv_ms") + 100)
    return base.withColumn("event_type", F.lit("fulfill_taker")).unionByName(twins.withColumn("event_type", F.lit("fulfill_maker")))


view(
    "fills",
    """select * from (select 'P' || (l_partkey % 8) as symbol, year(l_shipdate) as session, epoch_ms(l_shipdate::timestamp) + (l_orderkey % 86400) * 1000 as ts_ms,
    l_quantity as qty, l_extendedprice / l_quantity as price,
    case when l_returnflag = 'N' then case when l_linestatus = 'O' then 'open_long' else 'close_short' end else case when l_linestatus = 'O' then 'open_short' else 'close_long' end end as side,
    l_linenumber, l_orderkey as order_id, epoch_ms(l_shipdate::timestamp) + (l_orderkey % 86400) * 1000 + l_linenumber as recv_ms, 'fulfill_taker' as event_type from lineitem)
    union all
    select 'P' || (l_partkey % 8), year(l_shipdate), epoch_ms(l_shipdate::timestamp) + (l_orderkey % 86400) * 1000, l_quantity, l_extendedprice / l_quantity,
    case when l_returnflag = 'N' then case when l_linestatus = 'O' then 'open_short' else 'close_long' end else case when l_linestatus = 'O' then 'open_long' else 'close_short' end end,
    l_linenumber, l_orderkey, epoch_ms(l_shipdate::timestamp) + (l_orderkey % 86400) * 1000 + l_linenumber + 100, 'fulfill_maker' from lineitem where l_linenumber = 1""",
)


def book(spark: SparkSession, sf_dir: str, depth: int = 10) -> DataFrame:
    """Order-book snapshots with nested levels: an order is a snapshot, its lines the levels."""
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    level = lambda sign, qty: F.struct(F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"), (F.col("o_totalprice") / 1000 * (1 + sign * 0.0005 * F.col("l_linenumber"))).alias("price"), qty.alias("qty"))
    side = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: F.struct(s["price"].alias("price"), s["qty"].alias("qty")))
    return (
        o.join(x.where(f"l_linenumber <= {depth}"), o["o_orderkey"] == x["l_orderkey"])
        .groupBy(
            F.concat(F.lit("P"), F.col("o_orderkey") % 8).alias("symbol"),
            F.year("o_orderdate").alias("session"),
            (F.expr("unix_millis(cast(o_orderdate as timestamp))") + (F.col("o_orderkey") % 86400) * 1000).alias("ts_ms"),
            F.col("o_orderkey").alias("snap_id"),
        )
        .agg(side(level(-1, F.col("l_quantity"))).alias("bids"), side(level(1, F.col("l_quantity") * (1 + F.col("l_tax")))).alias("asks"))
    )


view(
    "levels",
    """select 'P' || (o_orderkey % 8) as symbol, year(o_orderdate) as session, epoch_ms(o_orderdate::timestamp) + (o_orderkey % 86400) * 1000 as ts_ms, o_orderkey as snap_id,
    l_linenumber as lvl, row_number() over (partition by o_orderkey order by l_linenumber, l_quantity, l_tax) as i, o_totalprice / 1000 * (1 - 0.0005::double * l_linenumber) as bid, l_quantity as bid_qty,
    o_totalprice / 1000 * (1 + 0.0005::double * l_linenumber) as ask, l_quantity * (1 + l_tax) as ask_qty
    from orders join lineitem on o_orderkey = l_orderkey where l_linenumber <= 10""",
)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: raw records of all channels and of an unknown one, as JSON lines. Some messages lack a side, a price or levels."""
    e = events(spark, sf_dir)
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    px, k = 1 + F.col("value"), F.col("k")
    level = lambda sign, i: F.struct(text(px * (1 + sign * 0.001 * i)).alias("p"), text(k + i).alias("a"), F.lit(i).alias("n"))
    asks = F.when(k % 10 == 0, F.array().cast("array<struct<p: string, a: string, n: int>>")).otherwise(F.array(level(1, 1), level(1, 2)))
    data = {
        "bbo": F.struct(F.col("event_type").alias("s"), F.when(k % 33 != 0, text(px * (1 - (k + 1) / 1e4))).alias("b"), text(k + 1).alias("B"), text(px * (1 + (k + 1) / 1e4)).alias("a"), text(100 - k).alias("A"), F.col("event_id").alias("i"), F.col("event_id").alias("li"), F.col("event_ts_ms").alias("t")),
        "book": F.struct(F.col("event_type").alias("s"), F.array(F.array(level(-1, 1), level(-1, 2), level(-1, 3)), asks).alias("l"), F.col("event_id").alias("li"), F.col("event_ts_ms").alias("t")),
        "prices": F.struct(F.col("event_type").alias("s"), text(px).alias("mid"), text(px).alias("mark"), F.when(k % 25 == 0, "0").otherwise(text(px + (k - 50) / 1000)).alias("oracle"), text(k / 1e6).alias("funding"), text(F.col("value") * 10).alias("open_interest")),
        "candle": F.struct(F.col("event_type").alias("s"), F.lit("1m").alias("i"), F.col("event_ts_ms").alias("t"), (F.col("event_ts_ms") + 60_000).alias("T"), text(px).alias("o"), text(px + k / 100).alias("h"), text(px - k / 200).alias("l"), F.when(k % 40 == 0, "nan").otherwise(text(px + 0.5)).alias("c"), text(k * 2).alias("v"), k.alias("n")),
        "gossip": F.struct(F.col("event_type").alias("s")),
    }
    parts = []
    for channel, body in data.items():
        record = F.struct((F.col("event_ts_ms") + F.col("event_id") % 50).alias("recv_ms"), F.col("event_ts_ms"), F.lit(channel).alias("channel"), F.col("event_type").alias("symbol"), F.to_json(body).alias("data"))
        parts.append(e.select(F.to_json(record).alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
