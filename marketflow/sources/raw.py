"""Raw message logs: gzip JSON lines in channel=/symbol=/date= folders, read as text and normalised to silver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([T.StructField("recv_ms", T.StringType()), T.StructField("event_ts_ms", T.StringType()), T.StructField("channel", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("data", T.StringType())])
TRADE = "s string, a string, p string, d string, tc string, t string, h string"
BUYS, SELLS = ["open_long", "close_short", "buy"], ["open_short", "close_long", "sell"]


def write_raw(records: DataFrame, path: str) -> None:
    """records: channel, symbol, date and a struct column `record`."""
    records.select("channel", "symbol", "date", F.to_json("record").alias("value")).repartition("channel", "symbol", "date").write.partitionBy("channel", "symbol", "date").option("compression", "gzip").text(path)


def scan_raw(spark: SparkSession, path: str, channels: list[str]) -> DataFrame:
    """value, channel, symbol, date of the channels' lines; blank lines are skipped, truncated files read as far as they go."""
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path)
    return lines.where(F.col("channel").isin(channels) & (F.length(F.trim("value")) > 0))


def safe_float(c: Column) -> Column:
    """A number, or null for garbage, NaN and infinities."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), safe_float(c).cast("long"))


def envelope(lines: DataFrame, data: str) -> DataFrame:
    """data: DDL of the message. event_ts_ms falls back to the message's own time, then the receipt; 0 counts as missing."""
    x = lines.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*", F.from_json("e.data", data).alias("m"))
    time = F.coalesce(*[F.nullif(safe_int(c), F.lit(0)) for c in (F.col("event_ts_ms"), F.col("m.t"), F.col("recv_ms"))])
    return x.select(time.alias("event_ts_ms"), safe_int(F.col("recv_ms")).alias("recv_ms"), F.coalesce("symbol", "m.s", F.lit("UNKNOWN")).alias("symbol"), F.coalesce("channel", F.lit("unknown")).alias("channel"), "m")


def side_sign(c: Column) -> Column:
    return F.when(F.lower(c).isin(BUYS), 1).when(F.lower(c).isin(SELLS), -1).otherwise(0)


def normalize_trades(lines: DataFrame) -> DataFrame:
    """Silver trades."""
    price, qty = safe_float(F.col("m.p")), safe_float(F.col("m.a"))
    return envelope(lines, TRADE).select(
        "event_ts_ms", "recv_ms", "symbol", "channel", price.alias("price"), qty.alias("qty"), (qty * side_sign(F.col("m.d"))).alias("signed_qty"), (price * qty).alias("notional"),
        F.col("m.d").alias("direction"), F.col("m.tc").alias("trade_class"), safe_int(F.col("m.h")).alias("history_id"),
    )


BBO = "s string, b string, B string, a string, A string, i string, li string, t string"
BOOK = "s string, l array<array<struct<p: string, a: string, n: string>>>, li string, t string"
PRICES = "s string, mid string, mark string, oracle string, funding string, next_funding string, open_interest string, volume_24h string, yesterday_price string, t string"
CANDLE = "s string, i string, t string, T string, o string, h string, l string, c string, v string, n string"
BASE = ["event_ts_ms", "recv_ms", "symbol", "channel"]


def _m(name: str) -> Column:
    return F.col("m")[name]


def _mid_spread(bid: Column, ask: Column) -> tuple[Column, Column]:
    mid = (bid + ask) / 2
    return mid, F.when(mid != 0, (ask - bid) / mid * 10_000)


def normalize_bbo(lines: DataFrame) -> DataFrame:
    """Silver best quotes; a missing side leaves mid and spread null and counts as no notional."""
    x = message(lines, BBO)
    bid, ask, bid_qty, ask_qty = (safe_float(_m(c)) for c in ("b", "a", "B_", "A_"))
    mid, spread = _mid_spread(bid, ask)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.select(
        *BASE, bid.alias("bid_px"), bid_qty.alias("bid_qty"), ask.alias("ask_px"), ask_qty.alias("ask_qty"), mid.alias("mid"), spread.alias("spread_bps"),
        (zero(bid) * zero(bid_qty)).alias("top_bid_notional"), (zero(ask) * zero(ask_qty)).alias("top_ask_notional"), safe_int(_m("i")).alias("order_id"), safe_int(_m("li")).alias("last_order_id"),
    )


def normalize_book(lines: DataFrame) -> DataFrame:
    """Silver books: best prices, and quantity and orders of the first 1, 5 and 10 levels of each side."""
    x = message(lines, BOOK)
    both = F.size(F.col("m.l")) >= 2
    none = F.array().cast("array<struct<p: string, a: string, n: string>>")
    sides = {"bid": F.coalesce(F.when(both, F.get(F.col("m.l"), F.lit(0))), none), "ask": F.coalesce(F.when(both, F.get(F.col("m.l"), F.lit(1))), none)}
    best = {k: safe_float(F.get(v, F.lit(0))["p"]) for k, v in sides.items()}
    mid, spread = _mid_spread(best["bid"], best["ask"])
    depth = lambda v, n: F.aggregate(F.slice(v, 1, n), F.lit(0.0), lambda acc, q: acc + F.coalesce(safe_float(q["a"]), F.lit(0.0)))
    orders = lambda v, n: F.aggregate(F.slice(v, 1, n), F.lit(0).cast("long"), lambda acc, q: acc + F.coalesce(safe_int(q["n"]), F.lit(0).cast("long")))
    sums = [f(v, n).alias(f"{k}_{what}_l{n}") for what, f in (("depth", depth), ("orders", orders)) for n in (1, 5, 10) for k, v in sides.items()]
    return x.select(*BASE, best["bid"].alias("bid_px_l1"), best["ask"].alias("ask_px_l1"), mid.alias("mid_l1"), spread.alias("spread_bps_l1"), *sums, safe_int(_m("li")).alias("nonce"))


def normalize_prices(lines: DataFrame) -> DataFrame:
    """Silver prices with the bases of mark and mid against the oracle, null without one."""
    x = message(lines, PRICES)
    names = ["mid", "mark", "oracle", "funding", "next_funding", "open_interest", "volume_24h", "yesterday_price"]
    value = {c: safe_float(_m(c)) for c in names}
    basis = lambda c: F.when(value["oracle"] != 0, (value[c] - value["oracle"]) / value["oracle"] * 10_000)
    return x.select(*BASE, *[v.alias(c) for c, v in value.items()], basis("mark").alias("mark_oracle_basis_bps"), basis("mid").alias("mid_oracle_basis_bps"))


def normalize_candles(lines: DataFrame) -> DataFrame:
    """Silver candles, of trades or of mark prices."""
    x = message(lines, CANDLE)
    prices = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}
    return x.select(
        *BASE, _m("i").alias("interval"), safe_int(_m("t")).alias("start_ts_ms"), safe_int(_m("T_")).alias("end_ts_ms"), *[safe_float(_m(c)).alias(name) for name, c in prices.items()], safe_int(_m("n")).alias("trade_count")
    )


NORMALIZERS = {"trades": normalize_trades, "bbo": normalize_bbo, "book": normalize_book, "prices": normalize_prices, "candle": normalize_candles, "mark_price_candle": normalize_candles}


def message(lines: DataFrame, data: str) -> DataFrame:
    """As envelope(), for messages whose keys differ by case only: a key of one capital letter is read as that letter and _."""
    capital = [f for f in data.replace(",", " ").split() if len(f) == 1 and f.isupper()]
    fixed = F.col("value")
    for key in capital:
        # inside `data` quotes are escaped
        fixed = F.regexp_replace(fixed, rf'([{{,]\\\\?"){key}(\\\\?":)', rf"$1{key}_$2")
        data = data.replace(f" {key} string", f" {key}_ string")
    return envelope(lines.withColumn("value", fixed), data)


def dispatch(lines: DataFrame) -> dict[str, DataFrame]:
    """Silver tables by channel from lines of all channels; unknown channels are dropped."""
    of = F.get_json_object("value", "$.channel")
    return {channel: normalize(lines.where(of == channel)) for channel, normalize in NORMALIZERS.items()}


def explode_messages(texts: DataFrame, compact: bool = True) -> DataFrame:
    """An envelope for each item of a message's data, a list or one object: channel, symbol, event_ts_ms, data, bytes and sha256
    of the raw text, which is kept itself unless compact. texts: recv_ms, raw_text. `prices` without a symbol are for ALL."""
    head = F.from_json("raw_text", "channel string, data string")
    items = F.coalesce(F.from_json(F.col("h.data"), "array<string>"), F.array("h.data"))
    x = texts.select("recv_ms", "raw_text", head.alias("h")).select("recv_ms", "raw_text", "h.channel", F.explode_outer(items).alias("data"))
    field = lambda *names: F.coalesce(*[F.get_json_object("data", f"$.{n}") for n in names])
    symbol = F.coalesce(field("s", "symbol"), F.when(F.col("channel") == "prices", F.lit("ALL")).otherwise(F.lit("UNKNOWN")))
    out = x.select("recv_ms", "channel", symbol.alias("symbol"), F.coalesce(safe_int(field("t", "timestamp")), F.col("recv_ms")).alias("event_ts_ms"), "data", F.octet_length("raw_text").alias("raw_bytes"), F.sha2("raw_text", 256).alias("raw_sha256"), "raw_text")
    return out.drop("raw_text") if compact else out


def subscription_grid(symbols: DataFrame, intervals: list[str], levels: list[int]) -> DataFrame:
    """channel, symbol, parameter: every subscription that a set of symbols needs."""
    grid = {"trades": [""], "bbo": [""], "candle": intervals, "mark_price_candle": intervals, "book": list(map(str, levels))}
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(p).alias("parameter")) for c, ps in grid.items() for p in ps])
    each = symbols.select("symbol", F.explode(pairs).alias("p")).select("p.channel", "symbol", "p.parameter")
    return each.unionByName(symbols.sparkSession.range(1).select(F.lit("prices").alias("channel"), F.lit("ALL").alias("symbol"), F.lit("").alias("parameter")))


def channel_quality(silver: DataFrame, required: list[str] = ()) -> DataFrame:
    """Per channel: rows, symbols, time range, rows with a missing time or symbol or a null in `required`, and repeated rows."""
    missing = F.col("event_ts_ms").isNull() | F.col("symbol").isin("", "UNKNOWN") | F.col("symbol").isNull()
    for c in required:
        missing |= F.col(c).isNull()
    same = silver.groupBy(*silver.columns).agg(F.count("*").alias("__n"), F.count_if(missing).alias("__m"))
    return same.groupBy("channel").agg(F.sum("__n").alias("n"), F.count_distinct("symbol").alias("symbols"), F.min("event_ts_ms").alias("first_ms"), F.max("event_ts_ms").alias("last_ms"), F.sum("__m").alias("incomplete"), F.sum(F.col("__n") - 1).alias("repeated"))


def write_silver_flat(tables: dict[str, DataFrame], path: str) -> None:
    """A Parquet folder for each channel."""
    for channel, table in tables.items():
        table.sortWithinPartitions("symbol", "event_ts_ms").write.mode("overwrite").parquet(f"{path}/{channel}")


def write_silver(silver: DataFrame, path: str) -> None:
    """Parquet by channel, symbol and UTC date, sorted inside each part."""
    day = F.coalesce(F.date_format(F.timestamp_millis(F.coalesce("event_ts_ms", "recv_ms")), "yyyy-MM-dd"), F.lit("unknown"))
    x = silver.withColumn("date", day).repartition("channel", "symbol", "date").sortWithinPartitions(*[F.asc_nulls_last(c) for c in ("symbol", "event_ts_ms", "recv_ms")])
    x.write.partitionBy("channel", "symbol", "date").mode("overwrite").parquet(path)


def scan_silver(spark: SparkSession, path: str, channel: str, symbol_dates: DataFrame | None = None) -> DataFrame:
    """One channel; symbol_dates (symbol, date) restricts it by a semi-join that prunes partitions. Partition values stay text."""
    schema = spark.read.parquet(path).schema
    for f in schema.fields:
        if f.name in ("channel", "symbol", "date"):
            f.dataType = T.StringType()
    x = spark.read.schema(schema).parquet(path).where(F.col("channel") == channel)
    return x if symbol_dates is None else x.join(symbol_dates.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")
