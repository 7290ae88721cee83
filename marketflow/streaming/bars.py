"""Structured Streaming variants: tumbling and sliding bars, deduplication, bursts, latest rows. They take batch tables as well, for what no watermark has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.operators.regime import is_liquidation


def timed(trades: DataFrame, late: str = "1 hour") -> DataFrame:
    return trades.withColumn("ts", F.timestamp_millis("event_ts_ms")).withWatermark("ts", late)


def stream_bars(trades: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Trade bars by symbol and window; append mode gives each once it is final."""
    liq = is_liquidation(trades.columns)
    return (
        timed(trades, late)
        .groupBy("symbol", F.window("ts", size, slide or size))
        .agg(F.count("*").alias("trade_count"), F.sum("qty").alias("trade_qty"), F.sum("notional").alias("trade_notional"), F.sum(liq.cast("long")).alias("liquidation_count"))
        .select("symbol", F.unix_millis("window.start").alias("bucket_start_ms"), "trade_count", "trade_qty", "trade_notional", "liquidation_count")
    )


def stream_dedup(trades: DataFrame, identity: list[str], late: str = "1 hour") -> DataFrame:
    return timed(trades, late).dropDuplicatesWithinWatermark(identity)


def stream_bursts(trades: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Liquidation bursts as session windows of two trades or more."""
    x = timed(trades.where(is_liquidation(trades.columns)), late)
    out = x.groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("n_trades"), F.sum("qty").alias("qty"), F.min("event_ts_ms").alias("start_ms"), F.max("event_ts_ms").alias("end_ms"))
    return out.where("n_trades >= 2").drop("session_window")


def open_bursts(arrived: DataFrame, gap_ms: int, late_ms: int, slices: int = 3) -> DataFrame:
    """The bursts that stream_bursts() leaves open after all slices of arrivals() of liquidations, from tables.

    A slice's watermark closes sessions before its rows come; rows whose own session it has passed are dropped, the others join what is open.
    """
    newest = dict(arrived.groupBy("__slice").agg(F.max("event_ts_ms")).collect())  # a row a slice
    one = F.lit(1).cast("long").alias("n_trades"), "qty", F.col("event_ts_ms").alias("start_ms"), F.col("event_ts_ms").alias("end_ms")
    held, mark = None, None
    for k in range(slices + 1):
        alive = F.lit(True) if mark is None else F.col("end_ms") + gap_ms > mark - late_ms
        held = held.where(alive) if held is not None else None
        if k == slices:
            break
        come = arrived.where(F.col("__slice") == k).select("symbol", *one).where(alive)
        held = come if held is None else held.unionByName(come)
        # a session's own length and the gap are its window's
        length = F.concat((F.col("end_ms") - F.col("start_ms") + gap_ms).cast("string"), F.lit(" milliseconds"))
        held = held.withColumn("ts", F.timestamp_millis("start_ms")).groupBy("symbol", F.session_window("ts", length)).agg(F.sum("n_trades").alias("n_trades"), F.sum("qty").alias("qty"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("session_window")
        mark = max((v for v in (mark, newest.get(k)) if v is not None), default=None)
    return held.where("n_trades >= 2")


def stream_latest(rows: DataFrame, value: list[str], late: str = "1 hour") -> DataFrame:
    """Per symbol: rows so far, and the newest row's values; for complete mode, a row a symbol of state."""
    newest = F.max_by(F.struct("event_ts_ms", *value), F.struct("event_ts_ms", "history_id")).alias("r")
    return timed(rows, late).groupBy("symbol").agg(F.count("*").alias("n"), newest).select("symbol", "n", "r.*")


def staleness(latest: DataFrame, now_ms: int, limit_ms: int, expected: DataFrame) -> DataFrame:
    """symbol, age_ms, state: fresh, stale, or missing for an expected symbol without any row."""
    x = expected.select("symbol").distinct().join(latest.select("symbol", "event_ts_ms"), "symbol", "left").withColumn("age_ms", F.lit(now_ms) - F.col("event_ts_ms"))
    return x.select("symbol", "age_ms", F.when(F.col("age_ms").isNull(), "missing").when(F.col("age_ms") > limit_ms, "stale").otherwise("fresh").alias("state"))
