"""Studies of windows, embeddings, costs and checks of feature tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.operators import order_events as o


def book_bars(book: DataFrame, bucket: Column) -> DataFrame:
    """Per symbol and bucket: updates, mean spread, depths and orders of five levels, first and last nonce."""
    spot = F.struct("event_ts_ms", "nonce")
    means = {"avg_book_spread_bps": "spread_bps_l1", "avg_bid_depth_l5": "bid_depth_l5", "avg_ask_depth_l5": "ask_depth_l5", "avg_bid_orders_l5": "bid_orders_l5", "avg_ask_orders_l5": "ask_orders_l5"}
    return book.groupBy("symbol", bucket.alias("bucket_start_ms")).agg(
        F.count("*").alias("book_updates"), *[F.avg(c).alias(n) for n, c in means.items()], F.min_by("nonce", spot).alias("first_book_nonce"), F.max_by("nonce", spot).alias("last_book_nonce")
    )


def flow_imbalance(fills: DataFrame, length: int) -> DataFrame:
    """Per window of `length` events: opening and closing quantity of both sides, and the imbalance of openings and of all flow."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0.0))
    sides = ["open_long", "open_short", "close_long", "close_short"]
    e = o.indexed(fills.groupBy(*o.DAY, "ts_ms").agg(*[side(s).alias(s) for s in sides]))
    n = F.count("*").over(Window.partitionBy(*o.DAY))
    e = e.withColumn("__n", n).withColumn("window_start", F.expr(f"event_idx div {length} * {length}")).where(F.col("window_start") + length <= F.col("__n"))
    x = e.groupBy(*o.DAY, "window_start").agg(*[F.sum(s).alias(s) for s in sides])
    share = lambda a, b: (a - b) / F.nullif(a + b, F.lit(0.0))
    c = F.col
    return x.withColumns({"open_imbalance": share(c("open_long"), c("open_short")), "flow_imbalance": share(c("open_long") + c("close_short"), c("open_short") + c("close_long"))})


def lag_correlation(windows: DataFrame, by: list[str], columns: list[str], lag: int = 5) -> DataFrame:
    """Per key `by`: the mean over its windows of Pearson's correlation of x[t] and x[t - lag] inside a window."""
    w = Window.partitionBy(*o.DAY, "window_start").orderBy("pos")
    x = windows.withColumns({f"__{c}": F.lag(c, lag).over(w) for c in columns})
    x = x.groupBy(*o.DAY, "window_start").agg(*[F.nanvl(F.corr(c, f"__{c}"), F.lit(None).cast("double")).alias(c) for c in columns])
    return x.groupBy(*by).agg(F.count("*").alias("windows"), *[F.avg(c).alias(f"{c}_autocorr") for c in columns])


def touched(anchors: DataFrame, quotes: DataFrame, by: list[str], horizon: int) -> DataFrame:
    """anchors (ts_ms, bid_limit, ask_limit) with bid_filled: an ask at or below the bid limit in [ts_ms, ts_ms + horizon], and
    ask_filled. Quotes and anchors are stacked, so a range frame takes the place of a range join."""
    a = anchors.select(*by, "ts_ms", F.struct(*anchors.columns).alias("__a"))
    q = quotes.select(*by, "ts_ms", F.col("best_bid").alias("__b"), F.col("best_ask").alias("__k"))
    w = Window.partitionBy(*by).orderBy("ts_ms").rangeBetween(0, horizon)
    x = a.unionByName(q, allowMissingColumns=True).withColumns({"__low": F.min("__k").over(w), "__high": F.max("__b").over(w)}).where("__a is not null")
    return x.select("__a.*", F.coalesce(F.col("__low") <= F.col("__a.bid_limit"), F.lit(False)).alias("bid_filled"), F.coalesce(F.col("__high") >= F.col("__a.ask_limit"), F.lit(False)).alias("ask_filled"))


def attach_cost(rows: DataFrame, costs: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of costs, null where there are none; a key that costs has twice ends the job."""
    n = costs.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    once = n.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("costs must be unique by key")).cast("boolean")).otherwise(F.lit(True)))
    return rows.join(once.drop("__n"), keys, "left")


def cross_symbol_pairs(windows: DataFrame, cell: list[str], key: str) -> DataFrame:
    """Pairs of windows of different symbols in one cell, such as date and hour, once each; a cell holds a window or few of a symbol."""
    a = windows.select(*cell, F.col("symbol").alias("symbol_a"), F.col(key).alias("key_a"))
    b = windows.select(*cell, F.col("symbol").alias("symbol_b"), F.col(key).alias("key_b"))
    return a.join(b, cell).where("symbol_a < symbol_b")


def consecutive_distance(rows: DataFrame, by: str, order: str, vector: str) -> DataFrame:
    """Distance of each vector to the one before, and how far it stands out of the others of its key (z of the rest)."""
    w, whole = Window.partitionBy(by).orderBy(order), Window.partitionBy(by)
    square = F.aggregate(F.zip_with(vector, F.lag(vector).over(w), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, v: acc + v)
    d = F.col("distance")
    x = rows.withColumn("distance", F.sqrt(square))
    n, total, squares = F.count("distance").over(whole), F.sum("distance").over(whole), F.sum(d * d).over(whole)
    mean = (total - d) / F.nullif(n - 1, F.lit(0))
    std = F.sqrt(F.greatest((squares - d * d) / F.nullif(n - 1, F.lit(0)) - mean * mean, F.lit(0.0)))
    return x.withColumn("jump_z", (d - mean) / F.nullif(std, F.lit(0.0))).select(by, order, "distance", "jump_z")


def gram(rows: DataFrame, a: str, b: str) -> DataFrame:
    """i, j, v: the centred cross product of two vector columns; a partition sends one matrix, d x d."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x, y = (np.array(batch.column(c).to_pylist(), np.float64) for c in ("a", "b"))
            if not len(x):
                continue
            part = np.vstack([np.hstack([x.T @ y, x.sum(axis=0)[:, None]]), np.append(y.sum(axis=0), len(x))[None]])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    sums = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(of, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    edge = sums.agg(F.max("i").alias("di"), F.max("j").alias("dj"))
    x = sums.join(F.broadcast(edge))  # a row
    left = x.where("j = dj and i < di").select("i", F.col("v").alias("__l"))
    right = x.where("i = di and j < dj").select("j", F.col("v").alias("__r"))
    n = x.where("i = di and j = dj").select(F.col("v").alias("__n"))
    inner = x.where("i < di and j < dj").select("i", "j", "v")
    return inner.join(F.broadcast(left), "i").join(F.broadcast(right), "j").join(F.broadcast(n)).select("i", "j", (F.col("v") - F.col("__l") * F.col("__r") / F.col("__n")).alias("v"))


def linear_cka(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: linear centred kernel alignment of two embeddings of the same rows."""
    norm = lambda x, y, name: gram(rows, x, y).agg(F.sum(F.col("v") * F.col("v")).alias(name))
    x = norm(a, b, "ab").join(F.broadcast(norm(a, a, "aa"))).join(F.broadcast(norm(b, b, "bb")))  # a row each
    return x.select((F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("cka"))


def overlay_verdict(scorecard: DataFrame, primary: float = 0.9, min_days: int = 30, min_removed: int = 100, minutes: int = 60) -> DataFrame:
    """One row: the verdict of the primary cutoff's rows. minutes: of a horizon's bar."""
    c = F.col
    x = scorecard.where(F.round("cutoff", 6) == round(primary, 6))
    near = (c("horizon") * minutes).isin(15, 30, 60)
    good = near & (c("retention_rate") >= 0.7) & (c("delta_downside_pct") <= -3) & (c("delta_p05_long") >= 5) & (c("delta_p05_short") >= 5) & (c("delta_sortino") >= 0)
    mixed = (c("delta_downside_pct") < 0) | (c("delta_p05_long") > 0) | (c("delta_p05_short") > 0)
    n = x.agg(F.count("*").alias("n"), F.max("n_days").alias("days"), F.max("n_removed").alias("removed"), F.count_if(good).alias("good"), F.coalesce(F.bool_or(good & (c("horizon") * minutes).isin(15, 30)), F.lit(False)).alias("early"), F.coalesce(F.bool_or(mixed), F.lit(False)).alias("mixed"))
    verdict = (
        F.when(c("n") == 0, "INSUFFICIENT_SAMPLE_EMPTY").when((c("days") < min_days) | (c("removed") < min_removed), "INSUFFICIENT_SAMPLE_DIAGNOSTIC")
        .when((c("good") >= 2) & c("early"), "PASS_DIAGNOSTIC").when(c("mixed"), "INCONCLUSIVE_MIXED").otherwise("FAIL")
    )
    return n.select(verdict.alias("verdict"))


def state_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows by state, with zeros for states of the domain without any."""
    all_of = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return all_of.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def feature_checks(features: DataFrame, columns: list[str], horizons: list[int]) -> DataFrame:
    """check, bad, severity: values that are not finite, times that do not grow, labels whose tail is not masked, features out of range."""
    w = o.ordered("ts_ms")
    left = F.count("*").over(Window.partitionBy(*o.DAY)) - F.row_number().over(w)
    bad = {"finite": F.lit(False), "monotone": F.coalesce(F.col("ts_ms") <= F.lag("ts_ms").over(w), F.lit(False)), "tail_mask": F.lit(False)}
    for c in columns:
        bad["finite"] |= F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    for h in horizons:
        bad["tail_mask"] |= F.col(f"dir_h{h}").isNull() != (left < h)
    bad["range"] = ~(F.col("is_open").between(0, 1) & F.col("climax_score").between(0, 5) & F.col("effort_vs_result").between(-5, 5) & F.col("trade_vs_mid").between(-5, 5))
    x = features.withColumns({f"__{k}": v for k, v in bad.items()}).agg(*[F.count_if(f"__{k}").alias(k) for k in bad])
    long = x.selectExpr(f"stack({len(bad)}, {', '.join(f'{k!r}, {k}' for k in bad)}) as (check, bad)")
    return long.withColumn("severity", F.when(F.col("bad") == 0, "OK").when(F.col("check") == "range", "WARN").otherwise("CRITICAL"))
