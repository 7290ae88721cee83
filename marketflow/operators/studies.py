"""Context joins, validation, evaluation, manifests, sampling and ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.functions.running import running
from marketflow.operators.asof import interval_join

SEVERITIES = ["low", "medium", "high"]


def reference_context(state: DataFrame, reference: DataFrame) -> DataFrame:
    """state with the reference market's bar of its bucket: coverage flag, premium and funding divergence; no imputation."""
    ref = reference.select("symbol", "bucket_start_ms", "reference_mid", "reference_funding", F.lit(True).alias("covered"))
    x = state.join(ref, ["symbol", "bucket_start_ms"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    return x.withColumn("premium_bps", F.when(F.col("reference_mid") > 0, (F.col("last_mid") / F.col("reference_mid") - 1) * 10_000)).withColumn("funding_divergence", F.col("funding") - F.col("reference_funding"))


def market_beta(bars: DataFrame, majors: tuple[str, str]) -> DataFrame:
    """Every bar with the majors' returns of its bucket, which of them are there, and their mean if both are."""
    a, b = majors
    wide = bars.where(F.col("symbol").isin(a, b)).groupBy("bucket_start_ms").pivot("symbol", [a, b]).agg(F.first("mid_return_bps")).withColumnsRenamed({a: "major_a", b: "major_b"})
    both = F.col("major_a").isNotNull() & F.col("major_b").isNotNull()
    kind = F.when(both, "both").when(F.col("major_a").isNotNull() | F.col("major_b").isNotNull(), "partial").otherwise("none")
    return bars.select("symbol", "bucket_start_ms", "mid_return_bps").join(wide, "bucket_start_ms", "left").withColumn("coverage", kind).withColumn("market_return_bps", F.when(both, (F.col("major_a") + F.col("major_b")) / 2))


def event_risk(buckets: DataFrame, calendar: DataFrame, cell_ms: int = 3_600_000) -> DataFrame:
    """Distinct buckets with the calendar's active events: count, greatest severity, sorted distinct types.

    calendar: event_ms, event_type, severity, start_ms, end_ms (bounds included).
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    points = buckets.select("bucket_start_ms").distinct()
    hit = interval_join(points, calendar.withColumn("rank", rank), "bucket_start_ms", "start_ms", "end_ms", cell_ms)
    active = hit.groupBy("bucket_start_ms").agg(F.count("*").alias("n_active"), F.max("rank").alias("r"), F.array_join(F.sort_array(F.collect_set("event_type")), ";").alias("types"))
    out = points.join(active, "bucket_start_ms", "left")
    return out.select("bucket_start_ms", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.get(F.array(*map(F.lit, SEVERITIES)), (F.col("r") - 1).cast("int")).alias("max_severity"), F.coalesce("types", F.lit("")).alias("types"))


def manifest_diff(previous: DataFrame, current: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key, change: new, changed, unchanged or removed; null fingerprints compare as equal."""
    p = previous.select(F.col(key), F.col(fingerprint).alias("__p"), F.lit(True).alias("__hp"))
    c = current.select(F.col(key), F.col(fingerprint).alias("__c"), F.lit(True).alias("__hc"))
    change = F.when(F.col("__hp").isNull(), "new").when(F.col("__hc").isNull(), "removed").when(F.col("__p").eqNullSafe(F.col("__c")), "unchanged").otherwise("changed")
    return p.join(c, key, "full").select(key, change.alias("change"))


def sidecar_pairing(objects: DataFrame, suffix: str = ".sha256") -> DataFrame:
    """key, problem: payloads without a sidecar and sidecars without a payload."""
    side = F.col("key").endswith(suffix)
    payload, sidecar = objects.where(~side).select("key"), objects.where(side).select(F.regexp_replace("key", suffix.replace(".", r"\.") + "$", "").alias("key"))
    return payload.join(sidecar, "key", "left_anti").withColumn("problem", F.lit("missing_sidecar")).unionByName(sidecar.join(payload, "key", "left_anti").withColumn("problem", F.lit("orphan_sidecar")))


def inventory_coverage(objects: DataFrame) -> DataFrame:
    """Objects, bytes, latest by channel, by day, by both: one pass with grouping sets."""
    sets = [[F.col("channel")], [F.col("day")], [F.col("channel"), F.col("day")], []]
    out = objects.groupingSets(sets, "channel", "day").agg(F.grouping_id("channel", "day").alias("level"), F.count("*").alias("n_objects"), F.sum("size_bytes").alias("n_bytes"), F.max("key").alias("latest"))
    return out.select("channel", "day", "level", "n_objects", "n_bytes", "latest")


def mismatched_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that only one side has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("only_in", F.lit("right")))


def parity(live: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """column, compared, different: numeric columns of rows that both sides have."""
    x = live.join(batch.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns]), keys)
    pairs = ", ".join(f"'{c}', cast({c} as double), cast(__{c} as double)" for c in columns)
    long = x.selectExpr(f"stack({len(columns)}, {pairs}) as (name, a, b)")
    off = F.when(F.col("a").isNull() | F.col("b").isNull(), ~F.col("a").eqNullSafe(F.col("b"))).otherwise(F.abs(F.col("a") - F.col("b")) > tolerance)
    return long.groupBy("name").agg(F.count("*").alias("compared"), F.count_if(off).alias("different"))


def drawdown(days: DataFrame, by: str, day: str, value: str) -> DataFrame:
    """Per key: total and the deepest fall of the running sum below its running maximum."""
    w = Window.partitionBy(by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    x = days.withColumn("__c", F.sum(value).over(w)).withColumn("__d", F.col("__c") - F.max("__c").over(w))
    return x.groupBy(by).agg(F.sum(value).alias("total"), F.min("__d").alias("max_drawdown"))


def walk_forward_windows(returns: DataFrame, train: int, purge: int, test: int, step: int) -> DataFrame:
    """window, train_start, test_start, test_end over the distinct dates."""
    dates = returns.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row a date
    n = dates.agg(F.count("*").alias("n"))
    starts = n.where(F.col("n") >= train + purge + test).select(F.posexplode(F.sequence(F.lit(0), F.col("n").cast("int") - (train + purge + test), F.lit(step))).alias("window", "s"))
    for name, k in (("train_start", 0), ("test_start", train + purge), ("test_end", train + purge + test - 1)):
        starts = starts.join(dates.select((F.col("i") - k).alias("s"), F.col("date").alias(name)), "s")
    return starts.drop("s")


def window_dates(returns: DataFrame, train: int, purge: int, test: int, step: int) -> DataFrame:
    """window, date: every date of every test window."""
    dates = returns.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row a date
    n = dates.agg(F.count("*").alias("n"))
    starts = n.where(F.col("n") >= train + purge + test).select(F.posexplode(F.sequence(F.lit(0), F.col("n").cast("int") - (train + purge + test), F.lit(step))).alias("window", "s"))
    each = starts.select("window", F.explode(F.sequence(F.col("s") + train + purge, F.col("s") + (train + purge + test - 1))).alias("i"))
    return each.join(dates, "i").select("window", "date")


def oos_rows(returns: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows inside any test window, each once. dates: window, date."""
    return returns.join(dates.select("date").distinct(), "date", "left_semi")


def day_cells(returns: DataFrame, sums: list[str]) -> DataFrame:
    """date, symbol, hour, their rows as n, and the sums of columns. Totals, counts of days and concentrations of any days are sums of these, at most a row for each symbol and hour of a day."""
    return returns.groupBy("date", "symbol", "hour").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])


def concentration(rows: DataFrame, by: str, column: str, size: str | None = None) -> DataFrame:
    """Share of the largest group of a column's values among a key's rows. size: a column that says how many rows a row stands for."""
    n = rows.where(F.col(column).isNotNull()).groupBy(by, column).agg((F.sum(size) if size else F.count("*")).alias("n"))
    return n.groupBy(by).agg((F.max("n") / F.sum("n")).alias(f"max_{column}_concentration"))


def walk_forward_scorecard(returns: DataFrame, dates: DataFrame) -> DataFrame:
    """Per test window: rows, days, symbols, pnl, baseline, excess, mean, Sortino (infinite without a loss, null without a
    gain either), deepest fall of the running pnl, and the largest day's, symbol's and hour's share of rows.

    returns: date, hour, symbol, event_ts_ms, id, strategy_return_bps, baseline_return_bps. dates: window, date. An equi-join.
    """
    x = returns.join(F.broadcast(dates), "date")  # a row for each window and date
    s = F.col("strategy_return_bps")
    path = running(x, ["window"], "date", ["event_ts_ms", "id"], {"equity": (s, "sum")})
    path = running(path, ["window"], "date", ["event_ts_ms", "id"], {"peak": (F.col("equity"), "max")})
    out = path.groupBy("window").agg(
        F.count("*").alias("test_rows"), F.count_distinct("date").alias("distinct_test_days"), F.count_distinct("symbol").alias("distinct_symbols"),
        F.sum(s).alias("net_pnl_bps"), F.sum("baseline_return_bps").alias("baseline_pnl_bps"), F.avg(s).alias("mean_return_bps"),
        F.sqrt(F.avg(F.pow(F.least(s, F.lit(0.0)), 2))).alias("__down"), F.min(F.col("equity") - F.col("peak")).alias("max_drawdown_bps"),
    )
    mean, down = F.col("mean_return_bps"), F.col("__down")
    sortino = F.when(down > 0, mean / down).when(mean > 0, float("inf")).when(mean < 0, float("-inf"))
    out = out.withColumns({"excess_vs_baseline_bps": F.col("net_pnl_bps") - F.col("baseline_pnl_bps"), "sortino": sortino}).drop("__down")
    for column in ("date", "symbol", "hour"):
        out = out.join(concentration(x, "window", column), "window", "left")
    return out.withColumnRenamed("max_date_concentration", "max_day_concentration")


def window_totals(cells: DataFrame, dates: DataFrame) -> DataFrame:
    """Per test window: rows, pnl, baseline, and the largest day's, symbol's and hour's share of rows, as in walk_forward_scorecard(), from day_cells() alone. dates: window, date."""
    x = cells.join(F.broadcast(dates), "date")  # a row for each window and date
    out = x.groupBy("window").agg(F.sum("n").alias("test_rows"), F.sum("strategy_return_bps").alias("net_pnl_bps"), F.sum("baseline_return_bps").alias("baseline_pnl_bps"))
    for column in ("date", "symbol", "hour"):
        out = out.join(concentration(x, "window", column, "n"), "window", "left")
    return out.withColumnRenamed("max_date_concentration", "max_day_concentration")


def auc(scored: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """Area under the ROC curve per key with shared ranks for ties: counts by score, then running sums of negatives."""
    c = scored.groupBy(by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = c.withColumn("wins", F.col("p") * (below + F.col("n") / 2))
    return x.groupBy(by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), (F.sum("wins") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def benjamini_hochberg(tests: DataFrame, p: str, name: str) -> DataFrame:
    """Adds q: p * n / rank, made monotone from the largest p down."""
    w = Window.orderBy(p, name)
    x = tests.withColumn("__r", F.row_number().over(w)).withColumn("__q", F.col(p) * F.count("*").over(Window.partitionBy(F.lit(0))) / F.col("__r"))
    return x.withColumn("q", F.least(F.min("__q").over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))).drop("__r", "__q")


def sample_per_group(rows: DataFrame, by: list[str], key: Column, n: int, seed: int) -> DataFrame:
    """Up to n rows of each group, those of the least hash of key and seed: the same rows whatever the partitions."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(h, key))).where(F.col("__r") <= n).drop("__r")


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows; a row that breaks a rule (its condition is not true) ends the job with the rule's name."""
    fault = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return rows.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True)))


def paper_ledger(fills: DataFrame, start: float = 0.0, maker_bps: float = 1.5, taker_bps: float = 4.0, eligible: list[str] | None = None) -> DataFrame:
    """Fills with notional, fee, realised pnl, position and average cost after each, and the account's running sums, equity and
    fall below its peak, in the order of (ts_ms, fill_id).

    fills: symbol, ts_ms, fill_id, side (buy, sell, funding), price, quantity, liquidity (maker, taker), funding_payment. A
    sale beyond the position takes it below 0 and realises only what was held; the average cost is 0 from there to the
    next rise above 0. Positions are held to nine digits, so that what rounding leaves of a closed one is none. It is a recurrence, so pandas runs it, but only from one such reset to the next.
    """
    rules = {"side must be buy, sell or funding": F.col("side").isin("buy", "sell", "funding"), "price must be positive": F.col("price") > 0, "quantity must be positive": F.col("quantity") > 0}
    if eligible is not None:
        rules["symbol is not eligible"] = F.col("symbol").isin(eligible)
    x = checked(fills, rules).withColumn("day", F.expr("ts_ms div 86400000")).withColumn("notional", F.col("price") * F.col("quantity"))
    rate = F.when(F.col("side") == "funding", 0.0).when(F.col("liquidity") == "maker", maker_bps).otherwise(taker_bps)
    change = F.when(F.col("side") == "buy", F.col("quantity")).when(F.col("side") == "sell", -F.col("quantity")).otherwise(0.0)
    x = x.withColumn("fee_paid", F.col("notional") * rate / 10_000).withColumn("funding_paid", F.when(F.col("side") == "funding", F.col("funding_payment")).otherwise(0.0)).withColumn("change", change)
    order = ["ts_ms", "fill_id"]
    x = running(x, ["symbol"], "day", order, {"position_after_fill": (F.col("change"), "sum")})
    x = x.withColumn("position_after_fill", F.round("position_after_fill", 9))
    x = running(x, ["symbol"], "day", order, {"resets": ((F.col("position_after_fill") <= 0).cast("int"), "sum")})
    # the fill that ends at or below 0 still belongs to the stretch before
    x = x.withColumn("stretch", F.col("resets") - (F.col("position_after_fill") <= 0).cast("int"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        was, cost = None, 0.0
        for pdf in parts:
            costs, gains = [], []
            for symbol, stretch, side, price, quantity, after in zip(*(pdf[c].tolist() for c in ("symbol", "stretch", "side", "price", "quantity", "position_after_fill")), strict=True):
                if (symbol, stretch) != was:
                    was, cost = (symbol, stretch), 0.0
                gain = 0.0
                if side == "buy" and after > 0:
                    cost = (cost * (after - quantity) + price * quantity) / after
                elif side == "sell":
                    gain = (price - cost) * min(quantity, max(after + quantity, 0.0))
                    cost = cost if after > 0 else 0.0
                costs.append(cost)
                gains.append(gain)
            yield pdf.assign(average_cost=costs, realized_pnl_on_fill=gains)

    kept = ["symbol", "ts_ms", "fill_id", "day", "side", "price", "quantity", "notional", "fee_paid", "funding_paid", "position_after_fill", "stretch"]
    kinds = dict(x.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", average_cost double, realized_pnl_on_fill double"
    x = x.select(*kept).repartition("symbol", "stretch").sortWithinPartitions("symbol", "stretch", *order).mapInPandas(run, schema).drop("stretch")
    x = running(x, [], "day", order, {"cumulative_realized_pnl": (F.col("realized_pnl_on_fill"), "sum"), "cumulative_fees_paid": (F.col("fee_paid"), "sum"), "cumulative_funding_paid": (F.col("funding_paid"), "sum")})
    x = x.withColumn("cumulative_net_pnl", F.col("cumulative_realized_pnl") - F.col("cumulative_fees_paid") - F.col("cumulative_funding_paid")).withColumn("equity", F.col("cumulative_net_pnl") + start)
    x = running(x, [], "day", order, {"peak": (F.col("equity"), "max")})
    return x.withColumn("drawdown", F.col("equity") - F.col("peak")).drop("peak", "day")


def ledger_positions(ledger: DataFrame) -> DataFrame:
    """symbol, quantity, average_cost after the last fill."""
    last = F.struct("ts_ms", "fill_id")
    return ledger.groupBy("symbol").agg(F.max_by("position_after_fill", last).alias("quantity"), F.max_by("average_cost", last).alias("average_cost"))


def ledger_summary(ledger: DataFrame, start: float = 0.0) -> DataFrame:
    """One row: realised pnl, fees, funding, net pnl, ending equity, deepest drawdown, fills, symbols."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = ledger.agg(total("realized_pnl_on_fill").alias("realized_pnl"), total("fee_paid").alias("fees_paid"), total("funding_paid").alias("funding_paid"), F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"), F.count("*").alias("fills"), F.count_distinct("symbol").alias("symbols"))
    net = F.col("realized_pnl") - F.col("fees_paid") - F.col("funding_paid")
    return out.withColumns({"net_pnl": net, "ending_equity": net + start})


def round_trip_costs(intents: DataFrame, maker_bps: float = 1.5, taker_bps: float = 4.0, slippage_bps: float = 0.0, adverse_bps: float = 0.0, funding_bps_per_hour: float = 0.0) -> DataFrame:
    """Gross and net result of round trips; costs are charged on the initial notional, slippage and adverse selection a side.

    intents: side (long, short), entry_liquidity, exit_liquidity (maker, taker), entry_price, exit_price, quantity, hold_hours,
    and, null for the defaults, slippage_bps_per_side and adverse_selection_bps_per_side. Shorts receive what longs pay
    as funding. A row that breaks a rule ends the job.
    """
    c = F.col
    rules = {
        "side must be long or short": c("side").isin("long", "short"), "liquidity must be maker or taker": c("entry_liquidity").isin("maker", "taker") & c("exit_liquidity").isin("maker", "taker"),
        "prices must be positive": (c("entry_price") > 0) & (c("exit_price") > 0), "quantity must be positive": c("quantity") > 0, "hold_hours must not be negative": c("hold_hours") >= 0,
    }
    sign = F.when(c("side") == "long", 1).otherwise(-1)
    fee = lambda name: F.when(c(name) == "maker", maker_bps).otherwise(taker_bps)
    paid = lambda bps: F.round(c("initial_notional") * bps / 10_000, 10)
    x = checked(intents, rules).withColumn("initial_notional", c("entry_price") * c("quantity")).withColumn("fee_bps_total", fee("entry_liquidity") + fee("exit_liquidity"))
    x = x.withColumns({
        "gross_pnl": F.round(sign * (c("exit_price") - c("entry_price")) * c("quantity"), 10),
        "fees_paid": paid(c("fee_bps_total")),
        "slippage_paid": paid(F.coalesce("slippage_bps_per_side", F.lit(slippage_bps)) * 2),
        "adverse_selection_paid": paid(F.coalesce("adverse_selection_bps_per_side", F.lit(adverse_bps)) * 2),
        "funding_paid": F.round(sign * c("initial_notional") * funding_bps_per_hour / 10_000 * c("hold_hours"), 10),
    })
    x = x.withColumn("net_pnl", F.round(c("gross_pnl") - c("fees_paid") - c("slippage_paid") - c("adverse_selection_paid") - c("funding_paid"), 10))
    return x.withColumn("net_return_bps", F.round(c("net_pnl") / c("initial_notional") * 10_000, 10))
