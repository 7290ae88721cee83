"""Bars by symbol and time bucket, regime state, toxicity, governor decisions and eligibility gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.functions.quantiles import group_quantiles
from marketflow.functions.ranks import bin_of, mean_rank_share
from marketflow.sources.shared import written

KEY = ["symbol", "bucket_start_ms"]


def bucket(bucket_ms: int) -> Column:
    return F.expr(f"event_ts_ms div {bucket_ms} * {bucket_ms}").alias("bucket_start_ms")


def bucket_ms(text: str) -> int:
    """'500ms', '30s', '1m', '5min' as milliseconds."""
    for unit, size in (("ms", 1), ("min", 60_000), ("s", 1000), ("m", 60_000)):
        if text.endswith(unit) and text[: -len(unit)].isdigit() and int(text[: -len(unit)]) > 0:
            return int(text[: -len(unit)]) * size
    raise ValueError(f"no bucket size: {text!r}")


def is_liquidation(columns: list[str]) -> Column:
    """By trade class, or by cause where the table has one."""
    kind = F.lower(F.coalesce("trade_class", F.lit("")))
    found = (kind == "liquidation") | kind.endswith("_liquidation")
    if "cause" in columns:
        found = found | F.lower(F.coalesce("cause", F.lit(""))).isin("market_liquidation", "backstop_liquidation")
    return found


def _first(value: str, spot: Column) -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), spot))


def _last(value: str, spot: Column) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), spot))


def regime_bars(bbo: DataFrame, trades: DataFrame, prices: DataFrame, size_ms: int = 60_000, late: str | None = None) -> DataFrame:
    """One row per (symbol, bucket) of any channel: the channels are stacked and aggregated once, without joins.

    Counts and sums of a channel that a bucket lacks are null. First and last values skip nulls and order by event
    time, then receipt time, then id. late: the delay of the watermark, for streams.
    """
    liq = is_liquidation(trades.columns)
    stacked = (
        bbo.select("symbol", bucket(size_ms), "event_ts_ms", F.lit("bbo").alias("ch"), F.struct("event_ts_ms", "recv_ms", "last_order_id").alias("spot"), "spread_bps", "top_bid_notional", "top_ask_notional", "mid", "last_order_id")
        .unionByName(
            trades.select("symbol", bucket(size_ms), "event_ts_ms", F.lit("trades").alias("ch"), "qty", "signed_qty", "notional", liq.cast("long").alias("liq"), F.when(liq, F.col("notional")).otherwise(0.0).alias("liq_notional")),
            allowMissingColumns=True,
        )
        .unionByName(
            prices.select("symbol", bucket(size_ms), "event_ts_ms", F.lit("prices").alias("ch"), F.struct("event_ts_ms", "recv_ms", F.lit(0).cast("long").alias("last_order_id")).alias("spot"), "mark_oracle_basis_bps", "funding", "open_interest"),
            allowMissingColumns=True,
        )
    )
    spot = F.col("spot")
    rows = lambda ch: F.nullif(F.count(F.when(F.col("ch") == ch, 1)), F.lit(0))
    minutes = size_ms / 60_000
    keys = KEY
    if late:
        stacked = stacked.withColumn("seen", F.timestamp_millis("event_ts_ms")).withWatermark("seen", late)
        keys = ["symbol", F.window("seen", f"{size_ms} milliseconds").alias("window")]
    bars = stacked.groupBy(*keys).agg(
        rows("bbo").alias("bbo_updates"),
        F.avg("spread_bps").alias("avg_spread_bps"),
        F.max("spread_bps").alias("max_spread_bps"),
        F.avg("top_bid_notional").alias("avg_top_bid_notional"),
        F.avg("top_ask_notional").alias("avg_top_ask_notional"),
        _first("mid", spot).alias("first_mid"),
        _last("mid", spot).alias("last_mid"),
        (_last("last_order_id", spot) - _first("last_order_id", spot)).alias("order_id_delta"),
        rows("trades").alias("trade_count"),
        F.sum("qty").alias("trade_qty"),
        F.sum("signed_qty").alias("signed_trade_qty"),
        F.sum("notional").alias("trade_notional"),
        F.sum("liq").alias("liquidation_count"),
        F.sum("liq_notional").alias("liquidation_notional"),
        _last("mark_oracle_basis_bps", spot).alias("mark_oracle_basis_bps"),
        _last("funding", spot).alias("funding"),
        _last("open_interest", spot).alias("open_interest"),
        rows("prices").alias("price_updates"),
    )
    if late:
        bars = bars.withColumn("bucket_start_ms", F.unix_millis("window.start")).drop("window")
    return (
        bars.withColumn("mid_return_bps", F.when(F.col("first_mid") != 0, (F.col("last_mid") / F.col("first_mid") - 1) * 10_000))
        .withColumn("bbo_churn_per_min", F.col("bbo_updates") / minutes)
        .withColumn("top_depth_notional", F.col("avg_top_bid_notional") + F.col("avg_top_ask_notional"))
        .withColumn("abs_trade_imbalance", F.when(F.col("trade_count").isNotNull(), F.coalesce(F.abs("signed_trade_qty") / F.nullif(F.col("trade_qty"), F.lit(0.0)), F.lit(0.0))))
        .withColumn("mark_oracle_basis_abs_bps", F.abs("mark_oracle_basis_bps"))
    )


def realized_vol(bars: DataFrame, width: int = 5) -> DataFrame:
    """Sample deviation of the last `width` bar returns of a symbol; 0 with a single one."""
    frame = Window.partitionBy("symbol").orderBy("bucket_start_ms").rowsBetween(-(width - 1), 0)
    return bars.withColumn("realized_vol_bps", F.coalesce(F.stddev_samp("mid_return_bps").over(frame), F.lit(0.0)))


TOXICITY_METRICS = ["avg_spread_bps", "bbo_churn_per_min", "abs_trade_imbalance", "realized_vol_bps", "liquidation_notional", "mark_oracle_basis_abs_bps"]


def toxicity(state: DataFrame) -> DataFrame:
    """Mean over the metrics of each row's rank share, ties averaged; a null metric counts as 0, a constant one as 0.

    Metrics are rounded to 8 decimals first, so that what is equal but for the order of a sum ties. The bars are
    written to the shared folder once, as the ranks read them again.
    """
    named = {f"__{m}": F.round(F.coalesce(F.col(m), F.lit(0.0)).cast("double"), 8) for m in TOXICITY_METRICS}
    ranked = mean_rank_share(written(state.withColumns(named)), KEY, list(named), "toxicity_score")
    return ranked.withColumn("toxicity_score", F.least(F.greatest("toxicity_score", F.lit(0.0)), F.lit(1.0))).drop(*named)


def regime_state(bbo: DataFrame, trades: DataFrame, prices: DataFrame, size_ms: int = 60_000) -> DataFrame:
    return toxicity(realized_vol(regime_bars(bbo, trades, prices, size_ms)))


@dataclass(frozen=True)
class GovernorThresholds:
    skip_toxicity_score: float = 0.90
    max_spread_bps: float = 40.0
    min_top_depth_notional: float = 1_000.0
    max_mark_oracle_basis_abs_bps: float = 100.0
    min_bbo_updates: float = 1.0
    min_trade_count: float = 1.0
    min_trade_notional: float = 1.0
    min_price_updates: float = 1.0

    def __post_init__(self):
        bad = sorted(k for k, v in vars(self).items() if not (isinstance(v, (int, float)) and 0 < v < float("inf")))
        if self.skip_toxicity_score > 1:
            bad.append("skip_toxicity_score")
        if bad:
            raise ValueError(f"thresholds must be positive and finite, toxicity at most 1: {bad}")


#: Decisions in the fixed order of reports.
DECISIONS = ["SKIP_STALE_DATA", "SKIP_WIDE_SPREAD", "SKIP_LOW_DEPTH", "SKIP_TOXIC_REGIME", "SKIP_MARK_ORACLE_DISLOCATION", "TRADABLE_DIAGNOSTIC"]


def governor(state: DataFrame, t: GovernorThresholds = GovernorThresholds()) -> DataFrame:
    """Adds governor_decision, governor_action, governor_reasons. A missing metric takes the value that skips."""
    safe = lambda c, closed: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(closed))
    stale = (
        (safe("bbo_updates", 0.0) < t.min_bbo_updates)
        | (safe("trade_count", 0.0) < t.min_trade_count)
        | (safe("trade_notional", 0.0) < t.min_trade_notional)
        | (safe("price_updates", 0.0) < t.min_price_updates)
    )
    rules = [
        (stale, "stale_data"),
        (safe("avg_spread_bps", t.max_spread_bps) >= t.max_spread_bps, "spread"),
        (safe("top_depth_notional", 0.0) < t.min_top_depth_notional, "depth"),
        (safe("toxicity_score", t.skip_toxicity_score) >= t.skip_toxicity_score, "toxicity"),
        (safe("mark_oracle_basis_abs_bps", t.max_mark_oracle_basis_abs_bps) >= t.max_mark_oracle_basis_abs_bps, "mark_oracle_dislocation"),
    ]
    decision, reason = F.lit(DECISIONS[-1]), F.lit("")
    for (rule, why), name in reversed(list(zip(rules, DECISIONS, strict=False))):
        decision, reason = F.when(rule, name).otherwise(decision), F.when(rule, why).otherwise(reason)
    return state.withColumns({"governor_decision": decision, "governor_reasons": reason}).withColumn(
        "governor_action", F.when(F.col("governor_decision") == DECISIONS[-1], "diagnostic_only").otherwise("skip")
    )


def governor_summary(decisions: DataFrame) -> DataFrame:
    """Counts and shares by decision, in the fixed order, with zero rows."""
    spark = decisions.sparkSession
    names = spark.range(1).select(F.posexplode(F.array(*map(F.lit, DECISIONS))).alias("place", "governor_decision"))
    found = decisions.groupBy("governor_decision").agg(F.count("*").alias("n"), F.count_if(F.col("governor_action") == "skip").alias("s"))
    both = names.join(F.broadcast(found), "governor_decision", "left").na.fill(0, ["n", "s"])
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return both.select(
        "place", "governor_decision", F.col("n").alias("rows"), F.col("s").alias("skip_rows"),
        F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("row_share"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("skip_rate"),
    )


@dataclass(frozen=True)
class EligibilityThresholds:
    min_days: int = 30
    min_observations: int = 10_000
    min_median_top_depth_notional: float = 5_000.0
    max_median_spread_bps: float = 25.0
    min_median_trade_notional_per_min: float = 25.0
    min_median_bbo_updates_per_min: float = 10.0
    max_day_observation_concentration: float = 0.25
    max_p95_spread_bps: float = 75.0
    max_mean_toxicity_score: float = 0.75


GATES = ["sample", "liquidity", "spread_cost", "activity", "stability", "concentration"]


def day_of(ms: str = "bucket_start_ms") -> Column:
    return F.date_format(F.timestamp_millis(F.col(ms)), "yyyy-MM-dd")


def symbol_eligibility(state: DataFrame, t: EligibilityThresholds = EligibilityThresholds()) -> DataFrame:
    """One row per symbol: statistics, six gates, reasons of failure."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    state = written(state)  # it is read several times below
    days = state.groupBy("symbol", day_of().alias("day")).agg(F.count("*").alias("n")).groupBy("symbol").agg((F.max("n") / F.sum("n")).alias("max_day_observation_concentration"), F.count("*").alias("n_days"))
    stats = state.groupBy("symbol").agg(
        F.count("*").alias("n_observations"),
        F.avg(z("toxicity_score")).alias("mean_toxicity_score"),
    )
    middle = {
        "median_top_depth_notional": (z("top_depth_notional"), 0.5), "median_spread_bps": (z("avg_spread_bps"), 0.5), "p95_spread_bps": (z("avg_spread_bps"), 0.95),
        "median_trade_notional_per_min": (z("trade_notional"), 0.5), "median_bbo_updates_per_min": (z("bbo_updates"), 0.5),
    }
    stats = stats.join(group_quantiles(state, ["symbol"], middle), "symbol")
    c = F.col
    tests = [
        (c("n_days") >= t.min_days) & (c("n_observations") >= t.min_observations),
        c("median_top_depth_notional") >= t.min_median_top_depth_notional,
        c("median_spread_bps") <= t.max_median_spread_bps,
        (c("median_trade_notional_per_min") >= t.min_median_trade_notional_per_min) & (c("median_bbo_updates_per_min") >= t.min_median_bbo_updates_per_min),
        (c("p95_spread_bps") <= t.max_p95_spread_bps) & (c("mean_toxicity_score") <= t.max_mean_toxicity_score),
        c("max_day_observation_concentration") <= t.max_day_observation_concentration,
    ]
    out = stats.join(days, "symbol").withColumns({f"{g}_gate_pass": x for g, x in zip(GATES, tests, strict=True)})
    failed = F.array_join(F.array_compact(F.array(*[F.when(~c(f"{g}_gate_pass"), g) for g in GATES])), ";")
    return out.withColumn("failure_reasons", failed).withColumn("eligible", F.col("failure_reasons") == "")


def gate_counts(eligibility: DataFrame) -> DataFrame:
    """How many symbols pass each gate."""
    pairs = ", ".join(f"'{g}', {g}_gate_pass" for g in GATES)
    return eligibility.selectExpr(f"stack({len(GATES)}, {pairs}) as (gate, ok)").groupBy("gate").agg(F.count_if("ok").alias("passing"), F.count("*").alias("symbols"))


def eligibility_verdict(eligibility: DataFrame) -> DataFrame:
    """One row: the overall verdict."""
    any_ = eligibility.agg(F.count("*").alias("n"), F.bool_or("eligible").alias("e"), F.bool_or("sample_gate_pass").alias("s"))
    return any_.select(
        F.when(F.col("n") == 0, "NO_DATA_DIAGNOSTIC").when(F.col("e"), "HAS_ELIGIBLE_SYMBOLS_DIAGNOSTIC").when(~F.col("s"), "INSUFFICIENT_SAMPLE_DIAGNOSTIC").otherwise("NO_ELIGIBLE_SYMBOLS_DIAGNOSTIC").alias("verdict")
    )


def forward_paths(state: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """For each named number of bars ahead: forward return and the worst return of a long and a short on the way, in bps.

    Null where the path leaves the table, has a gap in last_mid, or starts at none or at 0 or less.
    """
    order = Window.partitionBy("symbol").orderBy("bucket_start_ms")
    mid, cols = F.col("last_mid"), {}
    for name, k in horizons.items():
        frame = order.rowsBetween(1, k)
        full = (F.count("last_mid").over(frame) == k) & (mid > 0)
        cols[f"forward_return_{name}_bps"] = F.when(full, (F.lead("last_mid", k).over(order) / mid - 1) * 10_000)
        cols[f"long_adverse_excursion_{name}_bps"] = F.when(full, (F.min("last_mid").over(frame) / mid - 1) * 10_000)
        cols[f"short_adverse_excursion_{name}_bps"] = F.when(full, -(F.max("last_mid").over(frame) / mid - 1) * 10_000)
    return state.withColumns(cols)


def toxicity_deciles(state: DataFrame, n: int = 10, bins: int = 1024) -> DataFrame:
    """toxicity_decile 1..n by rank; ties go by symbol and bucket.

    Rows are ranked inside bins of scores, whose bounds are approximate quantiles, and the bins before are added. Only
    rows of equal score share a bin for sure, so a score that a large part of the rows have makes a large task.
    """
    bounds = state.agg(F.percentile_approx("toxicity_score", [k / bins for k in range(1, bins)], 10 * bins).alias("b")).first().b
    placed = state.withColumn("__bin", bin_of(F.col("toxicity_score"), sorted(set(bounds or []))))
    every = Window.partitionBy(F.lit(0))
    totals = placed.groupBy("__bin").agg(F.count("*").alias("__n"))
    before = totals.select("__bin", F.coalesce(F.sum("__n").over(every.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("__all"))  # a row a bin
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__bin").orderBy("toxicity_score", *KEY))
    decile = F.least(F.greatest(F.ceil(rank / F.col("__all") * n), F.lit(1)), F.lit(n)).cast("long")
    return placed.join(F.broadcast(before), "__bin").withColumn("toxicity_decile", decile).drop("__bin", "__before", "__all")


def long_horizons(state: DataFrame, horizons: list[str]) -> DataFrame:
    """One row per (row, horizon) with a forward return."""
    keep = [c for c in state.columns if not c.endswith("_bps") or c in ("avg_spread_bps",)]
    parts = ", ".join(f"'{h}', forward_return_{h}_bps, long_adverse_excursion_{h}_bps, short_adverse_excursion_{h}_bps" for h in horizons)
    return state.selectExpr(*keep, f"stack({len(horizons)}, {parts}) as (horizon, fwd, long_adverse, short_adverse)").where("fwd is not null")


def risk_stats(prefix: str = "", when: Column | None = None) -> list[Column]:
    """Aggregates over fwd of long_horizons(), of the rows where `when` holds; risk_quantiles() has the others."""
    v = lambda c: F.when(when, F.col(c)) if when is not None else F.col(c)
    low = F.sqrt(F.avg(F.pow(F.least(v("fwd"), F.lit(0.0)), 2) if when is None else F.when(when, F.pow(F.least(F.col("fwd"), F.lit(0.0)), 2))))
    return [F.avg(v("fwd")).alias(f"{prefix}mean_forward_return"), low.alias(f"{prefix}downside_deviation")]


def risk_quantiles(prefix: str = "", when: Column | None = None) -> dict[str, tuple[Column, float]]:
    """Median return and 5 % adverse excursions, for group_quantiles()."""
    v = lambda c: F.when(when, F.col(c)) if when is not None else F.col(c)
    return {f"{prefix}median_forward_return": (v("fwd"), 0.5), f"{prefix}p05_long_adverse": (v("long_adverse"), 0.05), f"{prefix}p05_short_adverse": (v("short_adverse"), 0.05)}


def bucket_risk(deciled: DataFrame) -> DataFrame:
    """Risk by horizon and toxicity decile."""
    key, deciled = ["horizon", "toxicity_decile"], written(deciled)
    out = deciled.groupBy(*key).agg(F.count("*").alias("n_obs"), F.count_distinct("symbol").alias("n_symbols"), *risk_stats()).join(group_quantiles(deciled, key, risk_quantiles()), key)
    return out.withColumn("sortino_proxy", F.col("mean_forward_return") / F.nullif(F.col("downside_deviation"), F.lit(0.0)))


def overlay_scorecard(paths: DataFrame, cutoffs: list[float], min_days: int = 30, min_removed: int = 100) -> DataFrame:
    """Per horizon and cutoff: all rows against those below the cutoff's toxicity quantile."""
    paths = written(paths)  # it is read several times below
    cuts = group_quantiles(paths, ["horizon"], {f"q{i}": (F.col("toxicity_score"), q) for i, q in enumerate(cutoffs)})
    named = cuts.select("horizon", F.explode(F.array(*[F.struct(F.lit(q).alias("cutoff"), F.col(f"q{i}").alias("threshold")) for i, q in enumerate(cutoffs)])).alias("c")).select("horizon", "c.*")
    x = paths.join(F.broadcast(named), "horizon")  # a row a horizon and cutoff
    ok = F.col("toxicity_score") < F.col("threshold")
    of = {**risk_quantiles("acc_", ok), **risk_quantiles("rem_", ~ok)}
    base = group_quantiles(paths, ["horizon"], risk_quantiles("base_"))  # the same for every cutoff
    key = ["horizon", "cutoff", "threshold"]
    out = x.groupBy("horizon", "cutoff", "threshold").agg(
        F.count("*").alias("n_baseline"), F.count_if(ok).alias("n_accepted"), F.count_distinct(day_of()).alias("n_days"),
        F.count_distinct(F.when(~ok, day_of())).alias("removed_days"), *risk_stats("base_"), *risk_stats("acc_", ok), *risk_stats("rem_", ~ok),
    )
    out = out.join(group_quantiles(x, key, of), key).join(base, "horizon")
    return (
        out.withColumn("n_removed", F.col("n_baseline") - F.col("n_accepted"))
        .withColumn("retention_rate", F.col("n_accepted") / F.col("n_baseline"))
        .withColumn("delta_downside_pct", (F.col("acc_downside_deviation") - F.col("base_downside_deviation")) / F.nullif(F.col("base_downside_deviation"), F.lit(0.0)) * 100)
        .withColumn("delta_p05_long", F.col("acc_p05_long_adverse") - F.col("base_p05_long_adverse"))
        .withColumn("delta_p05_short", F.col("acc_p05_short_adverse") - F.col("base_p05_short_adverse"))
        .withColumn("sample_gate_pass", (F.col("n_days") >= min_days) & (F.col("n_removed") >= min_removed))
        .withColumn("retention_gate_pass", F.col("retention_rate") >= 0.70)
    )
