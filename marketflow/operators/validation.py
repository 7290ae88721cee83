"""The verdict on a walk-forward run: baselines out of sample, a summary, and gates in a fixed order."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.functions.running import running


@dataclass(frozen=True)
class ValidationConfig:
    test_days: int = 7
    purge_days: int = 1
    min_diagnostic_days: int = 10
    min_provisional_days: int = 30
    min_validation_grade_days: int = 60
    min_test_rows: int = 20
    max_day_concentration: float = 0.25
    max_symbol_concentration: float = 0.50
    max_hour_concentration: float = 0.50
    min_random_control_beaten_rate: float = 0.50


def baseline_scorecard(oos: DataFrame, baselines: list[str]) -> DataFrame:
    """Per baseline column: rows, pnl of the strategy and of the baseline, excess, the baseline's Sortino (infinite without a loss, null without a gain either) and its deepest fall.

    oos: each row of a test window once, with date, event_ts_ms, id, strategy_return_bps and the baselines.
    """
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in baselines)
    x = oos.selectExpr("date", "event_ts_ms", "id", "strategy_return_bps", f"stack({len(baselines)}, {pairs}) as (baseline_column, v)")
    x = running(x, ["baseline_column"], "date", ["event_ts_ms", "id"], {"equity": (F.col("v"), "sum")})
    x = running(x, ["baseline_column"], "date", ["event_ts_ms", "id"], {"peak": (F.col("equity"), "max")})
    mean, down = F.avg("v"), F.sqrt(F.avg(F.pow(F.least(F.col("v"), F.lit(0.0)), 2)))
    return x.groupBy("baseline_column").agg(
        F.count("*").alias("oos_rows"), F.sum("strategy_return_bps").alias("strategy_pnl_bps"), F.sum("v").alias("baseline_pnl_bps"), (F.sum("strategy_return_bps") - F.sum("v")).alias("excess_vs_baseline_bps"),
        F.when(down > 0, mean / down).when(mean > 0, float("inf")).when(mean < 0, float("-inf")).alias("baseline_sortino"), F.min(F.col("equity") - F.col("peak")).alias("baseline_max_drawdown_bps"),
    )


def baseline_totals(oos: DataFrame, baselines: list[str]) -> DataFrame:
    """Per baseline column: excess of the strategy over it, as in baseline_scorecard(), from sums. oos: day_cells() of the rows in test windows, with sums of strategy_return_bps and the baselines."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in baselines)
    x = oos.selectExpr("strategy_return_bps", f"stack({len(baselines)}, {pairs}) as (baseline_column, v)")
    return x.groupBy("baseline_column").agg((F.sum("strategy_return_bps") - F.sum("v")).alias("excess_vs_baseline_bps"))


def _largest(cells: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the largest share of rows that one value of the column has."""
    return cells.groupBy(column).agg(F.sum("n").alias("n")).agg((F.max("n") / F.sum("n")).alias(name))


def summary(data: DataFrame, oos: DataFrame, scores: DataFrame, baselines: DataFrame, controls: DataFrame) -> DataFrame:
    """One row of what the verdict stands on. data, oos: day_cells() of all rows and of those in test windows; scores: window_totals(); baselines: baseline_totals(); controls: net_pnl_bps of each random control."""
    rows = F.coalesce(F.sum("n"), F.lit(0))
    out = data.agg(rows.alias("observations"), F.count_distinct("date").alias("distinct_days"), F.count_distinct("symbol").alias("distinct_symbols"))
    parts = [oos.agg(rows.alias("unique_oos_rows"), F.count_distinct("date").alias("distinct_oos_days"), F.count_distinct("symbol").alias("distinct_oos_symbols"))]
    parts += [_largest(oos, c, f"max_oos_{n}_concentration") for c, n in (("date", "day"), ("symbol", "symbol"), ("hour", "hour"))]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    parts.append(scores.agg(
        F.count("*").alias("scored_windows"), F.coalesce(F.sum("test_rows"), F.lit(0)).alias("total_test_rows"), total("net_pnl_bps").alias("net_pnl_bps"), total("baseline_pnl_bps").alias("baseline_pnl_bps"),
        *[F.max(f"max_{n}_concentration").alias(f"max_window_{n}_concentration") for n in ("day", "symbol", "hour")],
    ))
    least = F.min(F.struct("excess_vs_baseline_bps", "baseline_column"))
    parts.append(baselines.agg(F.count("*").alias("baseline_count"), least["baseline_column"].alias("worst_baseline_column"), least["excess_vs_baseline_bps"].alias("min_excess_vs_any_baseline_bps")))
    for p in parts:
        out = out.join(F.broadcast(p))  # a row each
    beaten = controls.agg(F.count("*").alias("random_control_trials"), F.collect_list("net_pnl_bps").alias("__c"))  # a number a trial
    out = out.join(F.broadcast(beaten))
    won = F.size(F.filter("__c", lambda v: F.col("net_pnl_bps") > v))
    return out.withColumns({"excess_vs_baseline_bps": F.col("net_pnl_bps") - F.col("baseline_pnl_bps"), "random_controls_beaten_rate": won / F.nullif(F.col("random_control_trials"), F.lit(0))}).drop("__c")


def verdict(found: DataFrame, config: ValidationConfig = ValidationConfig()) -> DataFrame:
    """found, a row of summary(), with verdict and failures: gates of the sample first; only a sound sample is judged on its results."""
    c = F.col
    over = lambda name, limit: F.coalesce(c(name) > limit, F.lit(False))
    low = lambda name: F.coalesce(c(name) <= 0, F.lit(True)) | F.isnan(c(name))
    sample = [
        (c("distinct_oos_days") < config.min_diagnostic_days, "insufficient_oos_distinct_days"), (c("unique_oos_rows") == 0, "no_oos_validation_rows"), (c("observations") == 0, "no_validation_rows"),
        *[(over(f"max_oos_{n}_concentration", getattr(config, f"max_{n}_concentration")), f"oos_{n}_concentration_too_high") for n in ("day", "symbol", "hour")],
        *[(over(f"max_window_{n}_concentration", getattr(config, f"max_{n}_concentration")), f"window_{n}_concentration_too_high") for n in ("symbol", "hour")],
    ]
    if config.test_days >= math.ceil(1 / config.max_day_concentration):
        sample.append((over("max_window_day_concentration", config.max_day_concentration), "window_day_concentration_too_high"))
    sample += [(c("scored_windows") == 0, "no_purged_validation_windows"), ((c("total_test_rows") < config.min_test_rows) & (c("scored_windows") > 0), "insufficient_test_rows")]
    result = [
        (F.lit(config.purge_days == 0), "no_purge_gap"), (c("random_control_trials") == 0, "random_controls_missing"), (low("net_pnl_bps"), "nonpositive_post_cost_pnl"), (low("excess_vs_baseline_bps"), "baseline_not_beaten"),
        (low("min_excess_vs_any_baseline_bps"), "dumb_baseline_not_beaten"), (F.coalesce(c("random_controls_beaten_rate") < config.min_random_control_beaten_rate, F.lit(False)), "random_controls_not_beaten"),
    ]
    names = lambda gates: F.filter(F.array(*[F.when(g, F.lit(n)) for g, n in gates]), lambda x: x.isNotNull())
    x = found.withColumns({"__s": names(sample), "__r": names(result)})
    grade, days = c("distinct_oos_days") >= config.min_validation_grade_days, c("distinct_oos_days")
    said = (
        F.when(F.size("__s") > 0, "INSUFFICIENT_SAMPLE_DIAGNOSTIC").when((F.size("__r") > 0) & grade, "VALIDATION_GRADE_FAIL").when(F.size("__r") > 0, "PROVISIONAL_FAIL")
        .when(grade, "VALIDATION_GRADE_PASS").when(days >= config.min_provisional_days, "PROVISIONAL_PASS").otherwise("EARLY_SANITY_ONLY")
    )
    return x.withColumns({"verdict": said, "failures": F.when(F.size("__s") > 0, c("__s")).otherwise(c("__r"))}).drop("__s", "__r")


def imbalance_cells(rows: DataFrame, by: list[str], signal: str, cutoff: str, forward: str, fee_bps: float = 4.0, slip_bps: float = 1.0) -> DataFrame:
    """by: windows with a signal, a cutoff and a forward return; those whose signal is stronger than the cutoff, and what following its sign gained there, in bps: mean, median, quartiles, share above 0,
    size of the mean, the cost of a round trip, what is left, and that times the share of such windows. Results are null in cells without such a window."""
    known = F.col(signal).isNotNull() & F.col(cutoff).isNotNull() & F.col(forward).isNotNull() & ~F.isnan(signal) & ~F.isnan(cutoff) & ~F.isnan(forward)
    gain = F.when(F.abs(signal) > F.col(cutoff), F.signum(signal) * F.col(forward) * 10_000)
    x = rows.where(known).withColumn("__g", gain)
    out = x.groupBy(*by).agg(
        F.count("*").alias("n_total_windows"), F.count("__g").alias("n_extreme_windows"), F.avg("__g").alias("mean_signed_return_extreme"), F.percentile("__g", 0.5).alias("median_signed_return_extreme"),
        F.percentile("__g", 0.25).alias("p25_signed_return_extreme"), F.percentile("__g", 0.75).alias("p75_signed_return_extreme"), F.avg((F.col("__g") > 0).cast("double")).alias("frac_positive_signed_return_extreme"),
    )
    cost = 2 * fee_bps + 2 * slip_bps
    room = F.abs("mean_signed_return_extreme") - cost
    share = F.col("n_extreme_windows") / F.col("n_total_windows")
    return out.withColumns({"extreme_frequency": share, "gross_extreme_bps": F.abs("mean_signed_return_extreme"), "cost_round_trip_bps": F.lit(cost), "headroom_extreme_bps": room, "per_day_expected_gross_bps": share * room})


def label_overlap(real: DataFrame, synthetic: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """by: positives of either label over the windows that both have, those positive in both, and their share of each; null without positives. Both: by, key, label (0 or 1, null: left out)."""
    x = real.where("label is not null").select(*by, *key, F.col("label").alias("__r")).join(synthetic.where("label is not null").select(*by, *key, F.col("label").alias("__s")), [*by, *key])
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = x.groupBy(*by).agg(n("__r").alias("n_real_pos"), n("__s").alias("n_syn_pos"), F.count_if((F.col("__r") == 1) & (F.col("__s") == 1)).alias("n_overlap"))
    return out.withColumns({"overlap_real_in_syn": F.col("n_overlap") / F.nullif(F.col("n_real_pos"), F.lit(0)), "overlap_syn_in_real": F.col("n_overlap") / F.nullif(F.col("n_syn_pos"), F.lit(0))})
