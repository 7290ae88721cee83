"""Audits: the lineage of trades from raw lines to bars, tables side by side, and the lifecycle of symbols."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.sources.manifests import parse_bool


def _notes(found: list[tuple[Column, str]]) -> Column:
    """The names whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in found]), lambda x: x.isNotNull())


# --- lineage ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineageConfig:
    """Notional sums may differ by absolute + relative x the greater of both."""

    absolute: float = 1e-6
    relative: float = 1e-9
    bucket_ms: int = 60_000


def trade_lineage(trades: DataFrame, by: list[str], prefix: str, bucket_ms: int, file: str | None = None) -> DataFrame:
    """by, and with the prefix: rows, notional, distinct buckets (of each date), rows without an event time, and files where `file` names a column.

    trades: symbol, date, event_ts_ms, notional. Rows without a time count as invalid and as nothing else.
    """
    there = F.col("event_ts_ms").isNotNull()
    bucket = F.when(there, F.struct("date", F.expr(f"event_ts_ms div {bucket_ms}")))
    out = [
        F.count_if(there).alias(f"{prefix}_trade_rows"), F.coalesce(F.sum(F.when(there, F.col("notional"))), F.lit(0.0)).alias(f"{prefix}_trade_notional_sum"),
        F.count_distinct(bucket).alias(f"{prefix}_trade_bucket_count"), F.count_if(~there).alias(f"{prefix}_invalid_event_ts_rows"),
    ]
    if file:
        out.append(F.count_distinct(F.when(there, F.struct("date", file))).alias(f"{prefix}_trade_files"))
    return trades.groupBy(*by).agg(*out)


def regime_lineage(bars: DataFrame, by: list[str]) -> DataFrame:
    """by, regime_rows, rows with trades, sums of trades and notional, median notional of all rows (none counts as 0) and of those with trades. bars: symbol, date, trade_count, trade_notional."""
    n, v = F.coalesce("trade_count", F.lit(0)), F.coalesce("trade_notional", F.lit(0.0))
    x = bars.withColumns({"__n": n, "__v": v})
    return x.groupBy(*by).agg(
        F.count("*").alias("regime_rows"), F.count_if(F.col("__n") > 0).alias("regime_trade_active_rows"), F.sum("__n").alias("regime_trade_count_sum"), F.sum("__v").alias("regime_trade_notional_sum"),
        F.percentile("__v", 0.5).alias("regime_trade_notional_median_all_rows"), F.percentile(F.when(F.col("__n") > 0, F.col("__v")), 0.5).alias("regime_trade_notional_median_active_rows"),
    )


def lineage(raw: DataFrame, silver: DataFrame, regime: DataFrame, by: list[str], config: LineageConfig = LineageConfig()) -> DataFrame:
    """The three summaries merged by key: what any of them has is there, and what one lacks counts as 0. Adds deltas, the share of bars with trades,
    why the median is zero, and an array of diagnoses."""
    x = raw.join(silver, by, "full").join(regime, by, "full")
    x = x.na.fill(0, [c for c in x.columns if c not in by])
    c = F.col
    apart = lambda a, b: F.abs(a - b) > config.absolute + config.relative * F.greatest(F.abs(a), F.abs(b))
    raw_v, silver_v, regime_v = (c(f"{k}_trade_notional_sum") for k in ("raw", "silver", "regime"))
    x = x.withColumns({
        "raw_silver_row_delta": c("raw_trade_rows") - c("silver_trade_rows"),
        "silver_regime_trade_count_delta": c("silver_trade_rows") - c("regime_trade_count_sum"),
        "raw_silver_notional_delta_abs": F.abs(raw_v - silver_v),
        "silver_regime_notional_delta_abs": F.abs(silver_v - regime_v),
        "regime_trade_active_row_share": F.coalesce(c("regime_trade_active_rows") / F.nullif(c("regime_rows"), F.lit(0)), F.lit(0.0)),
    })
    zero = (
        F.when(c("regime_trade_notional_median_all_rows") != 0, "median_nonzero").when(c("silver_trade_rows") <= 0, "no_silver_trades").when(c("silver_regime_trade_count_delta") != 0, "regime_trade_count_mismatch")
        .when((c("raw_silver_row_delta") != 0) | apart(raw_v, silver_v), "sparse_trade_minutes_with_raw_silver_gap")
        .when(c("regime_trade_active_row_share") <= 0.5, "sparse_trade_minutes_not_missing_trade_lineage").otherwise("zero_median_unexplained")
    )
    x = x.withColumn("activity_median_zero_reason", zero)
    notes = [
        (c("raw_silver_row_delta") != 0, "raw_silver_trade_row_mismatch"),
        (apart(raw_v, silver_v), "raw_silver_notional_mismatch"),
        (c("silver_regime_trade_count_delta") != 0, "silver_regime_trade_count_mismatch"),
        (apart(silver_v, regime_v), "silver_regime_notional_mismatch"),
        ((c("raw_trade_rows") <= 0) & (c("silver_trade_rows") > 0), "silver_trades_without_local_raw_sample"),
        (c("raw_invalid_event_ts_rows") > 0, "raw_invalid_event_ts_rows"),
        (c("silver_invalid_event_ts_rows") > 0, "silver_invalid_event_ts_rows"),
        (c("activity_median_zero_reason") == "sparse_trade_minutes_not_missing_trade_lineage", "median_zero_explained_by_sparse_trade_minutes"),
        (c("activity_median_zero_reason") == "zero_median_unexplained", "zero_median_unexplained"),
    ]
    return x.withColumn("diagnostic_notes", _notes(notes))


#: Diagnoses that fail the audit.
LINEAGE_FAILURES = ["raw_silver_trade_row_mismatch", "raw_silver_notional_mismatch", "silver_regime_trade_count_mismatch", "silver_regime_notional_mismatch", "zero_median_unexplained", "raw_invalid_event_ts_rows", "silver_invalid_event_ts_rows"]


def lineage_verdict(symbols: DataFrame) -> DataFrame:
    """One row: the verdict on lineage() by symbol."""
    bad = F.arrays_overlap("diagnostic_notes", F.array(*map(F.lit, LINEAGE_FAILURES)))
    verdict = F.when(F.count("*") == 0, "LINEAGE_AUDIT_NO_DATA_DIAGNOSTIC").when(F.bool_or(bad), "LINEAGE_AUDIT_FAIL_DIAGNOSTIC").otherwise("LINEAGE_AUDIT_PASS_DIAGNOSTIC")
    return symbols.agg(verdict.alias("verdict"))


# --- side by side ----------------------------------------------------------------------------------------------------------


def side_by_side(canonical: DataFrame, candidate: DataFrame, cell: list[str], keys: list[str], metadata: list[str] = ()) -> DataFrame:
    """A row per cell (such as channel, symbol and date) of either table: rows and an order-free digest of both, and where those differ, what does.

    The first pass sums hashes of rows by cell; only cells whose sums or counts differ are read again, to count rows that one table has more often than
    the other (missing: from the candidate; extra: in it). Also, of the candidate: rows with a null key, keys and whole rows that come again. Columns of the source
    (metadata) are left out of all. Rows are equal if all other columns are, nulls included. failures: what speaks against the candidate.
    """
    payload = [c for c in canonical.columns if c not in metadata]
    if sorted(payload) != sorted(c for c in candidate.columns if c not in metadata):
        raise ValueError("both tables need the same columns")
    body = F.struct(*payload)
    own = {"canonical": canonical.select(*payload), "candidate": candidate.select(*payload)}

    def digest(t: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(F.lit(17), *payload)
        return t.groupBy(*cell).agg(F.count("*").alias(f"{name}_rows"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"__a_{name}"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(f"__b_{name}"), F.count_if(_any_null(keys)).alias(f"__k_{name}"))

    same_cell = lambda a, b: _all([F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cell])
    x = digest(own["canonical"], "canonical").alias("x").join(digest(own["candidate"], "candidate").alias("y"), same_cell("x", "y"), "full")
    x = x.select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in cell], *[F.coalesce(f"{n}_{k}" if not k.startswith("__") else f"{k}_{n}", F.lit(0)).alias(f"{n}_{k}" if not k.startswith("__") else f"{k}_{n}") for n in own for k in ("rows", "__a", "__b", "__k")])
    x = x.withColumn("same", (F.col("canonical_rows") == F.col("candidate_rows")) & (F.col("__a_canonical") == F.col("__a_candidate")) & (F.col("__b_canonical") == F.col("__b_candidate")))
    differ = x.where(~F.col("same")).select(*[F.col(c).alias(f"__{c}") for c in cell])
    signed = own["canonical"].select(*payload, F.lit(1).alias("__s")).unionByName(own["candidate"].select(*payload, F.lit(-1).alias("__s")))
    drill = signed.join(differ, _all([F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cell]), "left_semi")
    drill = drill.groupBy(*cell, body.alias("__body")).agg(F.sum("__s").alias("__d")).groupBy(*cell).agg(F.sum(F.greatest("__d", F.lit(0))).alias("missing_rows"), F.sum(F.greatest(-F.col("__d"), F.lit(0))).alias("extra_rows"))
    again = lambda by, name: own["candidate"].groupBy(*cell, F.struct(*by).alias("__by")).agg(F.count("*").alias("__n")).groupBy(*cell).agg(F.sum(F.col("__n") - 1).alias(name))
    out = x
    for part in (drill, again(keys, "duplicate_keys"), again(payload, "duplicate_rows")):
        names = [c for c in part.columns if c not in cell]
        out = out.alias("l").join(part.alias("r"), same_cell("l", "r"), "left").select("l.*", *[F.coalesce(f"r.{c}", F.lit(0)).alias(c) for c in names])
    out = out.withColumn("key_nulls", F.col("__k_candidate"))
    failures = [
        ((F.col("candidate_rows") == 0) & (F.col("canonical_rows") > 0), "coverage_missing"), (F.col("missing_rows") > 0, "rows_missing"), (F.col("extra_rows") > 0, "rows_extra"),
        (F.col("key_nulls") > 0, "key_nulls"), (F.col("duplicate_keys") > 0, "duplicate_keys"), (F.col("duplicate_rows") > 0, "duplicate_rows"),
    ]
    return out.withColumn("failures", _notes(failures)).select(*cell, "canonical_rows", "candidate_rows", "same", "missing_rows", "extra_rows", "key_nulls", "duplicate_keys", "duplicate_rows", "failures")


def _any_null(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def side_by_side_verdict(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, cells, cells that differ, every failure once, in order of the alphabet, and whether the candidate may take the canonical table's place."""
    failures = F.array_sort(F.array_distinct(F.flatten(F.collect_set("failures"))))  # of six names
    return cells.groupBy(*by).agg(F.count("*").alias("cells"), F.count_if(~F.col("same")).alias("cells_differing"), failures.alias("failures")).withColumn("verdict", F.when(F.size("failures") == 0, "PASS").otherwise("FAIL"))


# --- lifecycle -------------------------------------------------------------------------------------------------------------

STATES = ["COLLECTED", "DISABLED", "ELIGIBLE", "PROBATION", "RESEARCHABLE", "RETIRED"]
#: Gates and what it is called when one fails, in the order of reasons.
GATES = {"sample_gate_pass": "insufficient_days", "liquidity_gate_pass": "depth_too_thin", "spread_cost_gate_pass": "spread_too_wide", "activity_gate_pass": "insufficient_activity", "stability_gate_pass": "unstable_feed", "concentration_gate_pass": "too_concentrated"}


@dataclass(frozen=True)
class LifecycleConfig:
    min_days: int = 10
    min_observations: int = 1000


def _checked(rows: DataFrame, flags: list[str], source: str) -> DataFrame:
    """rows with a sound symbol, once each, and flags read as booleans; anything else ends the job."""
    symbol = F.trim(F.col("symbol"))
    empty = symbol.isNull() | (symbol == "")
    x = rows.withColumn("symbol", F.when(empty, F.raise_error(F.lit(f"{source}: a row without symbol")).cast("string")).otherwise(symbol))
    for c in flags:
        x = x.withColumn(c, F.when(parse_bool(F.col(c)).isNull(), F.raise_error(F.concat(F.lit(f"{source}: {c} is no boolean: "), F.col(c).cast("string"))).cast("boolean")).otherwise(parse_bool(F.col(c))))
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("symbol"))
    twice = F.when(n > 1, F.raise_error(F.concat(F.lit(f"{source}: a symbol comes twice: "), F.col("symbol"))).cast("boolean")).otherwise(True)
    return x.withColumn("__once", twice).where("__once").drop("__once")


def symbol_lifecycle(current: DataFrame, previous: DataFrame | None = None, baseline: DataFrame | None = None, config: LifecycleConfig = LifecycleConfig()) -> DataFrame:
    """symbol, previous_state, lifecycle_state, transition, reason_codes, paper_trading_allowed_diagnostic, n_days, n_observations of every symbol that current or previous has.

    current: symbol, eligible, the six gates, n_days, n_observations. previous: symbol, lifecycle_state. baseline: symbol,
    post_cost_baseline_pass; where it is given, a symbol that it lacks is disabled. Retired symbols stay so; symbols that vanished are disabled;
    what was eligible or on probation falls to probation first. Null flags count as false.
    """
    c = F.col
    spark = current.sparkSession
    now = _checked(current.select("symbol", "eligible", *GATES, "n_days", "n_observations"), ["eligible", *GATES], "eligibility").withColumn("__now", F.lit(True))
    if previous is None:
        previous = spark.createDataFrame([], "symbol string, lifecycle_state string")
    state = F.when(c("lifecycle_state").isin(STATES), c("lifecycle_state")).otherwise(F.raise_error(F.concat(F.lit("previous lifecycle: unknown state "), F.coalesce("lifecycle_state", F.lit("null")))).cast("string"))
    was = _checked(previous.select("symbol", "lifecycle_state"), [], "previous lifecycle").select("symbol", state.alias("previous_state"))
    x = now.join(was, "symbol", "full").withColumn("previous_state", F.coalesce("previous_state", F.lit("NEW"))).withColumn("__now", c("__now").isNotNull())
    if baseline is None:
        x = x.withColumns({"__bad": F.lit(False), "__none": F.lit(False)})
    else:
        good = _checked(baseline.select("symbol", "post_cost_baseline_pass"), ["post_cost_baseline_pass"], "baseline")
        x = x.join(good, "symbol", "left").withColumns({"__bad": F.coalesce(~c("post_cost_baseline_pass"), F.lit(False)), "__none": c("post_cost_baseline_pass").isNull()})
    gates = F.lit(True)
    for g in GATES:
        gates = gates & c(g)
    odd = c("eligible") & ~gates
    hard = c("__bad") | c("__none") | odd | ~c("liquidity_gate_pass") | ~c("activity_gate_pass") | ~c("stability_gate_pass") | ~c("concentration_gate_pass")
    enough = (c("n_days") >= config.min_days) & (c("n_observations") >= config.min_observations)
    plain = F.when(c("eligible") & gates & ~c("__bad") & ~c("__none"), "ELIGIBLE").when(hard, "DISABLED").when(enough, "RESEARCHABLE").otherwise("COLLECTED")
    fell = c("previous_state").isin("ELIGIBLE", "PROBATION") & plain.isin("RESEARCHABLE", "COLLECTED")
    retired, gone = c("previous_state") == "RETIRED", ~c("__now")
    first = _notes([(c("eligible"), "eligible"), *[(~c(g), why) for g, why in GATES.items()], (c("__bad"), "bad_post_cost_baseline")])
    reasons = F.concat(F.when(F.size(first) == 0, F.array(F.lit("collected_only"))).otherwise(first), _notes([(c("__none"), "missing_post_cost_baseline"), (odd, "inconsistent_eligibility_snapshot"), (fell, "demoted_from_eligible")]))
    x = x.withColumns({
        "lifecycle_state": F.when(retired, "RETIRED").when(gone, "DISABLED").when(fell, "PROBATION").otherwise(plain),
        "reason_codes": F.when(retired, "retired_override").when(gone, "missing_current_eligibility").otherwise(F.array_join(reasons, ";")),
    })
    off = retired | gone
    return x.select(
        "symbol", "previous_state", "lifecycle_state", F.concat("previous_state", F.lit("->"), "lifecycle_state").alias("transition"), "reason_codes", (c("lifecycle_state") == "ELIGIBLE").alias("paper_trading_allowed_diagnostic"),
        F.when(off, 0).otherwise(c("n_days")).cast("long").alias("n_days"), F.when(off, 0).otherwise(c("n_observations")).cast("long").alias("n_observations"),
    )
