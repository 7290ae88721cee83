"""Scores against labels: ranks, masks, quantile groups, attribution and clustered bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.functions.quantiles import group_quantiles


def top_mask(rows: DataFrame, by: list[str], score: str, tie: str, share: float) -> DataFrame:
    """rows with top: the first max(1, floor(n * share)) of each key by score; ties in order of `tie`."""
    w = Window.partitionBy(*by)
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share))
    return rows.withColumn("top", F.row_number().over(w.orderBy(F.col(score).desc(), tie)) <= k)


def above_daily_quantile(rows: DataFrame, by: list[str], score: str, share: float) -> DataFrame:
    """rows with top: score strictly above the (1 - share) quantile of its key, such as its day."""
    cut = group_quantiles(rows, by, {"__q": (F.col(score), 1 - share)})
    return rows.join(cut, by).withColumn("top", F.col(score) > F.col("__q")).drop("__q")


def quintiles(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """rows with quintile 1 .. 5 of their cell; 0 where the cell has under 5 rows or its edges coincide."""
    found = group_quantiles(rows, by, {f"__{q}": (F.col(score), q / 5) for q in range(6)}).select(*by, F.array(*[f"__{q}" for q in range(6)]).alias("__e"))
    edges = rows.groupBy(*by).agg(F.count("*").alias("__n")).join(found, by, "left")
    flat = (F.col("__n") < 5) | F.col("__e").isNull() | (F.size(F.array_distinct("__e")) < 6)
    group = F.greatest(F.lit(1), F.size(F.filter("__e", lambda e: e < F.col(score))))
    x = rows.join(edges, by).withColumn("quintile", F.when(flat, 0).otherwise(group))
    full = F.size(F.collect_set("quintile").over(Window.partitionBy(*by))) == 5
    return x.withColumn("quintile", F.when(full, F.col("quintile")).otherwise(0)).drop("__e", "__n")


def precision_at_top(rows: DataFrame, by: list[str], score: str, label: str, tie: str, share: float) -> DataFrame:
    """n_top, precision, recall, base_rate and lift of the first max(1, round(n * share)) rows of each key by score."""
    w = Window.partitionBy(*by)
    k = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * share))
    x = rows.withColumn("__top", F.row_number().over(w.orderBy(F.col(score).desc(), tie)) <= k)
    hit = F.when(F.col("__top"), F.col(label))
    out = x.groupBy(*by).agg(F.count_if("__top").alias("n_top"), F.avg(hit).alias("precision"), (F.sum(hit) / F.nullif(F.sum(label), F.lit(0))).alias("recall"), F.avg(label).alias("base_rate"))
    return out.withColumn("lift", F.col("precision") / F.nullif(F.col("base_rate"), F.lit(0.0)))


def forward_log_return(rows: DataFrame, by: list[str], order: list[str], value: str, horizons: list[int]) -> DataFrame:
    """rows with fwd_h: the sum of the next h log returns; null where fewer follow."""
    w = Window.partitionBy(*by).orderBy(*order)
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = rows.withColumn("__c", total)
    return x.withColumns({f"fwd_{h}": F.lead("__c", h).over(w) - F.col("__c") for h in horizons}).drop("__c")


def realized_direction(forward: Column) -> Column:
    """1 up, 0 not up, -1 unknown."""
    return F.when(forward.isNull() | F.isnan(forward), -1).when(forward > 0, 1).otherwise(0)


def rolling_rate(daily: DataFrame, by: str, day: str, up: str, down: str, days: int, least: int) -> DataFrame:
    """Ups, downs and up / (up + down) over a calendar range of days, where at least `least` days are in it. day: an integer."""
    w = Window.partitionBy(by).orderBy(day).rangeBetween(-(days - 1), 0)
    x = daily.select(by, day, F.sum(up).over(w).alias("n_up"), F.sum(down).over(w).alias("n_down"), F.count("*").over(w).alias("n_days"))
    return x.where((F.col("n_days") >= least) & (F.col("n_up") + F.col("n_down") > 0)).withColumn("rate", F.col("n_up") / (F.col("n_up") + F.col("n_down")))


def rate_swing(rates: DataFrame, by: str, rate: str, limit: float) -> DataFrame:
    """Per key: lowest and highest rate, their difference, and whether it stays within the limit."""
    x = rates.groupBy(by).agg(F.min(rate).alias("low"), F.max(rate).alias("high")).withColumn("swing", F.col("high") - F.col("low"))
    return x.withColumn("verdict", F.when(F.col("swing") <= limit, "STATIONARY").otherwise("DRIFTING"))


def auc_of_days(rows: DataFrame, day: str, score: str, label: str) -> DataFrame:
    """score, day, p, n: counts of both labels by day and score, all that AUCs of sets of days need."""
    return rows.groupBy(day, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))


def weighted_auc(counts: DataFrame, by: list[str], score: str) -> DataFrame:
    """AUC per key from rows of (score, p, n), tie-aware."""
    c = counts.groupBy(*by, score).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    x = c.withColumn("__w", F.col("p") * (F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n") / 2))
    return x.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), (F.sum("__w") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def leave_one_out_auc(rows: DataFrame, day: str, score: str, label: str) -> DataFrame:
    """day, auc, auc_without, drop: what each day adds to the AUC of all, from counts by score less the day's own."""
    c = auc_of_days(rows, day, score, label)
    total = c.groupBy(score).agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    days = c.agg(F.collect_set(day).alias("__d"))
    each = total.join(F.broadcast(days)).withColumn(day, F.explode("__d"))  # a row a score and day
    rest = each.join(c, [day, score], "left").select(day, score, (F.col("__p") - F.coalesce("p", F.lit(0))).alias("p"), (F.col("__n") - F.coalesce("n", F.lit(0))).alias("n"))
    own = weighted_auc(c, [day], score).select(day, "positives", F.col("auc"))
    whole = weighted_auc(total.select(F.lit(0).alias("__k"), score, F.col("__p").alias("p"), F.col("__n").alias("n")), ["__k"], score).select(F.col("auc").alias("__all"))
    out = own.join(weighted_auc(rest, [day], score).select(day, F.col("auc").alias("auc_without")), day).join(F.broadcast(whole))
    return out.withColumn("drop", F.col("__all") - F.col("auc_without")).drop("__all")


def day_draws(days: DataFrame, day: str, replicates: int, seed: int) -> DataFrame:
    """replicate, day, times: as many days drawn with replacement as there are, by hashes of draw numbers. A row a day is few."""
    x = days.select(day).distinct()
    numbered = x.withColumn("__i", F.row_number().over(Window.orderBy(day)) - 1)
    n = numbered.agg(F.count("*").alias("__n"))
    draws = days.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "replicate").join(F.broadcast(n)).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", "__k")), 1, 8), 16, 10).cast("long") % F.col("__n")
    return draws.withColumn("__i", pick).groupBy("replicate", "__i").agg(F.count("*").alias("times")).join(numbered, "__i").select("replicate", day, "times")


def clustered_bootstrap_mean(rows: DataFrame, day: str, value: str, replicates: int, seed: int) -> DataFrame:
    """One row: mean, 2.5 % and 97.5 % bounds over replicates of drawn days, share of replicates at or below 0.

    Only sums by day meet the draws, so a replicate costs a row a day.
    """
    sums = rows.groupBy(day).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    x = day_draws(sums, day, replicates, seed).join(sums, day).groupBy("replicate").agg((F.sum(F.col("times") * F.col("__s")) / F.sum(F.col("times") * F.col("__n"))).alias("m"))
    bounds = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    out = x.agg(bounds[0].alias("low"), bounds[1].alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_one_sided"))
    return sums.agg((F.sum("__s") / F.sum("__n")).alias("mean")).join(F.broadcast(out))


def clustered_bootstrap_auc(rows: DataFrame, day: str, score: str, label: str, replicates: int, seed: int) -> DataFrame:
    """replicate, auc over drawn days, from counts by day and score."""
    c = auc_of_days(rows, day, score, label).join(day_draws(rows, day, replicates, seed), day)
    return weighted_auc(c.select("replicate", score, (F.col("p") * F.col("times")).alias("p"), (F.col("n") * F.col("times")).alias("n")), ["replicate"], score)


def distinguishable(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether two intervals do not overlap."""
    return (low_a > high_b) | (low_b > high_a)


def headroom(edge: Column, slip: Column, fees_bps: float, accuracy: float = 1.0) -> Column:
    """Expected bps of a round trip that is right with probability `accuracy`, after fees and slippage of both sides."""
    return (2 * accuracy - 1) * F.abs(edge) - (2 * fees_bps + F.abs(slip) * 2)


def burst_metrics(burst_bps: Column, forward: Column, cost_bps: float) -> dict[str, Column]:
    """Continuation and reversion in bps after a burst."""
    move = F.signum(burst_bps) * forward * 10_000
    return {"gross_continuation_bps": move, "gross_reversion_bps": -move, "net_reversion_bps": -move - cost_bps, "net_reversion_positive": F.coalesce(-move - cost_bps > 0, F.lit(False))}


def stress_score(trades: Column, spread: Column, change: Column, basis: Column) -> Column:
    """A capped sum; what is null adds nothing."""
    part = lambda x, cap: F.least(F.coalesce(x / 100, F.lit(0.0)), F.lit(cap))  # noqa: E731  least() passes over nulls
    return part(trades, 2.0) + part(F.greatest(spread, F.lit(0.0)), 5.0) + part(F.abs(change), 5.0) + part(F.abs(basis), 5.0)


def risk_state(covered: Column, change: Column, vol: Column, high_vol: float = 40.0, off: float = -10.0, on: float = 10.0) -> Column:
    """Class of a reference bar by volatility and return."""
    return (
        F.when(~F.coalesce(covered, F.lit(False)), "REFERENCE_MISSING")
        .when((vol >= high_vol) & (change <= off), "HIGH_VOL_RISK_OFF")
        .when((vol >= high_vol) & (change >= on), "HIGH_VOL_RISK_ON")
        .when(vol >= high_vol, "HIGH_VOL_NEUTRAL")
        .when(change >= on, "RISK_ON")
        .when(change <= off, "RISK_OFF")
        .otherwise("RISK_NEUTRAL")
    )


def best_levels(bids: Column, asks: Column) -> tuple[Column, Column]:
    """Prices of the first levels with a price and quantity on either side; null unless both sides have one."""
    first = lambda side: F.get(F.filter(side, lambda v: (v["price"] > 0) & (v["qty"] > 0)), F.lit(0))["price"]
    both = first(bids).isNotNull() & first(asks).isNotNull()
    return F.when(both, first(bids)), F.when(both, first(asks))


def identity(columns: list[str]) -> Column:
    """A row's identity as text: name=value, with <NA> for null."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("<NA>"))) for c in columns])


def latest_by(rows: DataFrame, by: str, time: str, fallback: str, tie: str) -> DataFrame:
    """The newest row of each key, by time or else by fallback."""
    at = F.struct(F.coalesce(time, fallback).alias("t"), F.col(tie).alias("i"))
    return rows.groupBy(by).agg(F.max_by(F.struct(*rows.columns), at).alias("r")).select("r.*")


def diverse_top(rows: DataFrame, group: str, time: str, tie: str, n: int) -> DataFrame:
    """n rows: the newest of each group first, then the newest of the rest."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(time), tie))
    return rows.withColumn("__g", (rank > 1).cast("int")).orderBy("__g", F.desc(time), tie).limit(n).drop("__g")


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two groupings, in closed form over the counts of pairs of groups."""
    pairs = lambda c: c * (c - 1) / 2
    cells = rows.groupBy(a, b).agg(F.count("*").alias("c"))
    both = cells.agg(F.sum(pairs(F.col("c"))).alias("both"), F.sum("c").alias("n"))
    side = lambda name, out: cells.groupBy(name).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias(out))
    x = both.join(F.broadcast(side(a, "in_a"))).join(F.broadcast(side(b, "in_b")))  # a row each
    chance = F.col("in_a") * F.col("in_b") / pairs(F.col("n"))
    return x.withColumn("ari", (F.col("both") - chance) / F.nullif((F.col("in_a") + F.col("in_b")) / 2 - chance, F.lit(0.0)))


def nonfinite_attribution(rows: DataFrame, keys: list[str], columns: list[str], position: str) -> DataFrame:
    """keys, feature, bad, first_bad, last_bad, pattern: where features are null, NaN or infinite; features without a fault are
    left out. prefix: only at the start; clustered: one run; else scattered."""
    long = rows.select(*keys, position, F.expr(f"stack({len(columns)}, {', '.join(f'{c!r}, {c}' for c in columns)}) as (feature, v)"))
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    x = long.groupBy(*keys, "feature").agg(F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col(position))).alias("first_bad"), F.max(F.when(bad, F.col(position))).alias("last_bad"), F.min(position).alias("__first"))
    run = F.col("last_bad") - F.col("first_bad") + 1 == F.col("bad")
    return x.where("bad > 0").withColumn("pattern", F.when(run & (F.col("first_bad") == F.col("__first")), "prefix").when(run, "clustered").otherwise("scattered")).drop("__first")


def min_positive(rows: DataFrame, by: str, label: str, least: int) -> DataFrame:
    """Rows of keys with at least `least` positive labels."""
    enough = rows.groupBy(by).agg(F.sum(label).alias("__p")).where(F.col("__p") >= least)
    return rows.join(enough.select(by), by, "left_semi")


def confidence_cells(rows: DataFrame, by: list[str], fees_bps: float = 4.0) -> DataFrame:
    """Per cell, such as (symbol, horizon, quintile): accuracy with its lower bound at two deviations, signed and absolute edge,
    cost of a round trip, headroom, and whether it is tradeable. rows: correct (0, 1), edge_bps, slip_avg_bps."""
    c = F.col
    known = lambda x: F.when(c("edge_bps").isNotNull(), x)
    x = rows.groupBy(*by).agg(
        F.count("*").alias("n_windows"), F.avg("correct").alias("accuracy"), F.avg(known((c("correct") * 2 - 1) * F.abs("edge_bps"))).alias("mean_signed_return_bps"), F.avg(F.abs("edge_bps")).alias("mean_abs_edge_bps"), F.avg(known(F.abs("slip_avg_bps"))).alias("mean_slip_bps"),
    )
    x = x.withColumn("lower_bound", F.greatest(F.lit(0.0), c("accuracy") - F.sqrt(c("accuracy") * (1 - c("accuracy")) / c("n_windows")) * 2))
    x = x.withColumns({"gross_round_trip_bps": (c("accuracy") * 2 - 1) * c("mean_abs_edge_bps"), "cost_round_trip_bps": c("mean_slip_bps") * 2 + 2 * fees_bps})
    x = x.withColumn("headroom_bps", c("gross_round_trip_bps") - c("cost_round_trip_bps"))
    return x.withColumn("tradeable", F.coalesce((c("accuracy") > 0.55) & (c("lower_bound") > 0.51) & (c("headroom_bps") > 0), F.lit(False)))


def feasibility_cells(rows: DataFrame, by: list[str], accuracies: list[float], fees_bps: float = 4.0) -> DataFrame:
    """Per (symbol, size, horizon): share of fillable windows, quantiles of slippage, edge and headroom, and of the headroom at each
    accuracy with its positive share. rows: fillable, slip_avg_bps, edge_bps. Names carry the accuracy in thousandths."""
    slip, edge = F.col("slip_avg_bps"), F.col("edge_bps")
    rooms = {"": headroom(edge, slip, fees_bps), **{f"_{round(a * 1000)}": headroom(edge, slip, fees_bps, a) for a in accuracies}}
    x = rows.withColumns({f"room{s}": F.when(F.col("fillable"), r) for s, r in rooms.items()})
    wanted = {"slip_median_bps": (slip, 0.5), "slip_p90_bps": (slip, 0.9), "edge_median_bps": (edge, 0.5), "edge_p75_bps": (edge, 0.75), "edge_p90_bps": (edge, 0.9)}
    for s in rooms:
        wanted |= {f"headroom{s}_{n}_bps": (F.col(f"room{s}"), q) for n, q in (("median", 0.5), ("p75", 0.75), ("p90", 0.9))}
    shares = [F.avg((F.col(f"room{s}") > 0).cast("double")).alias(f"frac_pos{s}") for s in rooms]
    out = x.groupBy(*by).agg(F.count("*").alias("n_windows"), F.count("room").alias("n_fillable_with_edge"), F.avg(F.col("fillable").cast("double")).alias("fillable_frac"), *shares)
    return out.join(group_quantiles(x, by, wanted), by, "left")


def survivors(cells: DataFrame, by: list[str], accuracies: list[float], share: float = 0.5, least_bps: float = 0.0) -> DataFrame:
    """by, accuracy, headroom_median_bps, frac_pos of the cells that pass both thresholds at an accuracy."""
    each = F.array(*[F.struct(F.lit(a).alias("accuracy"), F.col(f"headroom_{round(a * 1000)}_median_bps").alias("headroom_median_bps"), F.col(f"frac_pos_{round(a * 1000)}").alias("frac_pos")) for a in accuracies])
    return cells.select(*by, F.explode(each).alias("a")).select(*by, "a.*").where((F.col("frac_pos") > share) & (F.col("headroom_median_bps") > least_bps))
