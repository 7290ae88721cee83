"""Samples, splits and folds: seeded by hashes of keys, so that they do not depend on partitions or reruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.sources.shared import written


def hash_order(key: Column, seed: int) -> Column:
    """An order of rows at random by key and seed; every engine has this hash."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def equal_sample(rows: DataFrame, by: str, key: str, seed: int, target: int | None = None) -> DataFrame:
    """As many rows of every group as the smallest group has, or `target`."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    least = F.lit(target) if target else F.min("n")
    x = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(hash_order(F.col(key), seed), key)))
    return x.join(F.broadcast(n.agg(least.alias("__least"))), F.col("__r") <= F.col("__least")).drop("__r", "__least")  # one row is broadcast


def stratified_split(rows: DataFrame, strata: list[str], key: str, seed: int, n: int, train: float = 0.8) -> DataFrame:
    """Up to n rows of each stratum, the first `train` of them as role train, the others as test."""
    w = Window.partitionBy(*strata)
    x = rows.withColumn("__r", F.row_number().over(w.orderBy(hash_order(F.col(key), seed), key))).where(F.col("__r") <= n)
    size = F.count("*").over(w)
    return x.withColumn("role", F.when(F.col("__r") <= F.floor(size * train), "train").otherwise("test")).drop("__r")


def walk_forward_folds(positions: DataFrame, by: list[str], folds: int, embargo: int, min_train: int, min_test: int, rolling: bool = False) -> DataFrame:
    """by, fold, role, first, last: ranges of positions, the training ranges ending `embargo` before the test range.

    positions: by, n (rows of each key, at positions 0 .. n - 1). Keys with too few rows for all folds give none. Expanding, or
    rolling with min_train rows.
    """
    x = positions.where(F.col("n") >= min_train + embargo + folds * min_test).withColumn("__t", F.expr(f"(n - {min_train + embargo}) div {folds}"))
    x = x.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("__s", F.col("fold") * F.col("__t") + min_train + embargo)
    begin = F.greatest(F.col("__s") - embargo - min_train, F.lit(0)) if rolling else F.lit(0).cast("long")
    role = lambda name, a, b: F.struct(F.lit(name).alias("role"), a.cast("long").alias("first"), b.cast("long").alias("last"))
    both = F.array(role("train", begin, F.col("__s") - embargo - 1), role("test", F.col("__s"), F.col("__s") + F.col("__t") - 1))
    return x.select(*by, "fold", F.explode(both).alias("r")).select(*by, "fold", "r.*")


def in_folds(rows: DataFrame, folds: DataFrame, by: list[str], position: str) -> DataFrame:
    """rows with fold and role, once for each fold that holds them; folds of a key are few."""
    own = folds.groupBy(*by).agg(F.collect_list(F.struct("fold", "role", "first", "last")).alias("__f"))
    x = rows.join(own, by).withColumn("__f", F.explode("__f")).where(F.col(position).between(F.col("__f.first"), F.col("__f.last")))
    return x.withColumns({"fold": F.col("__f.fold"), "role": F.col("__f.role")}).drop("__f")


def day_folds(days: DataFrame, day: str, k: int) -> DataFrame:
    """day, fold: contiguous folds of distinct days, the first n % k of them one day longer. A row a day."""
    order = Window.orderBy(day)
    x = days.select(day).distinct().withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(0))))
    base, extra = F.expr(f"__n div {k}"), F.col("__n") % k
    long = extra * (base + 1)
    fold = F.when(F.col("__i") < long, F.floor(F.col("__i") / (base + 1))).otherwise(extra + F.floor((F.col("__i") - long) / F.nullif(base, F.lit(0))))
    return x.select(day, fold.cast("int").alias("fold"))


def embargoed_training(rows: DataFrame, folds: DataFrame, day: str, position: str, embargo: int) -> DataFrame:
    """rows with held_out for each fold that they may train for: not in it, and not within `embargo` events of it at the end
    of the last day before or at the start of the first day after. folds: day, fold."""
    edges = folds.groupBy("fold").agg(F.max(day).alias("__last"), F.min(day).alias("__first"))
    x = rows.join(F.broadcast(folds), day).join(F.broadcast(edges), "fold")  # a row a day and a row a fold
    w = Window.partitionBy(day)
    near_end = (F.col(day) == F.col("__last")) & (F.col(position) >= F.max(position).over(w) - embargo + 1)
    near_start = (F.col(day) == F.col("__first")) & (F.col(position) < F.min(position).over(w) + embargo)
    x = x.withColumns({"__end": near_end, "__start": near_start})
    k = folds.agg(F.max("fold").alias("__k"))
    x = x.join(F.broadcast(k)).withColumn("held_out", F.explode(F.sequence(F.lit(0), F.col("__k"))))
    ok = (F.col("held_out") != F.col("fold")) & ~(F.col("__end") & (F.col("held_out") == F.col("fold") + 1)) & ~(F.col("__start") & (F.col("held_out") == F.col("fold") - 1))
    return x.where(ok).drop("__last", "__first", "__end", "__start", "__k")


def leave_one_day_out(rows: DataFrame, day: str) -> DataFrame:
    """held, day, role, n: each day held out once; from counts by day, so that no row is copied."""
    n = rows.groupBy(day).agg(F.count("*").alias("n"))
    all_days = n.agg(F.array_sort(F.collect_set(day)).alias("__d"))
    x = n.join(F.broadcast(all_days)).withColumn("held", F.explode("__d"))
    return x.select("held", day, F.when(F.col("held") == F.col(day), "test").otherwise("train").alias("role"), "n")


def shuffled_within(rows: DataFrame, cell: list[str], key: str, label: str, seed: int) -> DataFrame:
    """rows with shuffled: the labels of each cell, permuted by hash."""
    here = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*cell).orderBy(key)))
    there = rows.select(*cell, F.col(label).alias("shuffled"), F.row_number().over(Window.partitionBy(*cell).orderBy(hash_order(F.col(key), seed), key)).alias("__r"))
    return here.join(there, [*cell, "__r"]).drop("__r")


def random_controls(rows: DataFrame, key: str, value: str, n: int, trials: int, seed: int) -> DataFrame:
    """control_id, sampled_rows, net_pnl_bps: the sum of n rows drawn without replacement, in each trial.

    A row is drawn if its hash in the trial is among the n least. Each hash is made once: rows below a bound that some 4n + 100 of a trial's hashes should lie under are written, and only they are
    ranked. Should a trial have fewer than n below it, the bound goes up, at last to all rows.
    """
    size = rows.count()
    x = rows.withColumn("control_id", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), "control_id", F.col(key).cast("string"))))
    x = x.select("control_id", "__h", F.col(key).alias("__k"), F.col(value).alias("__v"))
    share = (4 * n + 100) / max(size, 1)
    while True:
        below = written(x.where(F.substring("__h", 1, 8) < f"{int(share * 2**32):08x}") if share < 1 else x)
        enough = below.groupBy("control_id").agg(F.count("*").alias("m")).where(F.col("m") >= n).count()  # a number a trial
        if enough == trials or share >= 1:
            break
        share *= 16
    drawn = below.withColumn("__r", F.row_number().over(Window.partitionBy("control_id").orderBy("__h", "__k"))).where(F.col("__r") <= n)
    return drawn.groupBy("control_id").agg(F.count("*").alias("sampled_rows"), F.sum("__v").alias("net_pnl_bps"))


def session_bucket(ts_ms: Column) -> tuple[Column, Column]:
    """UTC hour and four-hour bucket."""
    hour = F.expr("0") + F.floor(ts_ms / 3_600_000) % 24
    return hour.cast("int"), F.floor(hour / 4).cast("int")


def between_dates(rows: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """Rows of a range of dates, both included; a filter that prunes partitions."""
    return rows.where(F.col(date).between(first, last))
