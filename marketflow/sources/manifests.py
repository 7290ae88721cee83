"""Files as tables: listings, manifests, refresh plans, incremental writes, cold archives and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRUE = ["true", "t", "yes", "y", "1"]
FALSE = ["false", "f", "no", "n", "0", ""]


def parse_bool(c: Column) -> Column:
    """True or false of usual spellings; null counts as false, anything else is null."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(c.isNull(), False).when(x.isin(TRUE), True).when(x.isin(FALSE), False)


def parse_time(c: Column) -> Column:
    """Timestamps of several spellings; null for others."""
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms])


def partition_value(path: Column, name: str) -> Column:
    """The value of name=value in a path; null without one."""
    return F.nullif(F.regexp_extract(path, rf"(?:^|/){name}=([^/]*)", 1), F.lit(""))


def read_frame(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, or Parquet, by its suffix."""
    return spark.read.csv(path, header=True, schema=schema) if path.endswith(".csv") else spark.read.schema(schema).parquet(path)


def describe_schema(df: DataFrame) -> DataFrame:
    """position, name, type of each column."""
    return df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position int, name string, type string")


def parse_listing(lines: DataFrame, prefix: str = "") -> DataFrame:
    """key, size_bytes, mod_time from lines `path;size;time`; folders are left out, a line with fewer fields ends the job."""
    part = F.split("value", ";", 3)
    x = lines.where(F.length(F.trim("value")) > 0).withColumn("p", F.when(F.size(part) == 3, part).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))))
    x = x.where(~F.get("p", F.lit(0)).endswith("/"))
    return x.select(F.concat(F.lit(prefix), F.get("p", F.lit(0))).alias("key"), F.get("p", F.lit(1)).try_cast("long").alias("size_bytes"), parse_time(F.get("p", F.lit(2))).alias("mod_time"))


def source_files(spark: SparkSession, path: str, pattern: str = "*.gz", content: bool = True) -> DataFrame:
    """source_key, size_bytes, mod_time, channel, symbol, date and sha256 of the files below a folder; a task reads whole files."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    names = {n: partition_value(F.col("path"), n).alias(n) for n in ("channel", "symbol", "date")}
    digest = F.sha2("content", 256) if content else F.lit(None).cast("string")
    return x.select(F.col("path").alias("source_key"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mod_time"), *names.values(), digest.alias("sha256"))


def source_manifest(files: DataFrame, lines: DataFrame, open_date: Column) -> DataFrame:
    """files with rows (readable lines; null where none could be read) and status: sealed, unsealed_current for a date that is
    still open, unsealed_unreadable. lines: source_key of each line."""
    n = lines.groupBy("source_key").agg(F.count("*").alias("rows"))
    status = F.when(F.col("date") >= open_date, "unsealed_current").when(F.col("rows").isNull(), "unsealed_unreadable").otherwise("sealed")
    return files.join(n, "source_key", "left").withColumn("status", status)


def verified_sealed(manifest: DataFrame) -> DataFrame:
    """Sealed rows whose checksum was verified and whose gzip can be read; flags may be text."""
    yes = lambda c: F.coalesce(parse_bool(F.col(c)), F.lit(False))
    return manifest.where((F.col("status") == "sealed") & yes("sha_verified") & yes("gzip_readable"))


def refresh_plan(changes: DataFrame, manifest: DataFrame, key: str, partition: list[str]) -> DataFrame:
    """Partitions with a new or changed verified source, and how many. changes: key, change."""
    x = changes.where(F.col("change").isin("new", "changed")).join(verified_sealed(manifest), key)
    return x.groupBy(*partition).agg(F.count("*").alias("n_sources"))


def write_incremental(rows: DataFrame, affected: DataFrame, path: str, partition: list[str], canonical: str) -> None:
    """Rewrites the affected partitions of a table, without repeated rows, and leaves the others; not on the canonical folder."""
    if path.rstrip("/") == canonical.rstrip("/"):
        raise ValueError("an incremental write must not go to the canonical folder")
    x = rows.join(affected.select(*partition).distinct(), partition, "left_semi").dropDuplicates()
    x.repartition(*partition).write.partitionBy(*partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_archive(spark: SparkSession, raw: str, path: str) -> None:
    """Lossless zstd Parquet of all raw lines: source_key, line_number, raw_json. A gzip file is read by one task in order."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(raw).select(F.col("_metadata.file_path").alias("source_key"), "value", F.monotonically_increasing_id().alias("__i"))
    number = F.row_number().over(Window.partitionBy("source_key").orderBy("__i"))
    lines.select("source_key", number.cast("long").alias("line_number"), F.col("value").alias("raw_json")).write.option("compression", "zstd").parquet(path)


def verify_archive(archive: DataFrame, manifest: DataFrame) -> DataFrame:
    """source_key, expected, archived, problem: sources whose line counts differ, that are missing or unknown; null: none."""
    n = archive.groupBy("source_key").agg(F.count("*").alias("archived"))
    x = manifest.select("source_key", F.col("rows").alias("expected")).join(n, "source_key", "full")
    problem = F.when(F.col("archived").isNull(), "missing").when(F.col("expected").isNull(), "unknown").when(F.col("archived") != F.col("expected"), "row_count")
    return x.withColumn("problem", problem)


def restore_check(archive: DataFrame, originals: DataFrame) -> DataFrame:
    """source_key, lines, mismatched: archived lines against the original ones by number."""
    a = archive.select("source_key", "line_number", F.col("raw_json").alias("__a"), F.lit(True).alias("__in"))
    b = originals.select("source_key", "line_number", F.col("raw_json").alias("__b"), F.lit(True).alias("__out"))
    both = a.join(b, ["source_key", "line_number"], "full")
    bad = F.col("__in").isNull() | F.col("__out").isNull() | ~F.col("__a").eqNullSafe(F.col("__b"))
    return both.groupBy("source_key").agg(F.count("*").alias("lines"), F.count_if(bad).alias("mismatched"))


def restored_text(archive: DataFrame) -> DataFrame:
    """source_key, text: a source's lines in order, joined. A source is one file of a partition and hour."""
    line = F.struct("line_number", "raw_json")
    return archive.groupBy("source_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["raw_json"]), "\n").alias("text"))


def retention_plan(objects: DataFrame, now: Column, recent_days: int, expire_days: int) -> DataFrame:
    """objects (key, size_bytes, mod_time, compacted_verified, manifest_verified) with retention_action and remote_delete_allowed."""
    age = F.coalesce((F.unix_timestamp(now) - F.unix_timestamp("mod_time")) / 86_400, F.lit(0.0))
    payload = F.col("key").endswith(".jsonl.gz") | F.col("key").endswith(".jsonl.zst")
    both = F.coalesce(parse_bool(F.col("compacted_verified")), F.lit(False)) & F.coalesce(parse_bool(F.col("manifest_verified")), F.lit(False))
    action = (
        F.when(F.col("key").endswith(".sha256"), "retain_checksum_sidecar").when(~payload, "retain_non_raw_object").when(age <= recent_days, "retain_recent_raw")
        .when(age < expire_days, "needs_compaction_before_raw_expiry").when(both, "eligible_for_remote_expiry_after_review").otherwise("blocked_missing_compaction_or_manifest")
    )
    return objects.withColumn("retention_action", action).withColumn("remote_delete_allowed", F.col("retention_action") == "eligible_for_remote_expiry_after_review")


def partition_stats(rows: DataFrame, symbol: str, day: str) -> DataFrame:
    """One row: symbols, symbol-days, first and last day, symbols with at least 100 and with at most 30 days."""
    days = rows.select(F.col(symbol).alias("s"), F.col(day).alias("d")).distinct().groupBy("s").agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("b"))
    return days.agg(F.count("*").alias("symbols"), F.sum("n").alias("symbol_days"), F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.count_if(F.col("n") >= 100).alias("long_history"), F.count_if(F.col("n") <= 30).alias("short_history"))


def return_stream_faults(rows: DataFrame) -> DataFrame:
    """rows (timestamp, symbol, strategy_return_bps, baseline_return_bps, eligible; all text) typed, with date, hour and fault:
    the first of timestamp, symbol, strategy, baseline, eligible that is invalid, or not_eligible, or null."""
    number = lambda c: F.col(c).try_cast("double")
    finite = lambda c: number(c).isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < float("inf"))
    time, ok = parse_time(F.col("timestamp")), parse_bool(F.col("eligible"))
    fault = (
        F.when(time.isNull(), "timestamp").when(F.coalesce(F.trim("symbol"), F.lit("")) == "", "symbol").when(~finite("strategy_return_bps"), "strategy").when(~finite("baseline_return_bps"), "baseline")
        .when(ok.isNull(), "eligible").when(~ok, "not_eligible")
    )
    x = rows.withColumn("fault", fault).withColumn("timestamp", time)
    return x.withColumns({"strategy_return_bps": number("strategy_return_bps"), "baseline_return_bps": number("baseline_return_bps"), "date": F.date_format("timestamp", "yyyy-MM-dd"), "hour": F.hour("timestamp")})


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, or an error that names the missing columns."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def key_faults(rows: DataFrame, keys: list[str], positive: list[str] = ()) -> DataFrame:
    """One row of counts: null or blank keys, repeated keys, and for each column of `positive` values that are not finite and positive."""
    blank = F.lit(False)
    for k in keys:
        blank |= F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    bad = {f"bad_{c}": F.count_if(F.coalesce(~(F.col(c) > 0) | F.isnan(c) | (F.col(c) == float("inf")), F.lit(True))) for c in positive}
    again = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_keys"))
    return rows.agg(F.count_if(blank).alias("blank_keys"), *[c.alias(k) for k, c in bad.items()]).join(F.broadcast(again))


def contract_diff(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """value, change: values of a set that were added or removed."""
    a, b = old.select(F.col(column).alias("value")).distinct(), new.select(F.col(column).alias("value")).distinct()
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def membership(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """key and for each named set whether it holds it."""
    parts = [df.select(key, F.lit(name).alias("__s")).distinct() for name, df in sets.items()]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(key).agg(*[F.max(F.col("__s") == name).alias(name) for name in sets])
