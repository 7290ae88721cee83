"""Reports on archives: the states of files, their errors and recent activity, and what channels and symbols hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_rollups(files: DataFrame, activity: list[str], now_ms: int, window_ms: int, top: int = 20) -> DataFrame:
    """report, name, error, files, bytes: files by status (status), those with an error in all (with_errors) and by status (errors_by_status), the `top` most frequent
    errors (top_errors; ties by status, then error), and files whose time in each column of `activity` is within the window before now (recent).

    files: status, error (null: none), size_bytes, and the activity columns in milliseconds. One pass counts all but the top errors' order. Null sizes count as 0.
    """
    size = F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    groups = files.groupBy("status", "error").agg(F.count("*").alias("files"), size, *[F.count_if(F.col(c) >= now_ms - window_ms).alias(f"n_{c}") for c in activity], *[F.coalesce(F.sum(F.when(F.col(c) >= now_ms - window_ms, F.col("size_bytes"))), F.lit(0)).alias(f"b_{c}") for c in activity])
    none = F.lit(None).cast("string")

    def report(name: str, rows: DataFrame, by: list[str]) -> DataFrame:
        out = rows.groupBy(*by).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        return out.select(F.lit(name).alias("report"), (F.col("status") if "status" in by else none).alias("name"), (F.col("error") if "error" in by else none).alias("error"), "files", "bytes")

    bad = groups.where("error is not null")
    first = report("top_errors", bad, ["status", "error"]).orderBy(F.col("files").desc(), "name", "error").limit(top)
    pairs = ", ".join(f"'{c}', n_{c}, b_{c}" for c in activity)
    recent = groups.selectExpr(f"stack({len(activity)}, {pairs}) as (name, files, bytes)").groupBy("name").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    out = report("status", groups, ["status"]).unionByName(report("with_errors", bad, [])).unionByName(report("errors_by_status", bad, ["status"])).unionByName(first)
    return out.unionByName(recent.select(F.lit("recent").alias("report"), "name", none.alias("error"), "files", "bytes"))


def inventory_report(rows: DataFrame, now_ms: int, file: str) -> DataFrame:
    """channel, symbol, file_count, row_count, latest_event_ts_ms, latest_recv_ms and its age in seconds (null without one). Null names are unknown and UNKNOWN.

    rows: channel, symbol, event_ts_ms, recv_ms and the column that names a row's file, such as _metadata.file_path.
    """
    x = rows.groupBy(F.coalesce("channel", F.lit("unknown")).alias("channel"), F.coalesce("symbol", F.lit("UNKNOWN")).alias("symbol")).agg(
        F.count_distinct(file).alias("file_count"), F.count("*").alias("row_count"), F.max("event_ts_ms").alias("latest_event_ts_ms"), F.max("recv_ms").alias("latest_recv_ms")
    )
    return x.withColumn("latest_age_s", (F.lit(now_ms) - F.col("latest_recv_ms")) / 1000)
