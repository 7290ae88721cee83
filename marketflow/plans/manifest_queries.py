"""Queries over files, listings, manifests, archives and checks of inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.registry import query, view
from marketflow.sources import adapters as a
from marketflow.sources import manifests as m
from marketflow.sources import raw
from marketflow.sources.shared import shared

DAY = "strftime(ts::timestamp, '%Y-%m-%d')"


def _raw_folder(spark, sf_dir) -> str:
    """Raw gzip lines of all trades, by channel, symbol and date."""
    path = f"{shared(spark)}/raw"
    t = a.trades(spark, sf_dir)
    record = F.struct("recv_ms", "event_ts_ms", F.lit("trades").alias("channel"), "symbol", "history_id")
    raw.write_raw(t.select(F.lit("trades").alias("channel"), "symbol", F.date_format(F.timestamp_millis("event_ts_ms"), "yyyy-MM-dd").alias("date"), record.alias("record")), path)
    return path


def _lines(spark, path):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path).select(F.col("_metadata.file_path").alias("source_key"))


def _same_key(c):
    """File paths as both readers spell them, and without escapes."""
    return F.url_decode(F.regexp_replace(c, "^file:/+", "/"))


def _manifest(spark, path, sf_dir):
    files = m.source_files(spark, path).withColumn("source_key", _same_key("source_key"))
    newest = a.trades(spark, sf_dir).agg(F.date_format(F.timestamp_millis(F.max("event_ts_ms")), "yyyy-MM-dd")).first()[0]
    return m.source_manifest(files, _lines(spark, path).withColumn("source_key", _same_key("source_key")), F.lit(newest))


@query("source_manifest", f"select event_type as symbol, {DAY} as date, 'trades' as channel, count(*) as \"rows\", case when {DAY} >= (select max({DAY}) from ev) then 'unsealed_current' else 'sealed' end as status, true as hashed from ev group by all", ["ev"])
def source_manifest(spark, sf_dir):
    """Raw files with rows, checksum and status."""
    x = _manifest(spark, _raw_folder(spark, sf_dir), sf_dir)
    return x.groupBy("symbol", "date", "channel").agg(F.sum("rows").alias("rows"), F.first("status").alias("status"), F.min(F.length("sha256") == 64).alias("hashed"))


@query("cold_archive", f"select event_type as symbol, count(distinct {DAY}) as sources, count(*) as archived, 0::bigint as problems, 0::bigint as mismatched from ev group by event_type", ["ev"])
def cold_archive(spark, sf_dir):
    """Raw lines archived, counted against the manifest and compared line by line."""
    path = _raw_folder(spark, sf_dir)
    store = f"{shared(spark)}/archive"
    m.write_archive(spark, path, store)
    archive = spark.read.parquet(store).withColumn("source_key", _same_key("source_key"))
    again = f"{shared(spark)}/archive"
    m.write_archive(spark, path, again)
    restored = m.restore_check(archive, spark.read.parquet(again).withColumn("source_key", _same_key("source_key")))
    x = m.verify_archive(archive, _manifest(spark, path, sf_dir)).join(restored, "source_key").withColumn("symbol", m.partition_value(F.col("source_key"), "symbol"))
    day = m.partition_value(F.col("source_key"), "date")
    return x.groupBy("symbol").agg(F.count_distinct(day).alias("sources"), F.sum("archived").alias("archived"), F.count("problem").alias("problems"), F.sum("mismatched").alias("mismatched"))


view("mf", "select c_custkey as key, c_mktsegment as segment, c_nationkey as nation, case when c_custkey % 13 = 0 then 'unsealed_current' else 'sealed' end as status, case when c_custkey % 17 = 0 then 'No' else ' TRUE' end as sha_verified, case when c_custkey % 19 = 0 then null else '1' end as gzip_readable from customer")


@query("refresh_plan", "select segment, nation, count(*) as n_sources from mf where status = 'sealed' and sha_verified = ' TRUE' and gzip_readable = '1' and key % 10 <> 1 and (key % 10 = 0 or key % 7 = 0) group by all", ["mf"])
def refresh_plan(spark, sf_dir):
    """Partitions that new or changed verified sources touch."""
    from marketflow.operators.studies import manifest_diff

    c = a.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key")
    k = F.col("key")
    now = c.where(k % 10 != 1).select("key", F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("f"))
    changes = manifest_diff(c.where(k % 10 != 0).select("key", F.col("c_acctbal").alias("f")), now, "key", "f")
    manifest = c.select("key", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.when(k % 13 == 0, "unsealed_current").otherwise("sealed").alias("status"), F.when(k % 17 == 0, "No").otherwise(" TRUE").alias("sha_verified"), F.when(k % 19 != 0, "1").alias("gzip_readable"))
    return m.refresh_plan(changes, manifest, "key", ["segment", "nation"])


@query("incremental_silver", f"select event_type as symbol, {DAY} as date, count(*) as n, sum(1.0::double + k) as qty from ev group by all", ["ev"], "qty")
def incremental_silver(spark, sf_dir):
    """A table with stale days, of which only the affected partitions are written anew."""
    t = a.trades(spark, sf_dir).withColumn("date", F.date_format(F.timestamp_millis("event_ts_ms"), "yyyy-MM-dd")).select("symbol", "date", "history_id", "qty")
    path = f"{shared(spark)}/silver"
    stale = F.substring("date", 9, 2).cast("int") % 3 == 0
    t.where(~stale | (F.col("history_id") % 2 == 0)).write.partitionBy("symbol", "date").parquet(path)
    m.write_incremental(t.unionByName(t.where("history_id % 5 = 0")), t.where(stale), path, ["symbol", "date"], "/canonical")
    out = spark.read.schema("history_id long, qty double, symbol string, date string").parquet(path)
    return out.groupBy("symbol", "date").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("parse_listing", "select 'bucket/' || regexp_replace(url, '^[a-z]+://', '') || '#' || page_id as key, strlen(html) as size_bytes, case page_id % 3 when 0 then epoch_ms('2026-01-02 03:04:05'::timestamp) when 1 then epoch_ms('2026-01-02'::timestamp) end as mod_ms from pages")
def parse_listing(spark, sf_dir):
    """A text listing with times of several spellings."""
    p = a.table(spark, sf_dir, "pages")
    time = F.when(F.col("page_id") % 3 == 0, "2026-01-02T03:04:05Z").when(F.col("page_id") % 3 == 1, "2026-01-02").otherwise("soon")
    lines = p.select(F.concat_ws(";", F.concat_ws("#", F.regexp_replace("url", "^[a-z]+://", ""), "page_id"), F.octet_length("html"), time).alias("value"))
    folders = p.select(F.lit("some/folder/;0;2026-01-02").alias("value")).limit(1)
    return m.parse_listing(lines.unionByName(folders), "bucket/").select("key", "size_bytes", F.unix_millis("mod_time").alias("mod_ms"))


@query(
    "retention_plan",
    """select action as retention_action, count(*) as objects, sum(size)::bigint as bytes, bool_or(action = 'eligible_for_remote_expiry_after_review') as remote_delete_allowed from (select strlen(html) as size,
    case when page_id % 7 = 0 then 'retain_checksum_sidecar' when page_id % 11 = 0 then 'retain_non_raw_object' when page_id % 60 <= 7 then 'retain_recent_raw' when page_id % 60 < 30 then 'needs_compaction_before_raw_expiry'
    when page_id % 4 <> 0 and page_id % 5 <> 0 then 'eligible_for_remote_expiry_after_review' else 'blocked_missing_compaction_or_manifest' end as action from pages) group by action""",
)
def retention_plan(spark, sf_dir):
    """What may expire, and why not."""
    i = F.col("page_id")
    end = F.when(i % 7 == 0, ".jsonl.gz.sha256").when(i % 11 == 0, ".md").otherwise(".jsonl.gz")
    objects = a.table(spark, sf_dir, "pages").select(
        F.concat(i.cast("string"), end).alias("key"), F.octet_length("html").cast("long").alias("size_bytes"), F.timestamp_seconds(F.lit(1_770_000_000) - i % 60 * 86_400).alias("mod_time"),
        F.when(i % 4 != 0, "yes").otherwise("no").alias("compacted_verified"), F.when(i % 5 != 0, "1").alias("manifest_verified"),
    )
    plan = m.retention_plan(objects, F.timestamp_seconds(F.lit(1_770_000_000)), 7, 30)
    return plan.groupBy("retention_action").agg(F.count("*").alias("objects"), F.sum("size_bytes").alias("bytes"), F.bool_or("remote_delete_allowed").alias("remote_delete_allowed"))


@query("partition_stats", "select count(*) as symbols, sum(n)::bigint as symbol_days, min(a) as first_day, max(b) as last_day, count(*) filter (n >= 100) as long_history, count(*) filter (n <= 30) as short_history from (select user_id, count(distinct event_ts_ms // 86400000) as n, min(event_ts_ms // 86400000) as a, max(event_ts_ms // 86400000) as b from ev group by user_id)", ["ev"])
def partition_stats(spark, sf_dir):
    """Coverage of symbols and days."""
    return m.partition_stats(a.events(spark, sf_dir).withColumn("day", F.expr("event_ts_ms div 86400000")), "user_id", "day")


@query(
    "return_stream_faults",
    """select coalesce(f, 'none') as fault, count(*) as n, sum(case when f is null then value end) as total from (select value, case when k % 20 = 0 then 'timestamp' when k % 20 = 1 then 'symbol' when k % 20 = 2 then 'strategy' when k % 20 = 3 then 'baseline' when k % 20 = 4 then 'eligible' when k % 20 = 5 then 'not_eligible' end as f from ev) group by f""",
    ["ev"],
    "total",
)
def return_stream_faults(spark, sf_dir):
    """A return stream typed, with each row's first fault."""
    k = F.col("k") % 20
    x = a.events(spark, sf_dir).select(
        F.when(k == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), F.when(k == 1, " ").otherwise(F.col("event_type")).alias("symbol"),
        F.when(k == 2, "Infinity").otherwise(F.col("value").cast("string")).alias("strategy_return_bps"), F.when(k == 3, "NaN").otherwise(F.lit("1.5")).alias("baseline_return_bps"), F.when(k == 4, "perhaps").when(k == 5, "No").otherwise(" Yes").alias("eligible"),
    )
    x = m.return_stream_faults(m.required_columns(x, ["timestamp", "symbol", "eligible"]))
    return x.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("fault").isNull(), F.col("strategy_return_bps"))).alias("total"))


@query("key_faults", "select count(*) filter (c_custkey % 50 = 0) as blank_keys, count(*) filter (not coalesce(c_acctbal > 0, false)) as bad_c_acctbal, (select count(*) - count(distinct (case when c_custkey % 50 <> 0 then c_custkey // 2 end, c_custkey % 50 = 0)) from customer) as repeated_keys from customer")
def key_faults(spark, sf_dir):
    """Blank and repeated keys, and values that are not positive."""
    c = a.table(spark, sf_dir, "customer").withColumn("key", F.when(F.col("c_custkey") % 50 != 0, F.expr("c_custkey div 2")))
    return m.key_faults(c, ["key"], ["c_acctbal"])


@query("contract_diff", "select * from (select n as value, 'added' as change from (select distinct n_name as n from nation where n_nationkey % 3 <> 0 except select n_name from nation where n_nationkey % 4 <> 0) union all select n, 'removed' from (select distinct n_name as n from nation where n_nationkey % 4 <> 0 except select n_name from nation where n_nationkey % 3 <> 0))")
def contract_diff(spark, sf_dir):
    """Values that a set gained or lost."""
    n = a.table(spark, sf_dir, "nation")
    return m.contract_diff(n.where("n_nationkey % 4 <> 0"), n.where("n_nationkey % 3 <> 0"), "n_name")


@query("universe_membership", "select p_partkey % 500 as symbol, bool_or(p_partkey % 3 = 0) as local, bool_or(p_partkey % 5 = 0) as live_a, bool_or(p_partkey % 7 = 0) as live_b from part where p_partkey % 3 = 0 or p_partkey % 5 = 0 or p_partkey % 7 = 0 group by p_partkey % 500")
def universe_membership(spark, sf_dir):
    """Which sets hold a symbol."""
    p = a.table(spark, sf_dir, "part").withColumn("symbol", F.col("p_partkey") % 500)
    return m.membership({"local": p.where("p_partkey % 3 = 0"), "live_a": p.where("p_partkey % 5 = 0"), "live_b": p.where("p_partkey % 7 = 0")}, "symbol")
