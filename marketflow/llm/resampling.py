"""Target-distribution importance resampling (12): documents are drawn by how much likelier a target's n-grams make them.

Separators of a text collapse to single spaces; an overlapped regular-expression scan, bounded by lookarounds, then emits
the span of every run of n words, and the CRC of its bytes names a hashed feature. Counts of all documents and of the
target give each bucket a gain, the gains of a document's features its weight, and a hash of its id Gumbel noise, so that
the highest scores are a draw without replacement in proportion to the weights' exponentials.

Each text is scanned once: what the documents' pass writes is the counts by bucket of each document, and its tasks' sums
by bucket. The gains are one row a bucket, a fixed number. Ranks come from bins of the scores, not from one sorted task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.common import written

#: Every separator byte becomes a space, A-Z lower case; digits, a-z and bytes of longer characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class ResamplingConfig:
    """least, most: words of an n-gram. words: the fewest words of a document that may be drawn. percent: how many of those are. bins: parts that scores
    are ranked in; they change no result. held: counts that a task sums up at a time."""

    least: int = 1
    most: int = 1
    buckets: int = 10_000
    seed: int = 2024
    words: int = 20
    percent: int = 10
    bins: int = 256
    held: int = 4_000_000


def patterns(config: ResamplingConfig) -> list[regex.Pattern]:
    """One pattern for each n: n words, from a word's first byte to a word's last."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(config.least, config.most + 1)]


def scan(text: str | None, found: list[regex.Pattern], config: ResamplingConfig) -> tuple[np.ndarray, int]:
    """The bucket of every n-gram of a text, and the number of its words; a null text has none."""
    data = b" ".join((text or "").encode().translate(FOLD).split())
    crc = zlib.crc32
    parts = [np.fromiter((crc(m[0]) for m in p.finditer(data, overlapped=True)), np.uint32) for p in found]
    return np.concatenate(parts) % config.buckets, data.count(b" ") + bool(data)


def counted(rows: DataFrame, config: ResamplingConfig) -> DataFrame:
    """doc_id, tie, n_words, n_features, buckets, counts (little-endian, unsigned 32 bits) of every row. rows: doc_id, tie, text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = patterns(config)
        for batch in batches:
            words, features, names, counts = [], [], [], []
            for text in batch.column("text"):
                buckets, n = scan(text.as_py(), found, config)
                own, times = np.unique(buckets, return_counts=True)
                words.append(n)
                features.append(len(buckets))
                names.append(own.astype("<u4").tobytes())
                counts.append(times.astype("<u4").tobytes())
            columns = [batch.column("doc_id"), batch.column("tie"), *(pa.array(x, pa.int64()) for x in (words, features)), *(pa.array(x, pa.binary()) for x in (names, counts))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n_words", "n_features", "buckets", "counts"])

    return rows.mapInArrow(of, "doc_id long, tie long, n_words long, n_features long, buckets binary, counts binary")


def bucket_sums(features: DataFrame, config: ResamplingConfig) -> DataFrame:
    """bucket, n: each task sums its rows in an array of config.buckets numbers, Spark sums the tasks'."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(config.buckets, np.int64)
        for batch in batches:
            names, counts = [], []
            size = 0
            for a, b in zip(batch.column("buckets"), batch.column("counts"), strict=True):
                names.append(np.frombuffer(a.as_py(), "<u4"))
                counts.append(np.frombuffer(b.as_py(), "<u4"))
                size += len(names[-1])
                if size > config.held:
                    np.add.at(total, np.concatenate(names), np.concatenate(counts).astype(np.int64))
                    names, counts, size = [], [], 0
            if size:
                np.add.at(total, np.concatenate(names), np.concatenate(counts).astype(np.int64))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    return features.select("buckets", "counts").mapInArrow(of, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, config: ResamplingConfig) -> np.ndarray:
    """floor(1000 * ln of (smoothed share in the target / smoothed share in the corpus)) of every bucket."""
    both = []
    for sums in (raw, target):
        n = np.zeros(config.buckets)
        for r in sums.collect():  # at most config.buckets rows
            n[r.bucket] = r.n
        both.append(n)
    s, t = both
    all_s, all_t = s.sum() + config.buckets, t.sum() + config.buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 * standard Gumbel noise) by a hash of seed and id; a null id counts as the word null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, config: ResamplingConfig) -> DataFrame:
    """doc_id, tie, n_words, n_features, weight, score."""
    shared = features.sparkSession.sparkContext.broadcast(gain)  # config.buckets numbers

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            weight = np.array([int(gain[np.frombuffer(a.as_py(), "<u4")] @ np.frombuffer(b.as_py(), "<u4").astype(np.int64)) for a, b in zip(batch.column("buckets"), batch.column("counts"), strict=True)], np.int64)
            added = np.array([noise(i, config.seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            columns = [*(batch.column(c) for c in ("doc_id", "tie", "n_words", "n_features")), pa.array(weight), pa.array(weight + added)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n_words", "n_features", "weight", "score"])

    return features.mapInArrow(of, "doc_id long, tie long, n_words long, n_features long, weight long, score long")


def drawn(scores: DataFrame, config: ResamplingConfig) -> DataFrame:
    """scores and rank: 1, 2, 3 ... of the drawn rows, null for the others.

    The candidates fall into bins by approximate quantiles of the score; counts of bins say how many rank ahead of a bin, so
    each bin ranks its own rows, and bins beyond the draw none.
    """
    may = F.col("n_words") >= config.words
    n, bounds = scores.where(may).agg(F.count("*"), F.percentile_approx("score", [k / config.bins for k in range(1, config.bins)], 20 * config.bins)).first()
    wanted = config.percent * n // 100
    edges = sorted(set(bounds or []))
    spot = F.lit(0)
    if edges:  # how many bounds a score reaches, by binary search
        table = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
        spot = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= F.col("score"), at + s).otherwise(at))
    placed = scores.withColumn("bin", F.when(may, spot))
    ahead, total = {}, 0
    for b, c in sorted(placed.where(may).groupBy("bin").count().collect(), reverse=True):  # at most config.bins rows
        if total < wanted:
            ahead[b] = total
        total += c
    inside = F.col("bin") >= min(ahead, default=0) if ahead else F.lit(False)
    inside = F.coalesce(inside, F.lit(False))
    offset = F.get(F.array(*[F.lit(ahead.get(b, 0)).cast("long") for b in range(len(edges) + 1)]), F.col("bin"))
    order = Window.partitionBy("bin").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "tie")
    ranked = placed.where(inside).withColumn("rank", F.row_number().over(order).cast("long") + offset)
    out = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).unionByName(placed.where(~inside).withColumn("rank", F.lit(None).cast("long")))
    return out.drop("bin")


def resample(docs: DataFrame, target: DataFrame, config: ResamplingConfig = ResamplingConfig()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: a row per row of docs; rank is null where a row is not drawn.

    Null and empty texts have no words, a weight of 0 and are never drawn. Null ids share one noise and come last among
    equal scores; rows of one id go in the order of a hash of their texts. Other columns of docs and target are ignored.
    An empty target leaves every bucket its smoothed share; an empty docs gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    features = written(counted(rows, config), "features")
    goal = counted(target.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tie"), "text"), config)
    gain = gains(bucket_sums(features, config), bucket_sums(goal, config), config)
    return drawn(written(scored(features, gain, config), "scores"), config).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def texts(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of docs that are drawn, with their rank; doc_id must tell rows apart."""
    return docs.join(ranks.where("rank is not null").select("doc_id", "rank"), "doc_id")


#: The CRC goes byte by byte through a table of 256 entries that a rule builds.
SQL = r"""
with crc_table as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
),
folded as (
  select 0 as side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
  union all
  select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
),
grams as (select side, doc_id, unnest(words) as w from folded),
named as (
  select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(encode(w))) // 2), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1])), 4294967295) % 10000 as bucket
  from (select distinct w from grams), crc_table
),
counts as (select side, bucket, count(*) as n from grams join named using (w) group by 1, 2),
totals as (select sum(n) filter (side = 0) as S, sum(n) filter (side = 1) as T from counts),
gains as (
  select bucket, floor(1000 * ln((coalesce(sum(n) filter (side = 1), 0) + 1)::double * (any_value(coalesce(S, 0)) + 10000) / ((coalesce(sum(n) filter (side = 0), 0) + 1)::double * (any_value(coalesce(T, 0)) + 10000))))::bigint as gain
  from counts, totals group by bucket
),
weights as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from grams join named using (w) join gains using (bucket) where side = 0 group by doc_id),
scores as (
  select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5)::double / 4294967296)))::bigint as score
  from documents left join weights using (doc_id)
),
ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, 10 * count(*) over () // 100 as wanted from scores where n_features >= 20
)
select s.doc_id, s.n_features as n_words, s.n_features, s.weight, s.score, case when place <= wanted then place end::bigint as rank
from scores s left join ranked using (doc_id)
"""
