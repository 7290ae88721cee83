"""Quality rules (6): base counts, then a hashed n-gram log-likelihood ratio, all in Spark's own functions.

Target model: the multinomial over hashed uni- and bigrams of trusted documents. Raw model: the same
over every document. A document's score is the mean of ln(target / raw) over its n-grams; it is kept if that mean
reaches the threshold, the score that the share `keep` of all trusted documents reach that pass the base rules. Ratios are rounded to whole micro-nats, so a score is a sum of integers and the verdict does not depend on the
order of rows, partitions or reruns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.functions.quantiles import group_quantiles
from marketflow.llm.common import SPACE_CHARS, words, written

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RatioConfig:
    """buckets: size of the hashed model. keep: the share of the trusted documents that reach the threshold. threshold: where
    there are none of them."""

    buckets: int = 4096
    smoothing: float = 1.0
    keep: float = 0.999
    threshold: float = -0.03
    min_words: int = 50
    max_repeat_percent: int = 50


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def trigrams(hashes: Column) -> Column:
    """Hashes of the 3-word windows; empty with fewer words."""
    return F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)),
    )


def placed_repeats(grams: Column) -> Column:
    """The windows with their places, sorted by hash; null where none repeats. Keep it as a column of its own:
    a lambda that refers to an expression evaluates it for each element."""
    placed = F.array_sort(F.transform(grams, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), placed)


def repeat_words(placed: Column) -> Column:
    """Words that lie in a window found twice or more, from placed_repeats()."""
    again = F.filter(placed, lambda s, k: (s["h"] == F.get(placed, k - 1)["h"]) | (s["h"] == F.get(placed, k + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    return F.coalesce(F.when(placed.isNotNull(), F.size(covered)), F.lit(0)).cast("long")


def dup_lines(text: Column) -> Column:
    full = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    return (F.size(full) - F.size(F.array_distinct(full))).cast("long")


def features(hashes: Column, buckets: int) -> Column:
    """Bucket numbers of all uni- and bigrams."""
    pairs = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + 1))
    )
    return F.transform(F.concat(hashes, pairs), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def log_ratios(docs: DataFrame, trusted: DataFrame, config: RatioConfig) -> list[int]:
    """ln(target / raw) in micro-nats by bucket. The result has config.buckets numbers, whatever the corpus.

    docs: doc_id, text. trusted: distinct doc_id, not null; as it grows with the corpus, it is joined by merge at every size.
    """
    flagged = docs.select("doc_id", "text").join(trusted.withColumn("__t", F.lit(1)).hint("merge"), "doc_id", "left")
    counts = (
        flagged.select("__t", word_hashes(F.col("text")).alias("__h"))
        .select("__t", F.explode(features(F.col("__h"), config.buckets)).alias("b"))
        .groupBy("b")
        .agg(F.count("*").alias("raw"), F.count("__t").alias("target"))
    )
    model = docs.sparkSession.range(config.buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    found = {r.b: (r.raw, r.target) for r in model.collect()}
    a, n = config.smoothing, config.buckets
    raw, target = (sum(x[k] for x in found.values()) + a * n for k in (0, 1))
    return [round(1e6 * (math.log((found[b][1] + a) / target) - math.log((found[b][0] + a) / raw))) for b in range(n)]


def scored(docs: DataFrame, ratios: list[int], config: RatioConfig, carry: list[str] = ()) -> DataFrame:
    """doc_id, carry, the base counts, base_failed, score."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    text = F.col("text")
    staged = (
        docs.select("doc_id", F.struct(*carry).alias("__c") if carry else F.lit(None).alias("__c"), F.coalesce(text, F.lit("")).alias("text"))
        .withColumn("__h", word_hashes(text))
        .withColumn("__g", trigrams(F.col("__h")))
        .withColumn("__f", features(F.col("__h"), config.buckets))
        .withColumn("__p", placed_repeats(F.col("__g")))
    )
    n = F.size("__h").cast("long")
    total = F.aggregate("__f", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    # one struct through explode(): a filter on the verdict is not pushed below it, where each lambda would have the
    # text of its arrays' expressions in place of their columns and evaluate them for every element
    verdict = F.struct(
        n.alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        repeat_words(F.col("__p")).alias("n_repeat_words"),
        F.when(F.size("__f") > 0, total / (F.size("__f") * 1e6)).otherwise(0.0).alias("score"),
    )
    out = staged.select("doc_id", "__c", F.explode(F.array(verdict)).alias("__v")).select("doc_id", *[F.col("__c")[c].alias(c) for c in carry], "__v.*")
    failed = (F.col("n_words") < config.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * config.max_repeat_percent)
    return out.withColumn("base_failed", failed)


def calibrated(judged: DataFrame, trusted: DataFrame, config: RatioConfig) -> float:
    """The score that the share `keep` of the trusted documents reach, of those that pass the base rules. judged: rows of scored()."""
    good = judged.where("not base_failed").select("doc_id", "score").join(trusted.hint("merge"), "doc_id", "left_semi")
    found = group_quantiles(good, [], {"q": (F.col("score"), 1 - config.keep)}).first()
    return config.threshold if found is None or found[0] is None else found[0]


def judge(docs: DataFrame, trusted: DataFrame, config: RatioConfig = RatioConfig(), carry: list[str] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept: a row per row of docs.

    carry: columns of docs to return besides, as they are.

    A null or empty text has no words and fails the base rules. Extra columns of docs are ignored; rows with
    equal ids are judged one by one. Without trusted documents every ratio is ln(1 / buckets) less ln(raw), and
    the verdict still is defined.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    ratios = log_ratios(docs, ids, config)
    judged = written(scored(docs, ratios, config, carry), "quality-scores")  # once for the threshold and for the verdicts
    bound = calibrated(judged, ids, config)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= bound))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that the labels mark as good."""
    return labels.where("quality = 1").select("doc_id")
