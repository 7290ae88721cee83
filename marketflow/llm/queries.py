"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.llm import fingerprints, language_id, line_dedup, mixing, near_dedup, pieces, prefix_trie, quality_model, resampling, suffix_dedup, token_files, top_k
from marketflow.llm import quality_rules as rules
from marketflow.llm.common import documents, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), near_dedup.NearConfig(width=2))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeats(documents(spark, sf_dir))
    left = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_chunks", "n_removed", "n_removed_lines", F.length(left).cast("long").alias("kept_chars"), F.sha2(left, 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir), rules.trusted_ids(table(spark, sf_dir, "labels")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = token_files.TokenConfig(public_tokenizers.path("byte_bpe_50k.json"))
    path = token_files.folder(spark)
    token_files.write(documents(spark, sf_dir), path, config)
    return token_files.digests(token_files.read(spark, path, config.stride, packed=True))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(documents(spark, sf_dir))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), prefix_trie.TrieConfig(borrow=100)).drop("source", "place")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_near_dedup, op2_quality_model, op3_sentencepiece, op4_language_id, op5_line_dedup, op6_quality_rules, op7_token_files, op8_mixing, op9_suffix_dedup, op10_fingerprints, op11_top_k, op12_resampling, op13_prefix_trie]
    return {**{f.__name__: f for f in found}, "pipeline": pipeline}


def oracles() -> dict[str, str]:
    return {"op8_mixing": mixing.SQL, "op10_fingerprints": fingerprints.SQL, "op11_top_k": top_k.SQL, "op12_resampling": resampling.SQL, "op13_prefix_trie": prefix_trie.SQL}
