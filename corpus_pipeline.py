"""A corpus pipeline in five stages, each over all that its predecessor kept.

quality rules -> line dedup -> near-dedup -> mixing -> SentencePiece ids. Stages write Parquet into the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketflow.llm import stages
from marketflow.llm.common import documents, written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_duplicates),
    ("mixing", stages.mix_sources),
    ("sentencepiece", stages.piece_ids),
]

#: Hash functions, signatures and Viterbi search have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
