"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.llm import line_dedup as lines
from marketflow.llm import mixing, near_dedup, pieces
from marketflow.llm import quality_rules as rules
from marketflow.llm.common import DOC_COLUMNS, table

PIECE_MODEL = "piece_bpe_32k.model"


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*DOC_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the rules keep."""
    verdicts = rules.judge(docs.select(*DOC_COLUMNS), rules.trusted_ids(table(spark, sf_dir, "labels")), carry=DOC_COLUMNS[1:])
    return verdicts.where("kept").select(*DOC_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the chunks of lines that occur earlier; a text of which nothing is left is empty."""
    return _as_documents(lines.remove_repeats(docs.select(*DOC_COLUMNS), carry=["lang", "source"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the least id of each group of near copies, and all rows without an id."""
    gone = near_dedup.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.select(*DOC_COLUMNS).join(gone, "doc_id", "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it is taken whole, then its words of the blocks that are taken once more."""
    return _as_documents(mixing.texts(mixing.mix(docs, carry=["text", "lang", "source"])))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, ids, round_trip of every row."""
    return pieces.encode(docs, public_tokenizers.path(PIECE_MODEL))
