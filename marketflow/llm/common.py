"""Shared helpers: tables, the shared folder, and the word pattern."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marketflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/marketflow"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, carry: list[str] = ()) -> tuple[DataFrame, int, bool]:
    """doc_id, doc, row, text and carry, in whose order of (doc, row) documents come, the number of bytes of all texts, and
    whether an id repeats.

    doc is doc_id, and the largest long where that is null. row tells the texts of one id apart: 0 where every row has an
    id of its own, else a hash of the text. The names doc and row must not be carried.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    ids = docs.select(doc.alias("doc"), F.octet_length("text").alias("n")).groupBy("doc").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    most, size = ids.agg(F.max("rows"), F.sum("n")).first()
    repeated = (most or 0) > 1
    row = F.xxhash64("text") if repeated else F.lit(0)
    return docs.select("doc_id", doc.alias("doc"), row.cast("long").alias("row"), "text", *carry), size or 0, repeated


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def train_fold(doc_id: Column) -> Column:
    """True for rows outside the held-out fold: crc32 of the id as text, mod 3, is not 1."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def crc32_table_sql() -> str:
    """DuckDB SQL of one row: the CRC of every byte, by its rule."""
    return "select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC of an expression's UTF-8 bytes, with t of crc32_table_sql()."""
    digits = f"list_transform(range(length(hex(encode({text}))) // 2), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1])), 4294967295)"
