"""Document fingerprints (10): a Merkle tree of pieces, paragraphs and sections for each text, in Spark's own functions.

A text is cut into sections at blank lines, sections into paragraphs at line ends, paragraphs into pieces of up to
four words that do not pass the end of a sentence. A piece's hash is its md5; a paragraph's is the md5 of its pieces'
hashes, a section's that of its paragraphs', and the root is the sha256 of the sections' hashes. Equal texts have
equal roots; where roots differ, the sections and paragraphs whose hashes differ hold the edits.

Likeness of two trees: 2 * common leaves / leaves of both, over distinct leaf hashes; two trees without leaves are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to four words, of which only the last may end a sentence, with the spaces after them; or spaces alone.
PIECE = r"(?:[^ ]*[^ .!?] +){0,3}[^ ]+ *| +"


def cut(text: Column) -> Column:
    """The pieces of a text: sections of paragraphs of pieces."""
    return F.transform(
        F.split(text, "\n\n"),
        lambda section: F.transform(F.split(section, "\n"), lambda paragraph: F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0))),
    )


def leaf_hashes(text: Column) -> Column:
    """The tree's lowest level: md5 of each piece, by section and paragraph. Keep it as a column of its own."""
    return F.transform(cut(text), lambda section: F.transform(section, lambda paragraph: F.transform(paragraph, lambda piece: F.md5(piece))))


def paragraph_hashes(tree: Column) -> Column:
    return F.transform(tree, lambda section: F.transform(section, lambda leaves: F.md5(F.array_join(leaves, ""))))


def section_hashes(tree: Column) -> Column:
    return F.transform(paragraph_hashes(tree), lambda paragraphs: F.md5(F.array_join(paragraphs, "")))


def root(tree: Column) -> Column:
    return F.sha2(F.array_join(section_hashes(tree), ""), 256)


def leaves(tree: Column) -> Column:
    """Distinct leaf hashes."""
    return F.array_distinct(F.flatten(F.flatten(tree)))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct leaves."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) * 2.0 / both)


def differing(a: Column, b: Column) -> Column:
    """Places (from 0) of the hashes of array a that array b lacks; both are columns of section or paragraph hashes."""
    return F.transform(F.array_except(a, b), lambda h: F.array_position(a, h) - 1)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, sections, paragraphs (their hashes): a row per row of docs; a null text is empty."""
    tree = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__tree", leaf_hashes(F.col("text")))
    return tree.select("doc_id", root(F.col("__tree")).alias("fingerprint"), section_hashes(F.col("__tree")).alias("sections"), paragraph_hashes(F.col("__tree")).alias("paragraphs"))


def reached(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds a value reaches, by binary search; 0 for null."""
    edges = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(edges, at + s - 1) <= value, at + s).otherwise(at))


def with_next(docs: DataFrame, per_range: int = 1000, max_ranges: int = 50_000) -> DataFrame:
    """doc_id, text and next_text, the text of the next row by (doc_id, text); after the last row comes the first.

    Rows are dealt to ranges of ids of about per_range rows, so the text is shuffled once; each range also gets the
    first row of the next range, so at most max_ranges rows are copied. The approximate bounds only set how even the
    ranges are. A range holds whole ids: only rows that repeat one id share a task for sure. Null ids come first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(max_ranges, -(-n // per_range)))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, 10 * ranges).alias("b")).first().b if cuts else []
    bounds = sorted(set(bounds or []))
    dealt = rows.withColumn("__range", reached(F.col("doc_id"), bounds) if bounds else F.lit(0))
    heads = dealt.groupBy("__range").agg(F.min(F.struct("doc_id")).alias("__head"))
    in_order = Window.orderBy("__range")
    copies = heads.select(
        F.col("__range").alias("__from"),
        F.col("__head.doc_id").alias("__id"),
        F.coalesce(F.lag("__range").over(in_order), F.max("__range").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__to"),
    )  # a row a range
    first = dealt.join(F.broadcast(copies), (dealt["__range"] == copies["__from"]) & dealt["doc_id"].eqNullSafe(copies["__id"]))
    first = first.groupBy("__to").agg(F.min(F.struct("doc_id", "text")).alias("s"))
    both = dealt.withColumn("__copy", F.lit(False)).unionByName(first.select("s.doc_id", "s.text", F.col("__to").alias("__range"), F.lit(True).alias("__copy")))
    order = Window.partitionBy("__range").orderBy("__copy", "doc_id", "text")
    return both.withColumn("next_text", F.lead("text").over(order)).where("not __copy").select("doc_id", "text", "next_text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document, a row per row of docs.

    Edited: the last floor(n_chars / 2) code points replaced by the first as many of the next text. Null texts are
    empty; one row alone is its own next; an empty table gives an empty result; other columns are ignored.
    """
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    staged = (
        with_next(docs)
        .withColumn("n_chars", size.cast("long"))
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half)))
        .withColumn("__a", leaf_hashes(F.col("text")))
        .withColumn("__b", leaf_hashes(F.col("edited")))
        .withColumn("__c", leaf_hashes(F.col("next_text")))
        .withColumn("__la", leaves(F.col("__a")))
    )
    return staged.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("__a")).alias("fingerprint"),
        root(F.col("__b")).alias("edited_fingerprint"),
        likeness(F.col("__la"), leaves(F.col("__b"))).alias("near_edited"),
        likeness(F.col("__la"), leaves(F.col("__c"))).alias("near_next"),
    )


#: DuckDB SQL for compare_edits().
SQL = r"""
with rows_ as (select doc_id, coalesce(text, '') as text from documents),
nexts as (select doc_id, text, coalesce(lead(text) over w, first_value(text) over w) as next_text from rows_ window w as (order by doc_id nulls first, text rows between unbounded preceding and unbounded following)),
edits as (select *, substring(text, 1, (length(text) - length(text) // 2)::bigint) || substring(next_text, 1, (length(text) // 2)::bigint) as edited from nexts),
trees as (
  select *,
    list_transform(string_split(text, e'\n\n'), lambda s: list_transform(string_split(s, e'\n'), lambda p: list_transform(regexp_extract_all(p, '(?:[^ ]*[^ .!?] +){0,3}[^ ]+ *| +'), lambda x: md5(x)))) as a,
    list_transform(string_split(edited, e'\n\n'), lambda s: list_transform(string_split(s, e'\n'), lambda p: list_transform(regexp_extract_all(p, '(?:[^ ]*[^ .!?] +){0,3}[^ ]+ *| +'), lambda x: md5(x)))) as b,
    list_transform(string_split(next_text, e'\n\n'), lambda s: list_transform(string_split(s, e'\n'), lambda p: list_transform(regexp_extract_all(p, '(?:[^ ]*[^ .!?] +){0,3}[^ ]+ *| +'), lambda x: md5(x)))) as c
  from edits),
flat as (
  select *, list_distinct(flatten(flatten(a))) as la, list_distinct(flatten(flatten(b))) as lb, list_distinct(flatten(flatten(c))) as lc from trees)
select doc_id, length(text)::bigint as n_chars, sha256(edited) as edited_sha256,
  sha256(list_aggregate(list_transform(a, lambda s: md5(coalesce(list_aggregate(list_transform(s, lambda p: md5(coalesce(list_aggregate(p, 'string_agg', ''), ''))), 'string_agg', ''), ''))), 'string_agg', '')) as fingerprint,
  sha256(list_aggregate(list_transform(b, lambda s: md5(coalesce(list_aggregate(list_transform(s, lambda p: md5(coalesce(list_aggregate(p, 'string_agg', ''), ''))), 'string_agg', ''), ''))), 'string_agg', '')) as edited_fingerprint,
  case when len(la) + len(lb) = 0 then 1.0::double else len(list_intersect(la, lb)) * 2.0::double / (len(la) + len(lb)) end as near_edited,
  case when len(la) + len(lc) = 0 then 1.0::double else len(list_intersect(la, lc)) * 2.0::double / (len(la) + len(lc)) end as near_next
from flat
"""
