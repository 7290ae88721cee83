"""Conversation prefix trie (13): every distinct sequence of first turns is a node, with its members, children and what sharing it saves.

A node is known by a chained 128-bit digest of its turns. Texts do not move: only digests and lengths of turns are shuffled,
once, so that a conversation's turns (and those it borrows) come one after another through a task, which keeps one
digest whatever the conversation's length.

A count-min sketch of all prefix digests then screens them. Its estimate never falls short, so an estimate of one proves that a
prefix is in one conversation alone; what follows it is as well, and such tails are emitted where they lie. Only
prefixes that may be shared (and the first node of each tail, for its parent) are shuffled and grouped exactly. The sketch has a fixed
largest size; with more prefixes than fit, fewer tails are proven and more rows are grouped, with the same result.

Sums over subtrees take no walk through the trie: the least member of a node is also the least member of every node below
it that it belongs to, so each node's share is credited to its least member, and a node adds up what its members
were credited, less what its own least member earned above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.common import crc32_sql, crc32_table_sql, written
from marketflow.llm.textarrays import raw


@dataclass(frozen=True)
class TrieConfig:
    """borrow: a conversation takes its first h turns from the one whose id ends its id's block of so many, h below `depth` by the CRC of
    its id; 0: all keep their own turns. cells: counters of the sketch for each prefix, rounded up to a power of two, within `bits`
    (of each of its two rows). hot: at most so many nodes are broadcast, those with most members. span: ids of a chunk of a node's list of ids."""

    borrow: int = 0
    depth: int = 6
    cells: int = 4
    bits: tuple[int, int] = (16, 25)
    hot: int = 5000
    span: int = 1 << 16


ROOT = bytes(16)
CHUNK = 1 << 16
PREFIXES = "conv_id long, depth long, node binary, parent binary, n long, source long, place long, is_end boolean"


def turns(convs: DataFrame, config: TrieConfig) -> DataFrame:
    """owner (the conversation whose first turns are borrowed), conv_id, h, turn, role, digest and code points (n) of every turn; without an id, none."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    c = F.col("conv_id").cast("long")
    h = F.crc32(c.cast("string").cast("binary")) % config.depth if config.borrow else F.lit(0)
    owner = c - c % config.borrow if config.borrow else c
    return convs.where("conv_id is not null").select(
        owner.alias("owner"), c.alias("conv_id"), h.cast("int").alias("h"), "turn", role.alias("role"),
        F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("digest"), F.length(text).cast("long").alias("n"),
    )


def prefixes(convs: DataFrame, config: TrieConfig) -> DataFrame:
    """A row for each conversation and depth, from the root on. source, place: the conversation and the place in it of the last turn.

    Turns go by turn (null first), then role, then digest.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]
        owner = conv = None
        lead: list[tuple[bytes, int]] = []
        place = depth = 0
        node, last = ROOT, None

        def put(is_end: bool) -> None:
            for column, value in zip(out, (*last, is_end), strict=True):
                column.append(value)

        def step(digest: bytes, n: int, source: int, at: int) -> None:
            nonlocal node, depth, last
            put(False)
            parent, node, depth = node, hashlib.blake2b(node + digest, digest_size=16).digest(), depth + 1
            last = conv, depth, node, parent, n, source, at

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)
            for x in out:
                x.clear()
            return batch

        names = ["conv_id", "depth", "node", "parent", "n", "source", "place", "is_end"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            for o, c, h, digest, n in zip(*(batch.column(k).to_pylist() for k in ("owner", "conv_id", "h", "digest", "n")), strict=True):
                if c != conv:
                    if conv is not None:
                        put(True)
                    if o != owner:
                        owner, lead = o, []
                    conv, place, depth, node = c, 0, 0, ROOT
                    last = c, 0, ROOT, None, 0, None, None
                    if c != o:
                        for k, (d, m) in enumerate(lead[:h]):
                            step(d, m, o, k + 1)
                place += 1
                if c == o and len(lead) < config.depth:
                    lead.append((digest, n))
                if c == o or place > h:
                    step(digest, n, c, place)
            if len(out[0]) > 20_000:
                yield flush()
        if conv is not None:
            put(True)
        yield flush()

    rows = turns(convs, config).repartition("owner").sortWithinPartitions("owner", F.col("conv_id") != F.col("owner"), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("owner", "conv_id", "h", "digest", "n").mapInArrow(of, PREFIXES)


def _cells(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each digest in either row of the sketch, by either half."""
    halves = raw(column)[0].view("<u8").reshape(-1, 2)
    return tuple((halves[:, k] >> np.uint64(64 - bits)).astype(np.int64) + (k << bits) for k in (0, 1))


def sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """Which counters of the sketch are above one, as packed bits: 2 ** bits / 4 bytes.

    Tasks count the cells that their own rows touch, up to two, and send what is not 0 in chunks; the chunks are added where they meet.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 << bits, np.uint8)
        for batch in batches:
            for cells in _cells(batch.column("node"), bits):
                cells = np.sort(cells)
                again = cells[1:][cells[1:] == cells[:-1]]
                counts[cells] = np.minimum(counts[cells] + 1, 2)
                counts[again] = 2
        for k in range(0, len(counts), CHUNK):
            there = np.flatnonzero(counts[k : k + CHUNK])
            if len(there):
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([there.astype("<u2").tobytes()]), pa.array([counts[k + there].tobytes()])], ["chunk", "cells", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, np.zeros(CHUNK, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(total > 1).tobytes()])], ["chunk", "several"])

        for batch in batches:
            for c, cells, counts in zip(*(batch.column(k) for k in ("chunk", "cells", "counts")), strict=True):
                if c.as_py() != chunk:
                    if chunk is not None:
                        yield done()
                    chunk, total = c.as_py(), np.zeros(CHUNK, np.uint8)
                at = np.frombuffer(cells.as_py(), "<u2")
                total[at] = np.minimum(total[at] + np.frombuffer(counts.as_py(), np.uint8), 2)
        if chunk is not None:
            yield done()

    parts = rows.select("node").mapInArrow(count, "chunk int, cells binary, counts binary")
    found = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, several binary")
    out = np.zeros((2 << bits) // 8, np.uint8)
    for r in found.collect():  # a fixed number of bits
        part = out[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8]
        part[:] = np.frombuffer(r.several, np.uint8)[: len(part)]
    return out


def screened(rows: DataFrame, several: np.ndarray, bits: int) -> DataFrame:
    """rows and kind: 0 may be shared, 1 the first node of a proven tail, 2 a node whose parent is proven as well, 3 a node that is not proven, as its cells are shared, though its parent is."""
    shared = rows.sparkSession.sparkContext.broadcast(several)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:

            def proven(column: pa.Array) -> np.ndarray:
                alone = np.zeros(len(column), bool)
                for cells in _cells(column, bits):
                    alone |= table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1 == 0
                return alone

            depth = batch.column("depth").to_numpy()
            own = proven(batch.column("node")) & (depth > 0)
            above = proven(batch.column("parent").fill_null(ROOT)) & (depth > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(own, np.where(above, 2, 1), np.where(above, 3, 0)).astype(np.int32))], [*batch.schema.names, "kind"])

    return rows.mapInArrow(of, PREFIXES + ", kind int")


def ends(members: DataFrame, config: TrieConfig) -> DataFrame:
    """node, ends_sha256 of all nodes where conversations end. members: node, conv_id.

    Ids of a span are sorted and joined in parallel; a node's chunks then pass through one task in order, which keeps a hash state.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            nodes, shas = [], []
            for x, ids in zip(batch.column("node").to_pylist(), batch.column("ids"), strict=True):
                if x != node:
                    if node is not None:
                        nodes.append(node)
                        shas.append(state.hexdigest())
                    node, state = x, hashlib.sha256(ids.as_py().encode())
                else:
                    state.update(b"," + ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(shas, pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    chunks = members.groupBy("node", F.floor(F.col("conv_id") / config.span).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(of, "node binary, ends_sha256 string")


def trie(rows: DataFrame, config: TrieConfig) -> DataFrame:
    """The nodes of prefixes(), which must be cheap to read again."""
    spark = rows.sparkSession
    total = rows.count()
    bits = min(max((config.cells * max(total, 1) - 1).bit_length(), config.bits[0]), config.bits[1])
    rows = written(screened(rows, sketch(rows.where("depth > 0"), bits), bits), "screened")
    shared, tails = rows.where("kind in (0, 3)"), rows.where("kind in (1, 2)")
    nodes = shared.groupBy("node").agg(F.min(F.struct("conv_id", "source", "place")).alias("x"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.max("n").alias("n"), F.max("kind").alias("kind"))
    nodes = written(nodes.select("node", "x.*", "n_convs", "depth", "parent", "n", "kind"), "nodes")
    below = nodes.where("depth > 0").select("parent").unionByName(tails.where("kind = 1").select("parent")).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    earned = (F.col("n_convs") - 1) * F.col("n")
    credit = nodes.select("conv_id", earned.alias("earned"), (F.col("n_children") == 0).cast("int").alias("leaf")).unionByName(tails.where("is_end").select("conv_id", F.lit(0).cast("long").alias("earned"), F.lit(1).alias("leaf")))
    credit = credit.groupBy("conv_id").agg(F.sum("earned").alias("earned"), F.max("leaf").alias("leaf"))
    sums = shared.select("node", "conv_id").join(credit, "conv_id").groupBy("node").agg(F.sum("earned").alias("earned"), F.sum("leaf").alias("n_leaves"))
    above = F.coalesce(F.sum(earned).over(Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = nodes.withColumn("above", above).join(sums, "node").join(ends(shared.where("is_end").select("node", "conv_id"), config), "node", "left")
    known = known.select(
        "conv_id", "depth", "parent", "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("earned") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "source", "place", "kind",
    )
    own = tails.select(
        "conv_id", "depth", "parent", F.lit(1).cast("long").alias("n_convs"), F.when(F.col("is_end"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(F.col("is_end"), F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"), "source", "place", "kind",
    )
    # parents with very many members, of which there are few, are broadcast, so that their children stay where they are
    line = max(1000, -(-shared.count() // config.hot))
    hot = spark.createDataFrame(nodes.where(F.col("n_convs") >= line).select("node", "conv_id").collect(), "parent binary, parent_conv_id long")
    rest = nodes.where(F.col("n_convs") < line).select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    asking = known.where("depth > 0 and kind = 0").unionByName(own.where("kind = 1")).drop("kind")
    told = asking.join(F.broadcast(hot), "parent").unionByName(asking.join(F.broadcast(hot), "parent", "left_anti").join(rest.hint("merge"), "parent"))
    # the parent of kinds 2 and 3 is in one conversation alone, so that one is theirs as well
    lone = known.where("kind = 3").unionByName(own.where("kind = 2")).drop("kind").withColumn("parent_conv_id", F.col("conv_id"))
    roots = known.where("depth = 0").drop("kind").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = told.unionByName(lone).unionByName(roots)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "source", "place")


def prefix_trie(convs: DataFrame, config: TrieConfig = TrieConfig()) -> DataFrame:
    """A row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    source and place, where its last turn is found (null for the root).

    Null roles and texts are empty. Rows without conv_id belong to no conversation. Equal turns of a conversation count as
    often as they are there; turns of one number go by role, then by a hash of role and text. Other columns are ignored; an empty
    table has no node, not even a root.
    """
    return trie(written(prefixes(convs, config), "prefixes"), config)


def with_turns(nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """nodes with role and text of their last turn; the root has none."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    order = Window.partitionBy("source").orderBy(F.col("turn").asc_nulls_first(), "role", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    own = convs.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("source"), "turn", role.alias("role"), text.alias("text"))
    return nodes.join(own.withColumn("place", F.row_number().over(order).cast("long")).drop("turn"), ["source", "place"], "left")


SQL = rf"""
with crc_table as ({crc32_table_sql()}),
convs as (select conv_id, {crc32_sql("conv_id::varchar")} % 6 as h from (select distinct conv_id from conversations where conv_id is not null), crc_table),
own as (
  select conv_id, td, n, row_number() over (partition by conv_id order by turn nulls first, role, td) as place
  from (select conv_id, turn, coalesce(role, '') as role, length(coalesce(text, '')) as n, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as td from conversations where conv_id is not null)
),
rebuilt as (
  select c.conv_id, 0 as part, o.place, td, n from convs c join own o on o.conv_id = c.conv_id - c.conv_id % 100 and o.place <= c.h
  union all
  select c.conv_id, 1, o.place, td, n from convs c join own o on o.conv_id = c.conv_id and o.place > c.h
),
prefixes as (
  select conv_id, row_number() over w as depth, string_agg(td, '') over w as key, n, count(*) over (partition by conv_id) as whole from rebuilt
  window w as (partition by conv_id order by part, place rows between unbounded preceding and current row)
  union all
  select conv_id, 0, '', 0, (select count(*) from rebuilt r where r.conv_id = c.conv_id) from convs c
),
nodes as (
  select key, depth, any_value(n) as n, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = whole), '')) as ends_sha256
  from prefixes group by key, depth
),
children as (select substr(key, 1, (length(key) - 64)::bigint) as key, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by 1, 2),
whole as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (key, depth)),
below as (
  select x.key, count(*) filter (y.n_children = 0) as n_leaves, sum((y.n_convs - 1) * y.n) as saved_tokens from whole x join whole y on starts_with(y.key, x.key) group by x.key
)
select w.conv_id, w.depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, b.n_leaves, b.saved_tokens::bigint as saved_tokens, w.ends_sha256
from whole w join below b using (key) left join nodes p on p.depth = w.depth - 1 and p.key = substr(w.key, 1, (length(w.key) - 64)::bigint) and w.depth > 0
"""
