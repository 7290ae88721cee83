"""Exact top-k search (11): an impact-ordered index of integer vectors, searched score at a time.

A shard of the index holds some thousand vectors as posting segments: those vectors whose component in one dimension has one
sign and one quantised size (its impact). Segments go by descending impact. A block of queries is searched together:
each segment adds impact times the queries' components to the accumulators of its vectors. What is still missing of a
score is at most the query's length times the length of what is missing of the vector (Cauchy-Schwarz), which the index
holds for every vector at every checkpoint, quantisation included. At a checkpoint, vectors that cannot reach a
query's k-th best score found so far are ruled out. The scan stops only when few are left, and all of those are
scored exactly.

A task takes shard after shard with the same queries and keeps their best k, so its bounds tighten; it returns k rows a
query. Queries are sent to the tasks in blocks of a fixed size, a job each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.common import written

#: Components are held to this size, so that scores of vectors of up to 2 ** 15 dimensions fit in a long.
LARGEST = (1 << 24) - 1


@dataclass(frozen=True)
class TopKConfig:
    """k: results a query. scale: components are floor(scale * x). every: rows whose id it divides are queries. shard: vectors of a shard, about; block: queries that
    share accumulators; job: queries sent to the tasks at once; levels: sizes that a segment tells apart, at most; checks: shares of the postings after which bounds are
    tested; few: share of vectors still possible at which the scan ends. But for k, scale and every, none changes a result."""

    k: int = 20
    scale: int = 64
    every: int = 20
    shard: int = 8192
    block: int = 256
    job: int = 1 << 16
    levels: int = 255
    checks: tuple[float, ...] = (0.45, 0.6, 0.75, 0.9)
    few: float = 0.02


def quantised(rows: DataFrame, config: TopKConfig) -> DataFrame:
    """vec_id, v (floor(scale * x), held to LARGEST) of the vectors that take part."""
    v = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * config.scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy()
    wide = int(sizes.max()) if len(sizes) else 0
    if len(flat) == wide * len(sizes):
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Shard:
    """Vectors and their posting segments, by descending impact; with the length of what is missing at every checkpoint."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, config: TopKConfig):
        self.ids, self.vectors = ids, vectors
        n, wide = vectors.shape
        size = np.abs(vectors.astype(np.int64))
        step = max(1, -(-int(size.max(initial=0)) // config.levels))
        level = size // step
        doc, dim = np.nonzero(level)
        found = level[doc, dim] * np.sign(vectors[doc, dim])
        order = np.lexsort((doc, dim, found, -np.abs(found)))
        doc, dim, found = doc[order].astype(np.int32), dim[order], found[order]
        new = np.ones(len(doc), bool)
        new[1:] = (dim[1:] != dim[:-1]) | (found[1:] != found[:-1])
        begin = np.flatnonzero(new)
        self.docs, self.begin = doc, np.append(begin, len(doc)).astype(np.int32)
        self.dims, self.impacts = dim[begin].astype(np.int32), (found[begin] * step).astype(np.int32)
        # the squared length that is missing: all of it, less what segments bring (all but the error of the impact)
        squares, ends, left = (size.astype(np.float64) ** 2).sum(axis=1), [], []
        at = 0
        for share in (*config.checks, 1.0):
            end = int(np.searchsorted(self.begin, share * len(doc)))
            a, b = int(self.begin[at]), int(self.begin[end])
            whole, error = size[doc[a:b], dim[a:b]].astype(np.float64), size[doc[a:b], dim[a:b]] - np.abs(found[a:b]) * step
            squares = squares - np.bincount(doc[a:b], whole**2 - error.astype(np.float64) ** 2, n)
            at = end
            ends.append(end)
            left.append(np.sqrt(np.maximum(squares, 0)))
        self.ends, self.left = np.array(ends, np.int32), np.array(left, np.float64).reshape(len(ends), n)

    FIELDS = {"ids": np.int64, "vectors": np.int32, "docs": np.int32, "begin": np.int32, "dims": np.int32, "impacts": np.int32, "ends": np.int32, "left": np.float64}

    def row(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, k), t).tobytes() for k, t in self.FIELDS.items()]

    @classmethod
    def of(cls, row: dict) -> Shard:
        out = cls.__new__(cls)
        for k, t in cls.FIELDS.items():
            setattr(out, k, np.frombuffer(row[k], t))
        n = len(out.ids)
        out.vectors, out.left = out.vectors.reshape(n, -1) if n else out.vectors.reshape(0, 0), out.left.reshape(-1, n)
        return out


def exact(vectors: np.ndarray, rows: np.ndarray, queries: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of vectors[rows] and queries[cols] in whole numbers."""
    wide = min(vectors.shape[1], queries.shape[1])
    out = np.zeros(len(rows), np.int64)
    for i in range(0, len(rows), 1 << 14):
        a, b = vectors[rows[i : i + (1 << 14)], :wide].astype(np.int64), queries[cols[i : i + (1 << 14)], :wide].astype(np.int64)
        out[i : i + (1 << 14)] = np.einsum("ij,ij->i", a, b)
    return out


class Best:
    """The k best (score, id) of each query so far, by descending score, then ascending id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.least[query[full]] = score[full]


def search(shard: Shard, ids: np.ndarray, queries: np.ndarray, best: Best, config: TopKConfig, first: int = 0) -> None:
    """Adds the shard's members of the top k of some queries to best, where the first of them has the number `first`."""
    n, m = len(shard.ids), len(ids)
    wide = min(shard.vectors.shape[1], queries.shape[1])
    if not n or not m:
        return
    components = np.ascontiguousarray(queries[:, :wide].T)
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    most = np.abs(queries.astype(np.float64)).sum(axis=1).max() * np.abs(shard.vectors).max(initial=0)
    kind = np.int32 if most < (1 << 31) - 1 else np.int64
    sums, components = np.zeros((n, m), kind), components.astype(kind)
    least = best.least[first : first + m].copy()
    at = 0
    for check, end in enumerate(shard.ends.tolist()):
        for s in range(at, end):
            d = shard.dims[s]
            if d < wide:
                sums[shard.docs[shard.begin[s] : shard.begin[s + 1]]] += components[d] * kind(shard.impacts[s])
        at = end
        if check == 0 and (least == np.iinfo(np.int64).min).any():
            # any k vectors' exact scores bound the k-th best from below; those that lead now bound it well
            some = min(n, config.k + 1)
            rows = np.argpartition(np.ascontiguousarray(sums.T), n - some, axis=1)[:, n - some :]
            cols = np.repeat(np.arange(m), some)
            score = exact(shard.vectors, rows.ravel(), queries, cols)
            score = np.where(shard.ids[rows.ravel()] == ids[cols], np.iinfo(np.int64).min, score).reshape(m, some)
            if some > config.k:
                least = np.maximum(least, np.sort(score, axis=1)[:, some - config.k])
        # a margin of one for the rounding of the bound
        need = least.astype(np.float64) - 1
        possible = sums + shard.left[check][:, None] * (length * (1 + 1e-9))[None, :] >= need[None, :]
        if possible.sum() <= config.few * n * m:
            break
    rows, cols = np.nonzero(possible)
    other = shard.ids[rows] != ids[cols]
    rows, cols = rows[other], cols[other]
    score = exact(shard.vectors, rows, queries, cols)
    good = score >= least[cols]
    best.add(cols[good] + first, score[good], shard.ids[rows[good]])


def index(vectors: DataFrame, config: TopKConfig) -> DataFrame:
    """Shards of the vectors of quantised(), a row each, as a table in the shared folder."""
    shards = max(1, -(-vectors.count() // config.shard))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def built() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            shard = Shard(whole.column("vec_id").combine_chunks().to_numpy(), _matrix(whole.column("v").combine_chunks()), config)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard.row()], list(Shard.FIELDS))

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= 2 * config.shard:
                yield built()
                held, size = [], 0
        if size:
            yield built()

    return written(vectors.repartition(shards).mapInArrow(of, ", ".join(f"{k} binary" for k in Shard.FIELDS)), "index")


def search_all(shards: DataFrame, asked: pa.Table, config: TopKConfig) -> DataFrame:
    """query (number), query_id, rank, vec_id, score of some queries (vec_id, v), which are sent to every task."""
    v = asked.column("v").combine_chunks()
    shared = shards.sparkSession.sparkContext.broadcast((asked.column("vec_id").to_numpy(), _matrix(v)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = Best(len(ids), config.k)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.of(row)
                for i in range(0, len(ids), config.block):
                    search(shard, ids[i : i + config.block], queries[i : i + config.block], best, config, i)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(ids[best.query]), pa.array(best.id), pa.array(best.score)], ["query", "query_id", "vec_id", "score"])

    found = shards.mapInArrow(of, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.k)


def top_k(rows: DataFrame, config: TopKConfig = TopKConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every other row for each query.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Vectors of different
    lengths are compared as far as both go; components beyond LARGEST count as LARGEST. Ties go to the smaller vec_id.
    Queries are the distinct vectors of the ids that `every` divides; rows of the query's own id are no candidates. Rows of
    one other id each count. Other columns are ignored; an empty table has no result.
    """
    vectors = quantised(rows, config)
    shards = index(vectors, config)
    asked = written(vectors.where(F.col("vec_id") % config.every == 0).distinct(), "queries")
    jobs = max(1, -(-asked.count() // config.job))
    parts = []
    for job in range(jobs):
        some = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(jobs)) == job).orderBy("vec_id", "v")
        parts.append(written(search_all(shards, some.toArrow(), config), "found"))  # about config.job queries
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")


SQL = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)
),
scores as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from vectors q join vectors c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 20
"""
