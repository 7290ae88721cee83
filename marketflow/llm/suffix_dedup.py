"""Suffix-array dedup (9): bytes covered by a string of `length` bytes that also starts earlier are removed.

Whole suffix arrays need eight bytes and more for each byte of text, beyond the disk budget, so the arrays are sparse: of
every window of `length` bytes the suffix at its minimizer is indexed, the place in it whose `gram` bytes hash least.
Equal windows have it at the same offset, so no match is lost. The windows of one minimizer cover a span of up to about
2 * length bytes. An entry of an array is: key (hash of the suffix's first `gram` bytes), span (hash of the span's bytes, by
another polynomial), the span's document and start, and its number of windows; arrays are sorted by key, then span.

1. Each task makes the sorted array of its documents, in batches of bounded size. What repeats inside a batch is settled
   there, as one row per long match; the first copies go to shards by ranges of keys.
2. A shard keeps a logarithmic family of levels. A new batch is merge-scanned against every level: equal spans are
   matches of length or more bytes, of which the earliest stays in the levels and the others are wholly covered. Then levels
   of about equal size are merged.
3. What is left of a key with several spans is compared window by window on its bytes, and runs of equal windows are
   removed after a comparison of their bytes. Keys with very many spans ("crowds") are dealt out window by window instead, in
   the same shuffle, so that no key has to fit in one task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.llm.common import numbered, shared_dir, written
from marketflow.llm.textarrays import Hashes, mix, raw, slices


@dataclass(frozen=True)
class SuffixConfig:
    """batch_rows: entries of a batch; shard_rows: entries of a shard, on average; crowd: spans of a key, in a batch or in a
    shard, above which it is dealt out by windows. They bound memory and change no result."""

    length: int = 100
    gram: int = 24
    batch_rows: int = 1 << 21
    shard_rows: int = 1 << 20
    crowd: int = 1 << 14


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of width values, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


class Spans:
    """The minimizers of some texts: for each its key, row, first window's start, number of windows, span hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, config: SuffixConfig):
        hashes = Hashes(data)
        g = config.gram
        grams = hashes.grams(g)
        n = len(grams)
        low = np.uint64(0xFFFFFFFF)
        least = sliding_min((grams & ~low) | np.arange(n, dtype=np.uint64), config.length - g + 1)
        at = (least & low).astype(np.int64)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
        inside = np.arange(len(at)) + config.length <= offsets[1:][row] if len(at) else np.zeros(0, bool)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new & inside)
        ends = np.flatnonzero(np.append(new[1:], True) | ~np.append(inside[1:], False)) if len(at) else begin
        ends = ends[inside[ends]]
        self.row, self.start, self.windows = row[begin], begin, ends - begin + 1
        self.key = mix(grams[at[begin]])  # the least hashes are small: mixed, their upper bits are even
        self.span = hashes.of(begin, ends + config.length)


FIELDS = {"key": np.uint64, "span": np.uint64, "doc": np.int64, "row": np.int64, "start": np.int64, "windows": np.int64}


class Entries:
    """Columns of entries, as an array sorted by (key, span) or any part of one."""

    def __init__(self, **columns: np.ndarray):
        self.columns = columns

    def __getattr__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.columns["key"])

    def take(self, rows: np.ndarray) -> Entries:
        return Entries(**{k: v[rows] for k, v in self.columns.items()})

    @staticmethod
    def join(parts: list[Entries]) -> Entries:
        return Entries(**{k: np.concatenate([np.zeros(0, kind), *(p.columns[k] for p in parts)]) for k, kind in FIELDS.items()})

    def in_order(self) -> Entries:
        return self.take(np.lexsort((self.start, self.row, self.doc, self.span, self.key)))


def heads(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the row before it in any column; true for the first."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def first_of(e: Entries) -> np.ndarray:
    """Whether a row of entries in order is the first of its key and span."""
    return heads(e.key, e.span)


def spans_per_key(keys: np.ndarray) -> np.ndarray:
    """For each of some sorted keys how many there are of it."""
    sizes = np.diff(np.append(np.flatnonzero(heads(keys)), len(keys)))
    return np.repeat(sizes, sizes)


def merge_scan(level: Entries, batch: Entries) -> np.ndarray:
    """Place in level of the entry with the same key and span, or -1.

    Both arrays are merged by key in one stable pass over their sorted runs; where a key is in both, the spans of the two are
    merged in the same way, and equal neighbours from either side are matches.
    """
    out = np.full(len(batch), -1)
    n = len(level)
    if not n or not len(batch):
        return out
    keys = np.concatenate([level.key, batch.key])
    order = np.argsort(keys, kind="stable")  # two sorted runs: a merge, in which the level's entries of a key come first
    run = np.cumsum(heads(keys[order]))
    mine = order >= n
    both = np.zeros(int(run[-1]) + 1, bool)
    both[run[mine]] = True
    has = np.zeros(len(both), bool)
    has[run[~mine]] = True
    some = np.flatnonzero((both & has)[run])
    at, group = order[some], run[some]
    span = np.where(at < n, level.span[np.minimum(at, n - 1)], batch.span[np.maximum(at - n, 0)])
    inner = np.lexsort((at, span, group))  # the level's entry of a span comes before the batch's
    at, group, span = at[inner], group[inner], span[inner]
    new = heads(group, span)
    first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    hit = (at >= n) & (first < n)
    out[at[hit] - n] = first[hit]
    return out


class LevelFamily:
    """Sorted arrays of geometric sizes, together with at most one entry for each key and span: its earliest."""

    def __init__(self):
        self.levels: list[Entries] = []

    def add(self, batch: Entries) -> Entries:
        """Scan a batch against all levels, keep what is new; the entries that turn out to be later copies."""
        copies = []
        for level in self.levels:
            at = merge_scan(level, batch)
            hit = np.flatnonzero(at >= 0)
            mine, theirs = batch.take(hit), level.take(at[hit])
            early = (mine.doc < theirs.doc) | (mine.doc == theirs.doc) & ((mine.row < theirs.row) | (mine.row == theirs.row) & (mine.start < theirs.start))
            same = (mine.doc == theirs.doc) & (mine.row == theirs.row) & (mine.start == theirs.start)
            copies += [mine.take(~early & ~same), theirs.take(early)]
            for name in ("doc", "row", "start"):
                level.columns[name][at[hit[early]]] = mine.columns[name][early]
            batch = batch.take(at < 0)
        self.levels.append(batch.take(np.arange(len(batch))))
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            self.levels[-2:] = [Entries.join(self.levels[-2:]).in_order()]
        return Entries.join(copies)

    def whole(self) -> Entries:
        return Entries.join(self.levels).in_order()


def long_matches(e: Entries, length: int) -> tuple[np.ndarray, ...]:
    """doc, row, a, b of the runs of bytes that some spans cover together."""
    order = np.lexsort((e.start, e.row, e.doc))
    doc, row, a = e.doc[order], e.row[order], e.start[order]
    b = a + e.windows[order] + (length - 1)
    # ends of a document's spans never decrease, so a span that starts beyond the last end starts a run
    new = heads(doc, row)
    new[1:] |= a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return doc[first], row[first], a[first], b[np.append(first, len(a))[1:] - 1]


#: Rows on their way to a shard: entries of its keys, keys of it that are a crowd, entries of a crowd, settled matches.
ENTRIES, CROWDS, CROWDED, MATCHES = range(4)
BATCH = "shard int, batch long, kind int, n int, " + ", ".join(f"{k} binary" for k in FIELDS)
FOUND = "doc long, row long, start long, size int, key long, crowd boolean"


def _narrow(x: np.ndarray) -> bytes:
    """Integers as bytes of the least width that holds them."""
    if not len(x) or not x.any():
        return b""
    for kind in (np.uint8, np.uint16, np.uint32):
        if x.min() >= 0 and x.max() <= np.iinfo(kind).max:
            return x.astype(kind).tobytes()
    return x.tobytes()


def _wide(data: bytes, n: int, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(n, kind)
    width = len(data) // n
    return np.frombuffer(data, kind if width == 8 else f"u{width}").astype(kind)


def _packed(shards: np.ndarray, batch: int, kind: int, e: Entries) -> pa.RecordBatch:
    """A row for each run of equal shards."""
    edges = np.flatnonzero(heads(shards))
    ends = np.append(edges, len(shards))[1:]
    columns = [pa.array(shards[edges].astype(np.int32)), pa.array(np.full(len(edges), batch)), pa.array(np.full(len(edges), kind, np.int32)), pa.array((ends - edges).astype(np.int32))]
    for name in FIELDS:
        x = e.columns.get(name, np.zeros(len(shards), np.int64))
        columns.append(pa.array([_narrow(x[a:b]) for a, b in zip(edges, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["shard", "batch", "kind", "n", *FIELDS])


def batch_rows(e: Entries, batch: int, shards: int, config: SuffixConfig) -> Iterator[pa.RecordBatch]:
    """The array of a batch, cut into shards, and the matches inside it."""
    e = e.in_order()
    e = e.take(heads(e.key, e.span, e.doc, e.row, e.start))  # rows of one id and text are one document
    first = first_of(e)
    doc, row, a, b = long_matches(e.take(~first), config.length)
    e = e.take(first)
    shard = shard_of(e.key, shards)
    crowded = spans_per_key(e.key) > config.crowd
    yield _packed(shard[~crowded], batch, ENTRIES, e.take(~crowded))
    if crowded.any():
        keys, at = np.unique(e.key[crowded], return_index=True)
        yield _packed(shard[crowded][at], batch, CROWDS, Entries(key=keys))
        spread = ((e.span >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.flatnonzero(crowded)[np.argsort(spread[crowded], kind="stable")]
        yield _packed(spread[order], batch, CROWDED, e.take(order))
    if len(doc):
        yield _packed(np.full(len(doc), batch % shards), batch, MATCHES, Entries(key=doc[:0], doc=doc, row=row, start=a, windows=b - a))


def batches(docs: DataFrame, shards: int, config: SuffixConfig) -> DataFrame:
    """The arrays of all batches. docs: doc, row, text."""

    def of(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in found:
            data, offsets = raw(batch.column("text"))
            doc, own = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            for i, j in slices(offsets):
                at = offsets[i : j + 1] - offsets[i]
                s = Spans(data[offsets[i] : offsets[j]], at, config)
                parts.append(Entries(key=s.key, span=s.span, doc=doc[i:j][s.row], row=own[i:j][s.row], start=s.start - at[s.row], windows=s.windows))
                size += len(s.key)
                if size >= config.batch_rows:
                    yield from batch_rows(Entries.join(parts), number, shards, config)
                    parts, size, number = [], 0, number + 1
        yield from batch_rows(Entries.join(parts), number, shards, config)

    return docs.select("doc", "row", "text").mapInArrow(of, BATCH)


def scan(arrays: DataFrame, config: SuffixConfig) -> DataFrame:
    """The families of all shards. doc, row, start, size, key, crowd: bytes to remove where key is null, else the first copy
    of a span, `size` windows, whose key has other spans too; crowd: very many."""

    def rows(e: Entries, keyed: bool, crowd: np.ndarray | bool = False) -> pa.RecordBatch:
        n = len(e.doc)
        size = e.windows if keyed else e.windows + (config.length - 1)
        key = pa.array(e.key.view(np.int64)) if keyed else pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(e.doc), pa.array(e.row), pa.array(e.start), pa.array(size.astype(np.int32)), key, pa.array(np.broadcast_to(crowd, n))], ["doc", "row", "start", "size", "key", "crowd"])

    def matched(e: Entries) -> pa.RecordBatch:
        doc, row, a, b = long_matches(e, config.length)
        return rows(Entries(doc=doc, row=row, start=a, windows=b - a - (config.length - 1)), False)

    def ended(family: LevelFamily, crowds: list[np.ndarray]) -> pa.RecordBatch:
        e = family.whole()
        n = spans_per_key(e.key)
        crowd = np.isin(e.key, np.concatenate([np.zeros(0, np.uint64), *crowds])) | (n > config.crowd)
        keep = (n > 1) | crowd
        return rows(e.take(keep), True, crowd[keep])

    def of(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, family, crowds = None, LevelFamily(), []
        for batch in found:
            for k in range(len(batch)):
                kind, n = batch.column("kind")[k].as_py(), batch.column("n")[k].as_py()
                if batch.column("shard")[k].as_py() != shard:
                    yield ended(family, crowds)
                    shard, family, crowds = batch.column("shard")[k].as_py(), LevelFamily(), []
                e = Entries(**{f: _wide(batch.column(f)[k].as_py(), n, t) for f, t in FIELDS.items()})
                if kind == ENTRIES:
                    yield matched(family.add(e))
                elif kind == CROWDS:
                    crowds.append(e.key)
                elif kind == CROWDED:
                    yield rows(e, True, True)
                else:
                    e.columns["windows"] = e.windows - (config.length - 1)
                    yield rows(e, False)
        yield ended(family, crowds)

    return arrays.mapInArrow(of, FOUND)


def window_hashes(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span, place inside it and hash of every window of some spans."""
    size = np.diff(offsets) - length + 1
    entry = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size)
    at = offsets[:-1][entry] + inside
    return entry, inside, Hashes(data).of(at, at + length)


FETCHED = "key long, window long, doc long, row long, start long, size int, bytes binary"


def fetched(docs: DataFrame, homes: DataFrame, config: SuffixConfig) -> DataFrame:
    """key, window, doc, row, start, size, bytes: a span with its bytes; or a window of a crowd, by its hash, without bytes; or,
    with neither window nor bytes, `size` bytes that are settled: windows of a crowd that come again in a batch."""
    wanted = homes.groupBy("doc", "row").agg(F.collect_list(F.struct("key", "start", "size", "crowd")).alias("wanted"))

    def rows(e: dict[str, np.ndarray], window: np.ndarray | None, size: np.ndarray | int, parts: list[bytes] | None) -> pa.RecordBatch:
        n = len(e["doc"])
        blank = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(x, kind)
        columns = [pa.array(e["key"]), blank(window, pa.int64()), pa.array(e["doc"]), pa.array(e["row"]), pa.array(e["start"]), pa.array(np.broadcast_to(size, n).astype(np.int32)), blank(parts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key", "window", "doc", "row", "start", "size", "bytes"])

    def dealt(e: dict[str, np.ndarray], parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        entry, inside, window = window_hashes(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), config.length)
        e = {k: v[entry] for k, v in e.items()}
        e["start"] = e["start"] + inside
        order = np.lexsort((e["start"], e["row"], e["doc"], window, e["key"]))
        e, window = {k: v[order] for k, v in e.items()}, window[order]
        new, other = heads(e["key"], window), heads(e["key"], window, e["doc"], e["row"], e["start"])
        yield rows({k: v[new] for k, v in e.items()}, window[new].view(np.int64), 0, None)
        late = {k: v[~new & other] for k, v in e.items()}
        doc, row, a, b = long_matches(Entries(windows=np.ones(len(late["doc"]), np.int64), **late), config.length)
        yield rows({"key": doc, "doc": doc, "row": row, "start": a}, None, b - a, None)

    def of(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            data, offsets = raw(batch.column("text"))
            wanted = batch.column("wanted")
            spans = wanted.flatten()
            at = np.repeat(np.arange(len(batch)), wanted.value_lengths().to_numpy())
            e = {"key": spans.field("key").to_numpy(), "start": spans.field("start").to_numpy(), **{c: batch.column(c).to_numpy()[at] for c in ("doc", "row")}}
            n, crowd = spans.field("size").to_numpy() + (config.length - 1), np.asarray(spans.field("crowd"))
            for i in range(0, len(at), 20_000):
                for some, send in ((np.flatnonzero(~crowd[i : i + 20_000]) + i, False), (np.flatnonzero(crowd[i : i + 20_000]) + i, True)):
                    if len(some):
                        begin = offsets[at[some]] + e["start"][some]
                        parts = [data[a : a + m].tobytes() for a, m in zip(begin.tolist(), n[some].tolist(), strict=True)]
                        own = {k: v[some] for k, v in e.items()}
                        yield from dealt(own, parts) if send else [rows(own, None, 0, parts)]

    return docs.join(wanted.hint("merge"), ["doc", "row"]).mapInArrow(of, FETCHED)


def equal_runs(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a : a + n] equals data[b : b + n], for each row."""
    ends = np.cumsum(n)
    step = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)
    same = data[np.repeat(a, n) + step] == data[np.repeat(b, n) + step]
    return np.logical_and.reduceat(same, ends - n) if len(n) else np.zeros(0, bool)


def repeated_windows(group: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of spans in order inside their groups: row, first and last byte's end of the runs of windows that an earlier span of the group has."""
    entry, inside, window = window_hashes(data, offsets, length)
    at = offsets[:-1][entry] + inside
    home = np.empty(len(window), np.int64)
    parts = len(window) // 2_000_000 + 1
    for part in range(parts):  # equal windows are in one part
        mine = np.flatnonzero(window % np.uint64(parts) == part) if parts > 1 else np.arange(len(window))
        order = mine[np.lexsort((window[mine], group[entry[mine]]))]
        home[order] = order[np.maximum.accumulate(np.where(heads(group[entry[order]], window[order]), np.arange(len(order)), 0))]
    later = np.flatnonzero(home != np.arange(len(home)))
    here, there = at[later], at[home[later]]
    step = np.arange(len(later))
    first = np.flatnonzero(heads(later - step, entry[later], there - step, entry[home[later]]))
    n = np.diff(np.append(first, len(later))) + (length - 1)
    good = equal_runs(data, here[first], there[first], n)
    first, n = first[good], n[good]
    begin = inside[later[first]]
    return entry[later[first]], begin, begin + n


def compared(found: DataFrame, config: SuffixConfig) -> DataFrame:
    """doc, row, a, b: bytes that an earlier span of the same key has as well, of the rows of fetched()."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"key": pa.array([], pa.int64())})
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, more]) if len(held) else more
            if len(held) < 4096:
                continue
            keys, windows = held.column("key").to_numpy(), held.column("window").fill_null(0).to_numpy()
            other = np.flatnonzero((keys != keys[-1]) | (windows != windows[-1]))
            whole = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
            if whole:
                yield settle(held.slice(0, whole))
                held = held.slice(whole)
            elif held.column("bytes").null_count == len(held):
                # a window of a crowd: its first place is all that must be kept
                yield settle(held)
                held = held.slice(0, 1)
        if len(held):
            yield settle(held)

    def settle(held: pa.Table) -> pa.RecordBatch:
        whole = held.combine_chunks().to_batches()[0]
        # a document that is there twice, under one id, was fetched twice
        place = ("key", "doc", "row", "start")
        whole = whole.filter(pa.array(heads(*(whole.column(c).to_numpy() for c in place), whole.column("window").fill_null(0).to_numpy())))
        spans, windows = np.asarray(whole.column("bytes").is_valid()), np.asarray(whole.column("window").is_valid())
        done = whole.filter(pa.array(~spans & ~windows))
        out = [[done.column(c).to_numpy() for c in ("doc", "row", "start")], [done.column("start").to_numpy() + done.column("size").to_numpy()]]
        batch = whole.filter(pa.array(spans))
        data, offsets = raw(batch.column("bytes"))
        k, a, b = repeated_windows(np.cumsum(heads(batch.column("key").to_numpy())), data, offsets, config.length)
        start = batch.column("start").to_numpy()[k]
        parts = [(*out[0], *out[1]), (batch.column("doc").to_numpy()[k], batch.column("row").to_numpy()[k], start + a, start + b)]
        batch = whole.filter(pa.array(windows))
        late = batch.filter(pa.array(~heads(batch.column("key").to_numpy(), batch.column("window").to_numpy())))
        start = late.column("start").to_numpy()
        parts.append((late.column("doc").to_numpy(), late.column("row").to_numpy(), start, start + config.length))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["doc", "row", "a", "b"])

    order = ["key", "window", "doc", "row", "start"]
    return found.repartition("key", "window").sortWithinPartitions(*order).mapInArrow(of, "doc long, row long, a long, b long")


def covered(docs: DataFrame, size: int, config: SuffixConfig) -> DataFrame:
    """doc, row, cuts (start and end of bytes to remove, unordered, overlapping) of documents that have any."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = 2 * size // (config.length - config.gram + 2)
    shards = max(partitions, -(-entries // config.shard_rows))
    return cuts_of(docs.select("doc", "row", "text"), written(scan(arranged(batches(docs, shards, config), shards), config), "suffixes"), config)


def arranged(arrays: DataFrame, shards: int) -> DataFrame:
    """A shard's arrays one after another, by batch."""
    return arrays.repartitionById(shards, "shard").sortWithinPartitions("shard", "batch")


def cuts_of(texts: DataFrame, found: DataFrame, config: SuffixConfig) -> DataFrame:
    """doc, row, cuts, from what scan() found. texts: doc, row, text of all documents in it."""
    cuts = found.where("key is null").select("doc", "row", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    cuts = cuts.unionByName(compared(fetched(texts, found.where("key is not null"), config), config))
    return cuts.groupBy("doc", "row").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))


def without(marked: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of rows (doc_id, text, cuts)."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            cuts = batch.column("cuts")
            out = []
            for i, has in enumerate(np.asarray(cuts.is_valid())):
                text = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(text) + 1, np.int64)
                if has:
                    c = cuts[i].values
                    np.add.at(gone, c.field("a").to_numpy(), 1)
                    np.add.at(gone, c.field("b").to_numpy(), -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = text[~gone].tobytes()
                out.append((len(text), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return marked.select("doc_id", "text", "cuts").mapInArrow(drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary): a row per row of docs.

    Null texts are empty. Null ids come after all others. Rows of one id with equal texts are one document: neither makes the
    other's bytes a repeat; with different texts they are documents in the order of a hash of their texts. Texts
    shorter than `length` lose nothing. Other columns are ignored; an empty table gives an empty result.
    """
    rows, size, _ = numbered(docs)
    return without(rows.join(covered(rows, size, config).hint("merge"), ["doc", "row"], "left"))


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of keys, by their upper 32 bits."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def fresh(arrays: DataFrame, after: int, shards: int) -> DataFrame:
    """The array, by shard, of first copies that no level before has: entries of documents after `after`. arrays: arranged()."""

    def of(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, family, more = None, LevelFamily(), []

        def level() -> Iterator[pa.RecordBatch]:
            for e in (family.whole(), Entries.join(more).in_order()):
                e = e.take(np.flatnonzero(e.doc > after))
                if len(e):
                    yield _packed(shard_of(e.key, shards), 0, ENTRIES, e)

        for batch in found:
            for k in range(len(batch)):
                kind, n = batch.column("kind")[k].as_py(), batch.column("n")[k].as_py()
                if batch.column("shard")[k].as_py() != shard:
                    if shard is not None:
                        yield from level()
                    shard, family, more = batch.column("shard")[k].as_py(), LevelFamily(), []
                if kind in (ENTRIES, CROWDED):
                    e = Entries(**{f: _wide(batch.column(f)[k].as_py(), n, t) for f, t in FIELDS.items()})
                    if kind == ENTRIES:
                        family.add(e)
                    else:  # a crowd comes to all shards, by its spans; in a level it is at its key's shard
                        more.append(e)
        if shard is not None:
            yield from level()

    return arrays.mapInArrow(of, BATCH)


def merged(levels: DataFrame, shards: int) -> DataFrame:
    """Two levels as one: their arrays merged, shard by shard."""

    def of(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in found:
            for k in range(len(batch)):
                if batch.column("shard")[k].as_py() != shard:
                    if parts:
                        e = Entries.join(parts).in_order()
                        yield _packed(np.full(len(e), shard), 0, ENTRIES, e)
                    shard, parts = batch.column("shard")[k].as_py(), []
                parts.append(Entries(**{f: _wide(batch.column(f)[k].as_py(), batch.column("n")[k].as_py(), t) for f, t in FIELDS.items()}))
        if parts:
            e = Entries.join(parts).in_order()
            yield _packed(np.full(len(e), shard), 0, ENTRIES, e)

    return arranged(levels, shards).mapInArrow(of, BATCH)


class SuffixIndex:
    """Levels of arrays in the shared folder, to which batches of later documents are added.

    A batch gets its arrays, is scanned against every level shard by shard, and loses what they or its own earlier documents have.
    Its first copies become a new level; while the level before has less than twice as many entries, the two are merged, so there are
    at most as many levels as twice the logarithm of the entries. `levels` is the manifest: folder and entries of each, oldest first;
    `texts` the folders of the documents added, for comparison by bytes.
    """

    def __init__(self, spark: SparkSession, shards: int, config: SuffixConfig = SuffixConfig()):
        self.spark, self.shards, self.config = spark, shards, config
        self.levels: list[tuple[str, int]] = []
        self.texts: list[str] = []
        self.newest = -1

    def _put(self, df: DataFrame, name: str) -> str:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _level(self, path: str, number: int) -> DataFrame:
        return self.spark.read.schema(BATCH).parquet(path).withColumn("batch", F.lit(number).cast("long"))

    def add_batch(self, docs: DataFrame) -> DataFrame:
        """As remove_repeats(), for the new documents. Their ids must be there and greater than all that were added before, and none may come twice."""
        low, high, n, ids = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.count_distinct("doc_id")).first()
        if n and (ids < n or low <= self.newest):
            raise ValueError("ids of a batch must be new, not null, and greater than those before")
        rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("doc"), F.lit(0).cast("long").alias("row"), "text")
        self.texts.append(self._put(rows, "texts"))
        rows = self.spark.read.schema(rows.schema).parquet(self.texts[-1])
        every = self.spark.read.schema(rows.schema).parquet(*self.texts).select("doc", "row", "text")
        arrays = batches(rows, self.shards, self.config)
        for k, (path, _) in enumerate(self.levels):
            arrays = arrays.unionByName(self._level(path, k - len(self.levels)))
        whole = self._put(arranged(arrays, self.shards), "arrays")
        arrays = arranged(self.spark.read.schema(BATCH).parquet(whole), self.shards)
        found = written(scan(arrays, self.config), "suffixes")
        cuts = cuts_of(every, found, self.config).where(F.col("doc") > self.newest)
        out = written(without(rows.join(cuts.hint("merge"), ["doc", "row"], "left")), "batch")
        path = self._put(fresh(arrays, self.newest, self.shards), "level")
        self.levels.append((path, self._level(path, 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
        while len(self.levels) > 1 and 2 * self.levels[-1][1] > self.levels[-2][1]:
            (a, some), (b, others) = self.levels[-2:]
            self.levels[-2:] = [(self._put(merged(self._level(a, 0).unionByName(self._level(b, 1)), self.shards), "level"), some + others)]
        self.newest = high if n else self.newest
        return out
