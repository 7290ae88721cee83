"""Line dedup (5): content-defined chunks of lines; chunks of several lines that repeat anywhere lose all but the first.

A line ends after its line feed. A rolling hash of `window` successive line hashes chooses the bounds: a chunk begins at a
line if the hash of that line and those after it falls on one of 1 / `mean` of its values (and with a text), and ends after
the next line for which the hash of it and those before it does so in another such test, at least `least` lines later (or with
the text, or after `most` lines). As both windows lie inside the chunk, its bounds hang on nothing outside, so an inserted
line moves none but those whose windows hold it, and a repeated passage has the same chunks in all surroundings. `rules` independent pairs of tests are made, as a short passage has a chunk under some of them
only; chunks may overlap. A chunk of at least `words` words that equals an earlier one - smaller (document, place) - is
removed; every line that goes this way is still in the document in which it came first. Equality is that of the bytes:
keys only choose what is compared.

Keys are shuffled first. Only the first copy of each repeated chunk then fetches its bytes, and each document with
repeats gets those bytes to compare with its own; the text itself is shuffled twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import numbered, written
from marketflow.llm.textarrays import BASE, Hashes, mix, powers, raw, slices, word_spans


@dataclass(frozen=True)
class LineConfig:
    window: int = 2
    mean: int = 2
    rules: int = 3
    most: int = 32
    least: int = 2
    words: int = 10


def rolling(lines: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every line the rolling hash of the window that begins with it, and of the one that ends with it; at a text's edges of what there is of it.

    The hash of lines a .. b - 1 is the sum of line k's times BASE ** (k - a), from running sums, so a window costs the same however many lines it holds.
    """
    n = len(lines)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(lines * powers(BASE, n), out=sums[1:])
    back = powers(pow(BASE, -1, 1 << 64), n + 1)
    at = np.arange(n)
    start, end = np.searchsorted(row, row), np.searchsorted(row, row, "right")
    of = lambda a, b: mix((sums[b] - sums[a]) * back[a])
    return of(at, np.minimum(at + window, end)), of(np.maximum(at - window + 1, start), at + 1)


def chunks(data: np.ndarray, offsets: np.ndarray, config: LineConfig) -> tuple[np.ndarray, ...]:
    """row, start, end, number of lines, words and key of every chunk of some texts under any rule, by place."""
    ends = np.flatnonzero(data == 10) + 1
    ends = np.union1d(ends, offsets[1:][np.diff(offsets) > 0])
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    row = np.searchsorted(offsets, starts, "right") - 1
    hashes = Hashes(data)
    lines = hashes.of(starts, ends)
    after, before = rolling(lines, row, config.window)
    n = len(lines)
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:], last[:-1] = row[1:] != row[:-1], row[1:] != row[:-1]
    end_of_row = np.minimum.accumulate(np.where(last, np.arange(n), n)[::-1])[::-1]
    first_word = np.searchsorted(word_spans(data, offsets)[0], np.append(starts, len(data)))
    pairs = []
    for rule in range(config.rules):
        opens, closes = (mix(roll + np.uint64(2 * rule + k)) % np.uint64(config.mean) == 0 for k, roll in enumerate((after, before)))
        begin = np.flatnonzero(first | opens)
        close = np.flatnonzero(last | closes)
        at = close[np.minimum(np.searchsorted(close, begin + config.least - 1), max(len(close) - 1, 0))] if n else begin
        at = np.minimum(at, begin + config.most - 1)
        inside = (at <= end_of_row[begin]) & (at - begin + 1 >= config.least) if n else np.zeros(0, bool)
        pairs.append((begin[inside], at[inside]))
    begin, at = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((at, begin))  # rules often agree
    begin, at = begin[order], at[order]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (at[1:] != at[:-1])
    begin, at = begin[new], at[new]
    return row[begin], starts[begin], ends[at], at - begin + 1, first_word[at + 1] - first_word[begin], hashes.of(starts[begin], ends[at])


def _of_batch(column: pa.Array, config: LineConfig) -> tuple[np.ndarray, ...]:
    """As chunks(), for a whole column; starts and ends count from the row's first byte, and a place counts chunks."""
    data, offsets = raw(column)
    found = []
    for i, j in slices(offsets):
        row, a, b, *rest = chunks(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], config)
        shift = offsets[i:j][row] - offsets[i]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        found.append((row + i, a - shift, b - shift, *rest, place))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def chunk_table(docs: DataFrame, config: LineConfig) -> DataFrame:
    """doc, row, place, key of every chunk that may be removed."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b, n, words, key, place = _of_batch(batch.column("text"), config)
            k = (n >= config.least) & (words >= config.words)
            ids = [batch.column(c).take(pa.array(row[k])) for c in ("doc", "row")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(place[k].astype(np.int32)), pa.array(key[k].astype(np.uint64).view(np.int64))], ["doc", "row", "place", "key"])

    return docs.select("doc", "row", "text").mapInArrow(of, "doc long, row long, place int, key long")


def remove_repeats(docs: DataFrame, config: LineConfig = LineConfig(), carry: list[str] = ()) -> DataFrame:
    """doc_id, carry, n_chunks, n_removed (chunks, of all rules), n_removed_lines, text (what is left; null stays null).

    A row per row of docs. Null and empty texts have no chunks. Null ids come after all others. Rows of one id with equal
    texts are one document and treated alike; with different texts they are documents in the order of a hash of their
    texts. Ties go by place. Extra columns are ignored unless carried.
    """
    docs, _, repeated = numbered(docs, carry)
    found = written(chunk_table(docs, config), "chunks")
    spot = F.struct("doc", "row", "place")
    first = found.groupBy("key").agg(F.min(spot).alias("at"), F.max(spot).alias("last")).where("at <> last")
    first = written(first.select("key", F.col("at.doc").alias("home"), F.col("at.row").alias("home_row"), F.col("at.place").alias("spot")), "first")
    wanted = first.groupBy(F.col("home").alias("doc"), F.col("home_row").alias("row")).agg(F.collect_list(F.struct("spot", "key")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            row, a, b, *_ = _of_batch(batch.column("text"), config)
            begin = np.searchsorted(row, np.arange(len(batch) + 1))
            keys, parts = [], []
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                for w in wanted:
                    k = begin[i] + w["spot"]
                    keys.append(w["key"])
                    parts.append(data[offsets[i] + a[k] : offsets[i] + b[k]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], ["key", "bytes"])

    originals = docs.select("doc", "row", "text").join(wanted.hint("merge"), ["doc", "row"]).select("text", "wanted").mapInArrow(fetch, "key long, bytes binary")
    if repeated:  # a document that is there twice was fetched twice
        originals = originals.dropDuplicates(["key"])
    originals = written(first.join(originals, "key"), "originals")  # a table of its own, so that hot keys below can be split
    marks = (
        found.join(originals, "key")
        .where("doc <> home or row <> home_row or place <> spot")
        .groupBy("doc", "row")
        .agg(F.collect_list(F.struct("place", "bytes")).alias("marks"))
    )

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            row, a, b, *_ = _of_batch(batch.column("text"), config)
            begin = np.searchsorted(row, np.arange(len(batch) + 1))
            gone = np.zeros(len(row), bool)
            marks = batch.column("marks")
            for i in np.flatnonzero(np.asarray(marks.is_valid())):
                for m in marks[int(i)].as_py():
                    k = begin[i] + m["place"]
                    gone[k] = gone[k] or data[offsets[i] + a[k] : offsets[i] + b[k]].tobytes() == m["bytes"]
            texts = batch.column("text").to_pylist()
            lost = np.zeros(len(batch))
            for i in np.unique(row[gone]):
                whole = data[offsets[i] : offsets[i + 1]]
                kept = np.ones(len(whole), bool)
                for k in range(begin[i], begin[i + 1]):
                    if gone[k]:
                        kept[a[k] : b[k]] = False
                feeds = np.append(np.flatnonzero(whole[:-1] == 10), len(whole) - 1)
                lost[i] = np.count_nonzero(~kept[feeds])
                texts[i] = whole[kept].tobytes().decode("utf-8")
            count = lambda x: pa.array(np.bincount(row, x, len(batch)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *carry)), count(np.ones(len(row))), count(gone), pa.array(lost.astype(np.int64)), pa.array(texts, batch.schema.field("text").type)],
                ["doc_id", *carry, "n_chunks", "n_removed", "n_removed_lines", "text"],
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in carry), "n_chunks long", "n_removed long", "n_removed_lines long", "text string"])
    return docs.join(marks.hint("merge"), ["doc", "row"], "left").select("doc_id", "text", "marks", *carry).mapInArrow(drop, schema)
