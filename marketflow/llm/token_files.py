"""Token ids and binary output (7): canonical, length-limited Huffman codes of ids, from their global counts.

Documents are encoded where they lie and counted; the ids are then dealt to shards by ranges of doc_id and written as
blocks: a Parquet row with the documents' ids and lengths, the code bits of all their tokens, and the bit offset of
every `stride`-th token. A block is decoded by table alone, all its strides in step. Parquet holds the blocks so that
Spark's commit covers lost executors and any file system will do; the codebook is a table beside them.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketflow.llm.common import shared_dir, written
from marketflow.llm.memo import Memo, spread, word_keys
from marketflow.llm.textarrays import raw, slices

#: Classes of code points as the byte-level pattern tells them apart.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_state: dict = {}


@dataclass(frozen=True)
class TokenConfig:
    """path: tokenizer file. limit: longest code. stride: tokens between checkpoints. block: tokens a block at least."""

    path: str
    end_id: int = 2
    limit: int = 18
    stride: int = 512
    block: int = 65_536


def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    points = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


class Encoder:
    """Ids of texts by the tokenizers library; each different pre-token is encoded once as long as it is remembered.

    The byte-level pattern never merges across pre-tokens, so a text's ids are those of its pre-tokens in turn. Texts
    with an apostrophe (contractions) or an added token's string go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = classes()
        self.memo = Memo(bits=20, room=3_000_000)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size()
        if size > 1 << 16:
            raise ValueError(f"ids are stored in 16 bits; {path} has {size}")
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])

    def pre_tokens(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of all pre-tokens of some texts of code points."""
        n = len(points)
        kind = self.kind[points]
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        run = head[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        starts = run.copy()
        at = np.flatnonzero(run)
        after_space = at[(at > 0) & ~head[at] & (kind[at] != SPACE)]
        after_space = after_space[kind[after_space - 1] == SPACE]
        starts[after_space - 1] = True
        starts[after_space[points[after_space - 1] == 32]] = False
        return np.flatnonzero(starts)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and how many each has. A space and letters can be encoded in a row,
        as each such word's first id, and no other, starts with a space."""
        plain = np.array([w[0] == " " and w[1:].isalpha() for w in words])
        sizes, begins, parts, end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        rows = np.flatnonzero(plain)
        for i in range(0, len(rows), 2000):
            some = rows[i : i + 2000]
            ids = np.array(self.library.encode_batch_fast(["".join([words[k] for k in some.tolist()])], add_special_tokens=False)[0].ids)
            begin = np.flatnonzero(self.spaced[ids])
            if len(begin) != len(some):
                plain[some] = False
                continue
            sizes[some], begins[some] = np.diff(np.append(begin, len(ids))), end + begin
            parts.append(ids)
            end += len(ids)
        rest = np.flatnonzero(~plain)
        for k, e in zip(rest.tolist(), self.library.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
            sizes[k], begins[k] = len(e.ids), end
            parts.append(np.array(e.ids, np.int64))
            end += len(e.ids)
        return spread(np.concatenate(parts) if parts else np.zeros(0, np.int64), begins, sizes), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if "'" in t or any(a in t for a in self.added)]
        for i, e in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        rest = [i for i in range(len(texts)) if out[i] is None]
        joined = "".join(texts[i] for i in rest)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.cumsum([0, *(len(texts[i]) for i in rest)])
        starts = self.pre_tokens(points, offsets)
        ends = np.append(starts[1:], len(points))
        keys = word_keys(points, starts, ends[: len(starts)], 0xD6E8FEB86659FD93)
        ids, sizes = self.memo.gather(keys, lambda rows: self.of_words([joined[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]))
        before = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets)]
        for k, i in enumerate(rest):
            out[i] = ids[before[k] : before[k + 1]]
        return out


def encoder(path: str) -> Encoder:
    """One a Python worker."""
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def token_table(docs: DataFrame, config: TokenConfig) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 16-bit, with the end id); needs ids below 65,536."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(config.path)
        end = np.array([config.end_id], np.uint16).tobytes()
        for batch in batches:
            column = batch.column("text")
            for i, j in slices(raw(column)[1], 1 << 19):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                rows = [ids.astype(np.uint16).tobytes() + end for ids in own.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, ids binary")


def counts(tokens: DataFrame) -> np.ndarray:
    """How often each id below 65,536 occurs in all; a row an id at most comes to the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data, offsets = raw(batch.column("ids"))
            for i, j in slices(offsets, 1 << 24):
                total += np.bincount(np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), np.uint16), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in tokens.select("ids").mapInArrow(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def code_lengths(freq: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over limit bits, by package-merge; 0 for ids that do not occur."""
    out = np.zeros(len(freq), np.int64)
    ids = np.flatnonzero(freq)
    n = len(ids)
    if n < 2:
        out[ids] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes over {limit} bits")
    ids = ids[np.argsort(freq[ids], kind="stable")]
    items = freq[ids].astype(np.float64)
    own, row = [], items
    levels = []
    for _ in range(limit):
        levels.append(own if len(own) else np.ones(n, bool))
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([items, packages])
        order = np.argsort(both, kind="stable")
        row, own = both[order], order < n
    take = 2 * n - 2
    for flags in reversed(levels):
        mine = int(np.count_nonzero(flags[:take]))
        out[ids[:mine]] += 1
        take = 2 * (take - mine)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    out = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[used]
    if len(used):
        top = int(sizes[-1])
        space = np.left_shift(1, top - sizes)
        out[used] = (np.cumsum(space) - space) >> (top - sizes)
    return out


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code bits of ids, most significant bit first, and each id's bit offset."""
    size = lengths[ids]
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1]) if len(ids) else 0
    word, shift = at >> 5, 64 - (at & 31) - size
    wide = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    out = np.zeros(total // 32 + 2, np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(ids) else np.zeros(0, int)
    if len(first):
        out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: -(-total // 8)], at


class Decoder:
    """Looks up the next `limit` bits: the id and its code's length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        self.top = max(1, int(lengths.max()))
        space = np.left_shift(1, self.top - lengths[used])
        self.ids = np.zeros(1 << self.top, np.uint32)
        self.ids[: space.sum()] = np.repeat(used, space)
        self.sizes = lengths.astype(np.int64)

    def decode(self, bits: bytes, starts: np.ndarray, n: int, stride: int) -> np.ndarray:
        """n ids; starts: the bit offset of every stride-th."""
        return self.decode_all([(bits, starts, n)], stride)[0]

    def decode_all(self, blocks: list[tuple[bytes, np.ndarray, int]], stride: int) -> list[np.ndarray]:
        """The ids of some blocks (bits, starts, n). All strides of all blocks go in step."""
        padded = [bits + b"\0" * (8 + -len(bits) % 4) for bits, _, _ in blocks]
        words = np.frombuffer(b"".join(padded), ">u4").astype(np.uint64)
        wide = (words[:-1] << np.uint64(32)) | words[1:]
        base = 8 * np.cumsum([0, *map(len, padded)])
        lanes = np.cumsum([0, *(len(starts) for _, starts, _ in blocks)])
        at = np.concatenate([starts.astype(np.int64) + base[k] for k, (_, starts, _) in enumerate(blocks)])
        out = np.zeros((stride, len(at)), np.uint32)
        last = 32 * (len(wide) - 1)
        for k in range(min(stride, max(n for _, _, n in blocks))):
            window = (wide[at >> 5] >> (64 - self.top - (at & 31)).astype(np.uint64)).astype(np.int64) & ((1 << self.top) - 1)
            out[k] = self.ids[window]
            at = np.minimum(at + self.sizes[out[k]], last)
        return [out[:, lanes[k] : lanes[k + 1]].T.ravel()[:n] for k, (_, _, n) in enumerate(blocks)]


def write(docs: DataFrame, path: str, config: TokenConfig) -> None:
    """path/codebook and path/blocks from docs (doc_id, text); null texts are empty, repeated ids keep their rows."""
    spark = docs.sparkSession
    tokens = written(token_table(docs, config), "tokens")
    lengths = code_lengths(counts(tokens), config.limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": used, "bits": lengths[used]})).coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((canonical(lengths), lengths))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = shared.value
        shard, start, block, ids, parts, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def out():
            nonlocal start, block, ids, parts, held
            sizes = np.array([len(p) for p in parts], np.int64)
            tokens = np.concatenate(parts)
            bits, at = pack(tokens, codes, lengths)
            row = {"shard": shard, "block": block, "start": start, "doc_ids": ids, "sizes": sizes, "offsets": at[:: config.stride], "bits": bits}
            start, block, ids, parts, held = start + len(tokens), block + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for (v, k) in zip(row.values(), kinds, strict=True)], list(row))

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for i, b in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids.append(i)
                parts.append(np.frombuffer(b.as_buffer(), np.uint16).astype(np.int64))
                held += len(parts[-1])
                if held >= config.block:
                    yield out()
        if ids:
            yield out()

    schema = "shard int, block long, start long, doc_ids array<long>, sizes array<long>, offsets array<long>, bits binary"
    ordered = tokens.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(of, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, stride: int = 512, packed: bool = False, together: int = 1 << 19) -> DataFrame:
    """doc_id, start, ids (array; packed: binary, little-endian unsigned 32-bit) of every document of a written folder; the codebook has a row an id at most.

    Blocks are decoded together until they hold `together` ids.
    """
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(1 << 16, np.int64)
    for r in book:
        lengths[r.id] = r.bits
    shared = spark.sparkContext.broadcast(Decoder(lengths))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("before"))  # a row a shard

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared.value
        for batch in batches:
            sizes = [v.values.to_numpy() for v in batch.column("sizes")]
            first = 0
            while first < len(batch):
                end, held = first, 0
                while end < len(batch) and (end == first or held + sizes[end].sum() <= together):
                    held += int(sizes[end].sum())
                    end += 1
                some = [(batch.column("bits")[k].as_py(), batch.column("offsets")[k].values.to_numpy(), int(sizes[k].sum())) for k in range(first, end)]
                for k, ids in enumerate(decoder.decode_all(some, stride), first):
                    ends = np.cumsum(sizes[k])
                    start = batch.column("before")[k].as_py() + batch.column("start")[k].as_py()
                    cut = np.append(0, ends).astype(np.int32)
                    lists = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cut * np.int32(4)), pa.py_buffer(ids.astype("<u4"))]) if packed else pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(start + ends - sizes[k]), lists], ["doc_id", "start", "ids"])
                first = end

    return blocks.join(F.broadcast(shards), "shard").mapInArrow(of, f"doc_id long, start long, ids {'binary' if packed else 'array<int>'}")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read() returns."""
    if dict(tokens.dtypes)["ids"] == "binary":
        return tokens.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            crc = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in lists]
            n = [len(x.values) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
