"""MinHash near-dedup (1): circulant signatures, banding, exact Jaccard check, connected components.

Two permutations of a universe of 2 ** universe_bits make all coordinates: sigma scatters the shingles, pi ranks them,
and coordinate k of a set is the least pi[(sigma[i] + k) mod D] over its shingles i. With bands of `rows` coordinates,
a pair at similarity s shares a band with probability 1 - (1 - s ** rows) ** bands: 0.999995 at 0.8 for 40 x 6.

Texts with equal shingle sets are one class, so copies cost one row each. A band's classes are linked through one
class, its lead, not in pairs: each is compared with it on full sets. Then, in `draws` rounds, the bands that still hold
several components draw another lead at random, by the hash of band, id and round, and what is in other components is
compared with it. A round costs rows in proportion to the classes, however large a group of near copies is, and
leaves few components, but may miss links, so what is left is then finished exactly.

The rest are the classes of bands that still hold several components. Sort a set's shingles by their number of sets,
rarest first: two sets at the threshold share one among their first n - ceil(percent * n) + 1 (prefix filter). Of the
classes that have such a shingle, those outside its largest component are compared with all of other components, unless
sizes or places in the order show that too few shingles are common. So no link that shares a band is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import written
from marketflow.llm.textarrays import mix, shingle_sets


@dataclass(frozen=True)
class NearConfig:
    """width: words a shingle. percent: least similarity, of 100. draws: rounds of random leads before the exact finish; no result depends on them."""

    width: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    universe_bits: int = 22
    seed: int = 11
    draws: int = 1


_tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}


def permutations(config: NearConfig) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi as a view whose row i holds pi[i], pi[i + 1], ... around the circle."""
    k = config.bands * config.rows
    key = (config.universe_bits, config.seed, k)
    if key not in _tables:
        rng = np.random.default_rng(config.seed)
        size = 1 << config.universe_bits
        sigma, pi = (rng.permutation(size).astype(np.uint32) for _ in range(2))
        _tables[key] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
    return _tables[key]


def band_keys(shingles: np.ndarray, config: NearConfig) -> np.ndarray:
    """A 64-bit key for each band of a non-empty set of shingle hashes."""
    sigma, ranks = permutations(config)
    at = sigma[(shingles >> np.uint64(64 - config.universe_bits)).astype(np.int64)]
    least = ranks[at[:1024]].min(axis=0)
    for i in range(1024, len(at), 1024):
        np.minimum(least, ranks[at[i : i + 1024]].min(axis=0), out=least)
    keys = mix(np.arange(1, config.bands + 1, dtype=np.uint64))
    for column in least.reshape(config.bands, config.rows).T:
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + column)
    return keys.view(np.int64)


def signatures(docs: DataFrame, config: NearConfig) -> DataFrame:
    """doc_id, n_shingles, key_a, key_b (128 bits of the set), bands; empty sets have no bands."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a, b, bands = [], [], [], []
            for s in shingle_sets(batch.column("text"), config.width):
                sizes.append(len(s))
                a.append(np.bitwise_xor.reduce(s) if len(s) else np.uint64(0))
                b.append(mix(s + np.uint64(0x51ED27)).sum(dtype=np.uint64))
                bands.append(band_keys(s, config) if len(s) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, bands)], dtype=np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key_a", "key_b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>")


def links(pairs: DataFrame, texts: DataFrame, config: NearConfig) -> DataFrame:
    """Of pairs (a, b) those whose full shingle sets reach the threshold. texts: doc_id, text of all ids in pairs."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy()
            distinct, first, back = np.unique(a, return_index=True, return_inverse=True)
            left = list(shingle_sets(batch.column("text_a").take(pa.array(first)), config.width))
            good = np.zeros(len(a), bool)
            for row, right in enumerate(shingle_sets(batch.column("text_b"), config.width)):
                mine = left[back[row]]
                if min(len(mine), len(right)) * 100 >= max(len(mine), len(right)) * config.percent > 0:
                    common = len(np.intersect1d(mine, right, assume_unique=True))
                    good[row] = common * 100 >= config.percent * (len(mine) + len(right) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, component (least id reachable) for every id of edges (a, b), by alternating large and small stars.

    Each round writes its edges to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    was, now = None, sign(e)
    while was != now:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        was, now = now, sign(e)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def next_pairs(members: DataFrame, parts: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a random lead of each band that holds several components, with what is in other components."""
    placed = members.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    draw = F.struct(F.xxhash64("band", "id", F.lit(turn)).alias("h"), F.col("id").alias("lead"), F.col("component").alias("own"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(draw).alias("d")).where("low <> high")
    far = placed.join(mixed.select("band", "d"), "band").where("component <> d.own")
    return far.select(F.least("id", "d.lead").alias("a"), F.greatest("id", "d.lead").alias("b")).distinct()


def shingle_rows(texts: DataFrame, config: NearConfig) -> DataFrame:
    """id, component, n, token: a row per distinct shingle. texts: id, component, text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), config.width))
            sizes = np.array([len(s) for s in sets], np.int64)
            row = pa.array(np.repeat(np.arange(len(sets)), sizes))
            tokens = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("component").take(row), pa.array(np.repeat(sizes, sizes)), pa.array(tokens)], ["id", "component", "n", "token"])

    return texts.select("id", "component", "text").mapInArrow(of, "id long, component long, n long, token long")


def rest_pairs(members: DataFrame, parts: DataFrame, texts: DataFrame, config: NearConfig) -> DataFrame:
    """Pairs (a, b) across components, among them all at the threshold that share a band."""
    placed = members.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    left = placed.join(mixed.select("band"), "band").select(F.col("id").alias("doc_id"), "component").distinct()
    rows = written(shingle_rows(left.join(texts, "doc_id").withColumnRenamed("doc_id", "id"), config), "shingles")
    often = rows.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    # shingles of one set alone come first in the order and match nothing
    sets = rows.join(often, "token").groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("s"))
    alone = F.col("n") - F.size("s")
    ahead = F.col("n") - F.expr(f"({config.percent} * n + 99) div 100") + 1
    first = sets.withColumn("alone", alone).withColumn("ahead", F.greatest(F.lit(0), ahead - alone).cast("int"))
    first = first.select("id", "component", "n", "alone", F.posexplode(F.slice("s", F.lit(1), F.col("ahead"))).alias("k", "x"))
    first = written(first.select("id", "component", "n", "x.token", (F.col("alone") + F.col("k")).alias("place")), "first")
    most = first.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token")
    most = most.agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("several")).where("several > 1").select("token", F.col("m.component").alias("major"))
    ours = first.join(most, "token").where("component <> major").drop("major")
    near = F.expr(
        f"l.component <> r.component and 100 * least(l.n, r.n) >= {config.percent} * greatest(l.n, r.n)"
        f" and {100 + config.percent} * least(l.n - l.place, r.n - r.place) >= {config.percent} * (l.n + r.n)"
    )
    found = ours.alias("l").join(first.alias("r"), (F.col("l.token") == F.col("r.token")) & near)
    return found.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs.

    Rows without an id link nothing: one whose shingles are exactly those of rows with ids has their component and is not kept, every other one
    has component_id null and is kept. Null texts and texts without a word have no shingles and stand alone. Rows of one id are one node, compared by the
    greatest of their texts. Of each component the least id is kept. Other columns of docs are ignored; an empty table gives none.
    """
    rows = written(signatures(docs, config), "signatures")
    key = ["n_shingles", "key_a", "key_b"]
    classes = written(rows.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    heads = rows.join(classes, key).where("doc_id = rep").select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    shared = heads.groupBy("band").agg(F.min("id").alias("i"), F.max("id").alias("j")).where("i <> j")
    members = written(heads.join(shared.select("band", F.col("i").alias("lead")), "band").select("band", "id", "lead"), "members")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    texts = written(docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
    pairs = written(members.where("id <> lead").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct(), "pairs")
    tested = pairs
    parts = written(components(written(links(pairs, texts, config), "links")), "parts")
    for turn in range(config.draws):
        pairs = written(next_pairs(members, parts, turn).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = written(tested.unionByName(pairs), "tested")
        more = written(links(pairs, texts, config), "links")
        if more.isEmpty():
            break
        known = parts.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        parts = written(components(known.unionByName(more)), "parts")
    pairs = written(rest_pairs(members, parts, texts, config).join(tested, ["a", "b"], "left_anti"), "pairs")
    more = written(links(pairs, texts, config), "links")
    if not more.isEmpty():
        known = parts.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        parts = written(components(known.unionByName(more)), "parts")
    named = classes.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("bands").join(named, key, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
