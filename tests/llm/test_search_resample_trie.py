"""Top-k search, importance resampling and the prefix trie against plain re-statements, with nulls, ties, repeats, empty and long inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketflow.llm import prefix_trie, resampling, top_k

VECTORS = "vec_id long, embedding array<float>, label int, score double, query int"


def vectors(n=700, wide=24, scale=1.0):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, wide) * scale]) for i in range(n)]
    rows += [(1000 + i, rows[40][1]) for i in range(90)]  # copies: ties at every rank
    rows += [(2000, None), (2020, [None] * wide), (2040, [float("nan")] + [0.1] * (wide - 1)), (2060, [float("inf")] * wide), (2080, []), (2100, [0.0] * wide), (2120, [0.25] * (wide + 3)), (None, [1.0] * wide)]
    return rows


def plain_top(rows, k, every, scale=64):
    sound = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in sound:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in sound if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("config", [top_k.TopKConfig(), top_k.TopKConfig(shard=100, block=7, levels=5, checks=(0.2, 0.5)), top_k.TopKConfig(job=10, few=0.5)])
def test_top_k_is_exact(spark, config):
    rows = vectors(scale=40.0 if config.levels == 5 else 1.0)
    df = spark.createDataFrame([(i, v, 0, 0.0, 1) for i, v in rows], VECTORS).repartition(3)
    got = {tuple(r) for r in top_k.top_k(df, config).collect()}
    assert got == plain_top(rows, 20, 20)
    assert top_k.top_k(df.where("false"), config).count() == 0


def test_top_k_scan_stops_before_the_last_segment_only_on_proof():
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(0, 8, (3000, 32))).astype(np.int32)
    v[:40] = v[7] + rng.integers(-1, 2, (40, 32))  # a few near each other: the rest is soon ruled out
    config = top_k.TopKConfig(few=0.1)
    shard = top_k.Shard(np.arange(3000), v, config)
    scanned = []
    ends, shard.ends = shard.ends, type("Ends", (), {"tolist": lambda self: (scanned.append(e) or e for e in ends.tolist())})()
    best = top_k.Best(1, 20)
    top_k.search(shard, np.array([7]), v[7:8], best, config)
    want = sorted((-int(s), i) for i, s in enumerate(v.astype(np.int64) @ v[7]) if i != 7)[:20]
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist(), strict=True)] == want
    assert 0 < len(scanned) < len(ends)


def test_top_k_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.5, 1.0])]
    got = sorted(tuple(r) for r in top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    a, b = [(1, 4096), (1, 4096), (2, 2048)], [(2, 4096), (1, 2048), (1, 2048)]
    assert got == sorted((0, r + 1, *x) for found in (a, b) for r, x in enumerate(found))


DOCS = "doc_id long, text string, tie string, rank long, source string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "日本", "ABC", "a'b", "x_y", "🙂"]
    out = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for i in range(300)}
    out |= {300: None, 301: "", 302: " .,;\n\x00\x1f", 303: "one\ntwo\x0bthree" * 10, 304: "w1 " * 300_000, 305: "z" * 1_000_000, -7: out[5], 307: out[5]}
    return out


def plain_features(text, least, most, buckets):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(words) - n + 1))


@pytest.mark.parametrize("config", [resampling.ResamplingConfig(bins=8), resampling.ResamplingConfig(least=1, most=3, percent=35, words=10, held=50)])
def test_resampling_matches_plain_counts(spark, config):
    goal = ["w1 w2 w3 w4", "ABC abc Ärger", None, ""]
    docs = spark.createDataFrame([(i, t, "t", 1, None) for i, t in texts().items()], DOCS).repartition(4)
    got = {r.doc_id: r for r in resampling.resample(docs, spark.createDataFrame([(t,) for t in goal], "text string"), config).collect()}
    of = {i: plain_features(t, config.least, config.most, config.buckets) for i, t in texts().items()}
    s, t = sum((c for _, c in of.values()), Counter()), sum((plain_features(x, config.least, config.most, config.buckets)[1] for x in goal), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + config.buckets) / ((s[b] + 1) * (t.total() + config.buckets)))) for b in s}
    score = {}
    for i, (n, c) in of.items():
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"{config.seed}:{i}".encode()).hexdigest()[:8], 16)
        score[i] = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        assert (got[i].n_words, got[i].n_features, got[i].weight, got[i].score) == (n, c.total(), weight, score[i])
    may = sorted((i for i in of if of[i][0] >= config.words), key=lambda i: (-score[i], i))
    ranks = {i: k + 1 for k, i in enumerate(may[: config.percent * len(may) // 100])}
    assert {i: r.rank for i, r in got.items() if r.rank} == ranks and len(got) == len(of)


def test_resampling_of_empty_tables_null_ids_and_repeats(spark):
    empty = spark.createDataFrame([], DOCS)
    assert resampling.resample(empty, empty).count() == 0
    long = " ".join("abcdefghijklmnopqrstuvwxyz")
    rows = [(None, long, "", 1, ""), (3, long, "", 1, ""), (3, long, "", 1, ""), (3, long + " a", "", 1, "")]
    got = resampling.resample(spark.createDataFrame(rows, DOCS), empty, resampling.ResamplingConfig(percent=100)).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3, 4]
    drawn = resampling.texts(spark.createDataFrame(rows[:2], DOCS).drop("rank"), resampling.resample(spark.createDataFrame(rows[:2], DOCS), empty, resampling.ResamplingConfig(percent=100)))
    assert [r.text for r in drawn.collect()] == [long]


TURNS = "conv_id long, turn long, role string, text string, depth long, node string"


def conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 40), *range(98, 140), 205, 230, 300, 301, -5, -100, -130]:
        for t in range(rng.choice([1, 2, 3, 5, 7, 9])):
            rows.append((c, None if t == 0 and c % 5 == 0 else t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes 🙂", "", None, "no"])))
    rows += [(400, 0, "user", "hi"), (400, 0, "user", "hi"), (400, 0, "assistant", "hi"), (None, 0, "user", "hi")]
    rows += [(500, t, "user", "again") for t in range(700)] + [(c, t, "user", "again") for c in range(501, 520) for t in range(5)]
    return rows


def plain_trie(rows, borrow, modulus=6):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], text))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, v in own.items():
        if borrow:
            h = zlib.crc32(str(c).encode()) % modulus
            whole[c] = own.get(c - int(math.fmod(c, borrow)), [])[:h] + v[h:]
        else:
            whole[c] = v
    members, at = {}, {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(tuple(whole[c][:d]), []).append(c)
    for x in members:
        at.setdefault(x[:-1] if x else None, []).append(x)
    out = {}
    leaves, saved = Counter(), Counter()
    for x, m in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += x not in at
            saved[x[:d]] += (len(m) - 1) * len(x[-1][1]) if x else 0
    for x, m in members.items():
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(x))
        out[x] = (m[0], len(x), members[x[:-1]][0] if x else None, len(m), len(at.get(x, [])), leaves[x], saved[x], hashlib.sha256(ends.encode()).hexdigest())
    return out


@pytest.mark.parametrize("config", [prefix_trie.TrieConfig(borrow=100), prefix_trie.TrieConfig(), prefix_trie.TrieConfig(borrow=10, bits=(4, 4), span=3, hot=1)])
def test_prefix_trie_matches_plain_walk(spark, config):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(3)
    nodes = prefix_trie.prefix_trie(df, config)
    got = sorted(tuple(r) for r in nodes.drop("source", "place").collect())
    want = plain_trie(rows, config.borrow)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want.values(), key=key)
    if not config.borrow:
        last = Counter((r.conv_id, r.depth, r.role, r.text) for r in prefix_trie.with_turns(nodes, df.select("conv_id", "turn", "role", "text")).collect())
        assert last == Counter((v[0], v[1], *(x[-1] if x else (None, None))) for x, v in want.items())


def test_prefix_trie_of_an_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS), prefix_trie.TrieConfig(borrow=100)).count() == 0


def test_sketch_never_calls_a_shared_prefix_alone(spark):
    rows = [(c, t, "user", f"{c if t > c % 4 else 0} {t}") for c in range(400) for t in range(6)]
    found = prefix_trie.prefixes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), prefix_trie.TrieConfig()).cache()
    for bits in (4, 12):
        kinds = prefix_trie.screened(found, prefix_trie.sketch(found.where("depth > 0"), bits), bits)
        shared = kinds.groupBy("node").agg(F.count("*").alias("n"), F.max("kind").alias("kind")).where("n > 1 and kind > 0").count()
        assert shared == 0
        assert bits == 4 or kinds.where("kind = 2").count() > 500


@pytest.mark.parametrize("config", [prefix_trie.TrieConfig(borrow=100), prefix_trie.TrieConfig(borrow=100, bits=(8, 12))])
def test_prefix_trie_keeps_nodes_whose_parent_alone_is_proven(spark, config):
    rows = [(c, t, "user", f"{c if t > c % 5 else c % 7} {t}") for c in range(3000) for t in range(c % 13)] + [(100 * k + 7, None, None, "x") for k in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = Counter(tuple(r) for r in prefix_trie.prefix_trie(df, config).drop("source", "place").collect())
    assert got == Counter(plain_trie(rows, 100).values())
