"""The training-data operators on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import heapq
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketflow.llm import fingerprints, language_id, line_dedup, linear, mixing, near_dedup, pieces, quality_model, stages, suffix_dedup, textarrays, token_files
from marketflow.llm import quality_rules as rules
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, band string, score double"


def texts() -> dict[int, str | None]:
    """Families of near copies, shared passages, copies, tiny, empty, null and non-Latin texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "an", "re", "ti", "ou", "éa", "ß", "on", "her"]) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    out: dict[int, str | None] = {0: None, 1: "", 2: "   \n\t", 3: "Word", 4: "word", 5: "日本語 テスト 🙂", 6: "don't stop, we'll go 123 !!"}
    passage = "\n".join(line(14) for _ in range(8))
    for i in range(10, 40):
        out[i] = "\n".join([line(12) for _ in range(rng.randint(1, 9))] + ([passage] if i % 3 == 0 else []) + [line(9)])
    for i in range(40, 60):
        base = out[10 + i % 7].split(" ")
        for _ in range(rng.randint(0, 8)):
            base[rng.randrange(len(base))] = word()
        out[i] = " ".join(base)
    out[60], out[61], out[62] = out[11], out[11], "a" * 500
    out[63] = "\n".join(line(10) for _ in range(400))
    out[64] = out[63][:9000] + line(20) + out[63][9000:]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, None if i % 9 == 0 else "xx" if i % 2 else "yy", None if i % 7 == 0 else f"s{i % 3}", None, "k", "b", 1.0) for i, t in texts().items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_dedup_matches_all_pairs(table, empty):
    for width in (2, 5):
        got = {r.doc_id: r for r in near_dedup.near_duplicates(table, near_dedup.NearConfig(width=width)).collect()}
        want = brute.near_components(texts(), width)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(brute.shingles(texts()[i], width)) and r.kept == (i == r.component_id) for i, r in got.items())
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_with_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None), (None, "a b c d e f"), (None, "g h i j k l")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_near_duplicates_stage_keeps_rows_without_an_id(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (None, None, None, None, 0)]
    left = stages.near_duplicates(spark, spark.createDataFrame(rows, docs_schema()), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, "a b c d e f"), (1, "a b c d e f")]


def test_near_dedup_finds_pairs_whose_bands_hold_a_large_component(spark):
    rng = random.Random(7)
    base, fresh, texts = [f"w{i}" for i in range(120)], iter(range(10**6)), {}

    def edited(words, n):
        words = list(words)
        for k in rng.sample(range(len(words)), n):
            words[k] = f"x{next(fresh)}"
        return words

    for i in range(300):
        texts[i] = " ".join(edited(base, 2))
    for i in range(300, 340, 2):  # at about 0.7 with the 300, and at 0.9 with each other
        one = edited(base, 10)
        texts[i], texts[i + 1] = " ".join(one), " ".join(edited(one, 2))
    config = near_dedup.NearConfig(width=2, bands=6, rows=1)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), config).collect()
    want = brute.near_components(texts, 2)
    assert len(set(want.values())) == 21
    assert {r.doc_id: r.component_id for r in got} == want


def test_suffix_dedup_matches_all_windows(table, empty):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table).collect()}
    for i, (removed, spans, left) in brute.repeated_bytes(texts()).items():
        r = got[i]
        assert (r.n_removed, r.n_spans, bytes(r.kept)) == (removed, spans, left), i
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_in_small_batches_and_crowds(table):
    want = brute.repeated_bytes(texts())
    for config in (suffix_dedup.SuffixConfig(batch_rows=40), suffix_dedup.SuffixConfig(batch_rows=500, crowd=1), suffix_dedup.SuffixConfig(crowd=3)):
        got = suffix_dedup.remove_repeats(table, config).collect()
        assert {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_suffix_dedup_with_repeated_and_null_ids(spark):
    rng = random.Random(8)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = word(40)
    rows = [(1, shared), (1, shared), (2, shared + "1" + word(5)), (None, shared), (None, None), (3, word(30)), (3, word(9) + shared + "2" + word(60)), (4, word(3))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = len(shared)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed) for r in got) == sorted((-1 if i is None else i, len(t or ""), n if t and shared in t and i != 1 else 0) for i, t in rows)


def test_level_family_keeps_the_earliest_of_every_span():
    rng = np.random.default_rng(1)
    family, first, refs, copies = suffix_dedup.LevelFamily(), {}, set(), []
    for _ in range(30):
        n = rng.integers(1, 300)
        key, span = rng.integers(0, 60, n).astype(np.uint64), rng.integers(0, 40, n).astype(np.uint64)
        e = suffix_dedup.Entries(key=key, span=span, doc=rng.integers(0, 10**6, n), row=np.zeros(n, np.int64), start=rng.integers(0, 50, n), windows=np.ones(n, np.int64)).in_order()
        e = e.take(suffix_dedup.first_of(e))
        copies.append(family.add(e))
        for k, s, d, p in zip(e.key, e.span, e.doc, e.start, strict=True):
            refs.add((k, s, d, p))
            first[k, s] = min(first.get((k, s), (d, p)), (d, p))
    whole, lost = family.whole(), suffix_dedup.Entries.join(copies)
    left = set(zip(whole.key, whole.span, whole.doc, whole.start, strict=True))
    assert left == {(k, s, *at) for (k, s), at in first.items()}
    assert refs - left == set(zip(lost.key, lost.span, lost.doc, lost.start, strict=True)) and len(lost) == len(refs - left)
    assert [len(x) for x in family.levels] == sorted((len(x) for x in family.levels), reverse=True)


def test_span_hashes_tell_the_thue_morse_words_apart():
    word = brute.thue_morse(1024)
    data = np.frombuffer((word + word.translate(str.maketrans("ab", "ba")) + word).encode(), np.uint8)
    a, b, c = textarrays.Hashes(data).of(np.array([0, 1024, 2048]), np.array([1024, 2048, 3072]))
    assert a == c != b


def _line_chunks(text: str, rule: int, config) -> list[tuple[int, int, bytes]]:
    """Chunks of one text under one rule, stated line by line: first and last line, bytes."""
    lines = [x for x in _lines((text or "").encode()) if x]
    hashes = [int(textarrays.Hashes(np.frombuffer(x, np.uint8)).of(np.array([0]), np.array([len(x)]))[0]) for x in lines]
    mixed = lambda x: int(textarrays.mix(np.array([x % 2**64], np.uint64))[0])
    roll = lambda window: mixed(sum(h * textarrays.BASE**k for k, h in enumerate(window)))
    mark = lambda i, k: mixed(roll(hashes[max(i - config.window + 1, 0) : i + 1] if k else hashes[i : i + config.window]) + 2 * rule + k) % config.mean == 0
    out, last = [], len(lines) - 1
    for i in range(len(lines)):
        if i == 0 or mark(i, 0):
            j = next((j for j in range(i + config.least - 1, last + 1) if j == last or mark(j, 1)), None)
            if j is not None:
                j = min(j, i + config.most - 1)
                out.append((i, j, b"".join(lines[i : j + 1])))
    return out


def _lines(data: bytes) -> list[bytes]:
    return [x + b"\n" for x in data.split(b"\n")[:-1]] + [data.split(b"\n")[-1]]


def test_line_dedup_matches_chunks_stated_line_by_line(table, empty):
    config = line_dedup.LineConfig(rules=3, most=5)
    got = {r.doc_id: r for r in line_dedup.remove_repeats(table, config, carry=["lang", "score"]).collect()}
    seen, removed = set(), 0
    for i, t in sorted(texts().items()):
        lines, gone = [x for x in _lines((t or "").encode()) if x], set()
        for a, b, piece in sorted({c for rule in range(config.rules) for c in _line_chunks(t, rule, config)}):
            if b - a + 1 >= config.least and len(piece.split()) >= config.words:
                gone |= set(range(a, b + 1)) if piece in seen else set()
                seen.add(piece)
        assert (got[i].text or "").encode() == b"".join(x for k, x in enumerate(lines) if k not in gone), i
        assert got[i].n_removed_lines == len(gone)
        removed += len(gone)
    assert got[0].text is None and removed > 20
    assert line_dedup.remove_repeats(empty).count() == 0


def test_line_dedup_removes_most_repeated_passages_and_defines_repeated_ids(spark):
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) + "\n"
    passages = ["".join(line() for _ in range(6)) for _ in range(40)]
    rows = [(1, line() + p + line()) for p in passages] + [(2 + k, line() + line() + p + line()) for k, p in enumerate(passages)] + [(None, passages[0]), (None, None)]
    got = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    left = {i: sum(r.n_removed_lines for r in got if r.doc_id == i) for i in {r.doc_id for r in got}}
    assert left[1] == 0 and sum(left[i] for i in left if i not in (None, 1)) > 0.7 * 240
    same = line_dedup.remove_repeats(spark.createDataFrame([(7, passages[0]), (7, passages[0]), (8, passages[0])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed_lines > 0) for r in same) == [(7, False), (7, False), (8, True)]


def test_pieces_match_the_library_and_round_trip(table, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in pieces.encode(table, path).collect()}
    assert all(r.ids == library.encode(texts()[i] or "") and r.round_trip for i, r in got.items())
    own = pieces.worker(path)
    odd = ["  ", "     x", " " * 50 + "abc" + " " * 23, "  ﬁ é", "ab" * 300, "a\tb\n\n c", "▁x", "<s> <0x0A>"]
    assert [x.tolist() for x in own.encode(odd)] == library.encode(odd)
    assert pieces.encode(empty, path).count() == 0


def test_pieces_of_long_words_and_runs_of_spaces():
    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(3)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.worker(path)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in [("ab", 5000), ("aeiou", 3000), ("abcdefghijklmnopqrstuvwxyz", 9000), ("thean", 4000), ("=-_", 2500), ("éß日🙂", 3000), ("+/ABCxyz019", 6000)]]
    texts += ["a" * 20_000, "ab" * 4000 + "c", "=" * 5000 + "a", "x" + "ha" * 3000 + " " * 777, " " * 4097 + "y", " " * 10_000, "internationalisation" * 400]
    for t in texts:
        assert own.encode([t])[0].tolist() == library.encode(t), t[:20]
    start = time.time()
    assert own.encode(["a" * 1_000_000])[0].tolist() == library.encode("a" * 1_000_000)
    assert own.decode(own.encode(["".join(rng.choice("abcdefgh") for _ in range(1_000_000))])[0])[:5].isalpha()
    assert time.time() - start < 60


def test_pieces_of_a_unigram_model_have_the_best_score():
    model = pieces.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    own = pieces.Pieces(pieces.PieceModel(model.pieces, model.scores, model.kinds, merges=False))
    scores = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k == 1}
    for word in ["theanre", "hello", "éaßon", "internationalisation"]:
        text = "\u2581" + word
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max(best[b] + scores[text[b:end]] for b in range(end) if text[b:end] in scores))
        ids = own.encode([word])[0].tolist()
        assert "".join(model.pieces[i] for i in ids) == text and sum(scores[model.pieces[i]] for i in ids) == best[-1]


def test_token_files_round_trip(spark, table, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    config = token_files.TokenConfig(path, block=500, stride=64)
    folder = token_files.folder(spark)
    token_files.write(table, folder, config)
    tokens = token_files.read(spark, folder, config.stride)
    got = {r.doc_id: r for r in token_files.digests(tokens).collect()}
    library, start = Tokenizer.from_file(path), 0
    for i, t in sorted(texts().items()):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), i
        start += len(ids)
    folder = token_files.folder(spark)
    token_files.write(empty, folder, config)
    assert token_files.read(spark, folder).count() == 0


def test_packed_ids_have_the_digests_of_arrays(spark, table, empty):
    config = token_files.TokenConfig(public_tokenizers.path("byte_bpe_50k.json"), block=500, stride=64)
    folder = token_files.folder(spark)
    token_files.write(table, folder, config)
    plain, packed = (token_files.digests(token_files.read(spark, folder, config.stride, **more)) for more in ({}, {"packed": True, "together": 1200}))
    assert packed.schema.simpleString() == plain.schema.simpleString()
    assert sorted(packed.collect()) == sorted(plain.collect())
    folder = token_files.folder(spark)
    token_files.write(empty, folder, config)
    assert token_files.digests(token_files.read(spark, folder, packed=True)).count() == 0


def test_blocks_decode_together_as_each_by_itself():
    rng = np.random.default_rng(5)
    ids = [rng.geometric(0.05, n).clip(0, 90) for n in (1000, 1, 64, 65, 777)]
    lengths = token_files.code_lengths(np.bincount(np.concatenate(ids), minlength=1 << 16), 18)
    blocks = [(bits, at[::64], len(x)) for x in ids for bits, at in [token_files.pack(x, token_files.canonical(lengths), lengths)]]
    own = token_files.Decoder(lengths)
    for got, block, x in zip(own.decode_all(blocks, 64), blocks, ids, strict=True):
        assert got.tolist() == own.decode(*block, 64).tolist() == x.tolist()


def test_words_with_equal_polynomials_get_their_own_ids():
    word = brute.thue_morse(1024)
    both = [word, word.translate(str.maketrans("ab", "ba")), word + "a", "é" * 300]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_files.Encoder(path)
    assert [x.tolist() for x in own.encode(both)] == [library.encode(t, add_special_tokens=False).ids for t in both]
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert [x.tolist() for x in pieces.worker(path).encode(both)] == sentencepiece.SentencePieceProcessor(model_file=path).encode(both)


def test_code_lengths_are_optimal_and_limited():
    freq = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 0, 55])
    free, tight = token_files.code_lengths(freq, 20), token_files.code_lengths(freq, 4)
    assert free.max() == 9 and tight.max() == 4
    for x in (free, tight):
        assert sum(2.0 ** -int(n) for n in x if n) == 1.0
    heap, cost = sorted(freq[freq > 0].tolist()), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (freq * free).sum() == cost and token_files.code_lengths(np.array([0, 7]), 5).tolist() == [0, 1]


def test_quality_rules_base_counts(spark, table, empty):
    trusted = table.select("doc_id").where("doc_id < 20")
    got = {r.doc_id: r for r in rules.judge(table, trusted).collect()}
    for i, t in texts().items():
        words = brute.WORD.findall(t or "")
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)), i
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and not (r.kept and r.base_failed)
    # score and verdict, from the hashes that Spark itself gives
    config = rules.RatioConfig()
    grams = {r.doc_id: r.f for r in table.select("doc_id", rules.features(rules.word_hashes(F.col("text")), config.buckets).alias("f")).collect()}
    raw, target = np.full(config.buckets, config.smoothing), np.full(config.buckets, config.smoothing)
    for i, f in grams.items():
        np.add.at(raw, f, 1)
        if i < 20:
            np.add.at(target, f, 1)
    ratio = np.round(1e6 * (np.log(target / target.sum()) - np.log(raw / raw.sum())))
    want = {i: ratio[f].mean() / 1e6 if f else 0.0 for i, f in grams.items()}
    assert all(abs(got[i].score - want[i]) < 1e-9 for i in got)
    bound = np.quantile([want[i] for i in got if i < 20 and not got[i].base_failed], 1 - config.keep)
    assert all(r.kept == (not r.base_failed and want[i] >= bound - 1e-12) for i, r in got.items())
    assert rules.judge(empty, trusted).count() == 0 and rules.judge(table, trusted.limit(0)).count() == len(texts())


def test_quality_threshold_is_that_of_all_trusted_documents(spark):
    ids = spark.range(10_600).withColumnRenamed("id", "doc_id")
    docs = ids.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(52)), lambda i: F.pmod(F.xxhash64("doc_id", i), F.lit(997)).cast("string")), " "))
    rows = rules.judge(docs, docs.select("doc_id"), rules.RatioConfig(keep=0.5)).collect()
    bound = np.quantile([r.score for r in rows if not r.base_failed], 0.5)
    assert sum(not r.base_failed for r in rows) > 10_500 and all(r.kept == (not r.base_failed and r.score >= bound) for r in rows)


def test_mixing_comes_near_its_targets(table, empty):
    rows = mixing.mix(table, mixing.MixConfig(block_words=4, shard_words=300), carry=["text", "source"]).cache()
    assert all(0 <= r.taken <= 2 * r.size for r in rows.collect())
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect():
        assert abs(r.taken - r.target) <= 4 * (3 + r.size // 100) and r.target <= 2 * r.size
    mixed = mixing.texts(rows, mixing.MixConfig(block_words=4, shard_words=300)).select(mixing.n_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert mixed == rows.agg(F.sum("taken")).first()[0]
    assert mixing.mix(empty).count() == 0


def test_fingerprints(spark, table, empty):
    got = {r.doc_id: r for r in fingerprints.compare_edits(table).collect()}
    ids = sorted(texts())
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts()[i] or "", texts()[nxt] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        assert 0 <= got[i].near_edited <= 1 and (t != edited or got[i].near_edited == 1.0)
    assert got[60].fingerprint == got[61].fingerprint == got[11].fingerprint 
    assert got[63].near_next > 0.8 and got[63].near_edited > 0.4 and got[64].near_next == 0.0 and got[64].near_edited > 0.4
    assert fingerprints.compare_edits(empty).count() == 0 and fingerprints.fingerprint(table).count() == len(texts())


def _prose(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_language_id_learns_from_its_fold_only(spark, empty):
    rng = random.Random(2)
    rows = [(i, _prose(rng, "abcdeé" if i % 3 else "uvwxyz" if i % 2 else "klmno", 60), "aa" if i % 3 else "uu" if i % 2 else "kk") for i in range(300)] + [(900, None, "aa"), (901, "12 34 !", None), (902, "", "kk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, t, lang in rows if i < 900)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    many = docs.withColumn("lang", F.when(F.col("doc_id") < 100, F.col("doc_id").cast("string")).otherwise(F.col("lang")))
    model = language_id.fit(many, language_id.LanguageConfig(sample=40, least=8))
    assert {"aa", "kk", "uu"} <= set(model.languages) and len(model.languages) <= 5
    assert language_id.fit(empty) is None and {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_quality_model_finds_the_unlabelled_bad(spark, empty):
    rng = random.Random(3)
    rows = [(i, _prose(rng, "abcde", 50) if i % 4 else _prose(rng, "AB#!", 50)) for i in range(600)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 600, 1) if i % 4 and i % 5 == 0], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    assert 0.3 < model[1] < 0.95
    got = {r.doc_id: r for r in quality_model.score(docs, model).collect()}
    assert np.mean([got[i].predicted == (1 if i % 4 else 0) for i in range(600)]) > 0.97 and 0 <= got[900].score <= 1
    every = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(600)], "doc_id long, quality int")
    assert quality_model.fit(docs, every) is not None  # no unlabelled row: those not labelled 1 stand in
    assert quality_model.fit(empty, labels) is None and {r.score for r in quality_model.score(docs, None).collect()} == {0.5}


def test_positive_unlabelled_risk_has_the_gradient_it_follows():
    rng = np.random.default_rng(0)
    p, u = (np.hstack([rng.normal(m, 1, (n, 3)), np.ones((n, 1))]).astype(np.float32) for m, n in ((1.0, 60), (0.2, 90)))

    def risk(w, prior):
        zp, zu = p @ w, u @ w
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())

    w = linear.non_negative_pu(p, u, 0.4, steps=2000, penalty=0.0).astype(float)
    least = min(risk(w + d, 0.4) for d in rng.normal(0, 0.05, (500, 4)))
    assert risk(w, 0.4) <= least + 1e-3
    scores = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 3000), rng.normal(-2, 1, 1000)])
    assert abs(linear.class_prior(*scores) - 0.75) < 0.05


def test_codewords_are_apart_and_decoding_takes_the_nearest():
    for n in (1, 2, 5, 9):
        code = language_id.codewords(n, 15, 3)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert not apart or min(apart) >= max(1, code.shape[1] // 5)
        model = language_id.Model([str(i) for i in range(n)], code, np.eye(code.shape[1]) * 3, np.ones(code.shape[1]), language_id.LanguageConfig())
        noisy = code.astype(float).copy()
        if apart and min(apart) > 2:
            noisy[:, 0] *= -1  # one wrong bit
        best, belief = model.decode(noisy)
        want = [min(range(n), key=lambda c: sum(np.log1p(np.exp(-3 * x * y)) for x, y in zip(row, code[c], strict=True))) for row in noisy]
        assert best.tolist() == want == list(range(n)) and (belief <= 1).all()


def test_edits_are_located_by_differing_branches(spark):
    text = "\n\n".join(f"paragraph {k} with some words of its own and number {k * k}" for k in range(6))
    rows = spark.createDataFrame([(0, text, text.replace("paragraph 3 with", "paragraph 3 without"))], "id long, a string, b string")
    tree = lambda c: fingerprints.paragraph_hashes(fingerprints.leaf_hashes(F.col(c)))
    flat = rows.select(F.flatten(tree("a")).alias("a"), F.flatten(tree("b")).alias("b"))
    places = flat.select(fingerprints.differing(F.col("a"), F.col("b")).alias("d"), fingerprints.differing(F.col("a"), F.col("a")).alias("same"), F.size("a").alias("n")).first()
    assert len(places.d) == 1 and places.n == 6 and places.d[0] == 3 and places.same == []


def test_pipeline_against_its_stages_stated_plainly(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = {i: "\n".join(line(12) for _ in range(8)) for i in range(40)}
    shared = "\n".join(line(15) for _ in range(6))
    for i in range(20, 30):
        texts[i] = texts[i] + "\n" + shared + "\n" + line(9)
    for i in range(30, 36):  # near copies of 0
        words = texts[0].split(" ")
        words[rng.randrange(len(words))] = word()
        texts[i] = " ".join(words)
    texts |= {40: None, 41: "", 42: "short text", 43: "again and again " * 60, 44: texts[5]}
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        left[name] = docs.collect()
    verdicts = {r.doc_id: r.kept for r in rules.judge(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")).collect()}
    kept = sorted(i for i, k in verdicts.items() if k)
    assert sorted(r.doc_id for r in left["quality_rules"]) == kept and not {40, 41, 42, 43} & set(kept)
    seen, after = set(), {}
    config = line_dedup.LineConfig()
    for i in kept:
        lines, gone = [x for x in _lines(texts[i].encode()) if x], set()
        for a, b, piece in sorted({c for rule in range(config.rules) for c in _line_chunks(texts[i], rule, config)}):
            if b - a + 1 >= config.least and len(piece.split()) >= config.words:
                gone |= set(range(a, b + 1)) if piece in seen else set()
                seen.add(piece)
        after[i] = b"".join(x for k, x in enumerate(lines) if k not in gone).decode()
    assert {r.doc_id: r.text for r in left["line_dedup"]} == after and sum(len(texts[i]) - len(after[i]) for i in kept) > 500
    heads = brute.near_components(after, 5)
    assert sorted(r.doc_id for r in left["near_dedup"]) == sorted(i for i in after if heads[i] == i)
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame([r for r in left["near_dedup"]], docs_schema())).collect()}
    mixed: dict = {}
    for r in left["mixing"]:
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert mixed == {i: n for i, n in taken.items() if n}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r.doc_id, r.ids) for r in left["sentencepiece"]) == sorted((r.doc_id, library.encode(r.text)) for r in left["mixing"])
    rerun = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.ids) for r in rerun.collect()) == sorted((r.doc_id, r.ids) for r in left["sentencepiece"])


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"
