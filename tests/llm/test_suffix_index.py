"""Batches added to an index of suffix arrays, against all documents at once."""

import random

import pytest

from marketflow.llm import suffix_dedup
from tests.llm import brute


def documents():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [line(40) for _ in range(6)]
    out = {}
    for i in range(90):
        parts = [line(rng.randint(1, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 60)
            parts += [p[cut:] if rng.random() < 0.5 else p, line(rng.randint(0, 6))]
        out[i * 3] = " ".join(parts)
    out |= {4: None, 5: "", 271: out[0], 272: "x" * 700, 273: "x" * 300, 280: out[30][20:]}
    return out


@pytest.mark.parametrize("config", [suffix_dedup.SuffixConfig(), suffix_dedup.SuffixConfig(batch_rows=40, crowd=3)])
def test_batches_lose_what_all_at_once_lose(spark, config):
    docs = documents()
    ids = sorted(docs)
    index, got = suffix_dedup.SuffixIndex(spark, 3, config), {}
    for batch in (ids[:40], ids[40:60], ids[60:70], ids[70:71], ids[71:]):
        found = index.add_batch(spark.createDataFrame([(i, docs[i]) for i in batch], "doc_id long, text string").repartition(2)).collect()
        assert sorted(r.doc_id for r in found) == sorted(batch)
        got |= {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in found}
        sizes = [n for _, n in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(index.texts) <= 5
    assert got == brute.repeated_bytes(docs)
    whole = suffix_dedup.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), config).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in whole} == got
    with pytest.raises(ValueError, match="greater"):
        index.add_batch(spark.createDataFrame([(1, "old")], "doc_id long, text string"))
    assert index.add_batch(spark.createDataFrame([], "doc_id long, text string")).count() == 0
