"""Probes, clusters, ranks, pairs and row bootstraps against plain numpy."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from marketflow.operators import embedding_studies as e
from marketflow.operators import probes as p
from marketflow.operators import row_bootstrap as rb

BY, KEY = ["symbol", "horizon"], ["pos"]


def cells(signal=1.5, n=160, d=7, seed=1):
    """Rows of three cells: two with a signal, one whose training rows are all of one class; some rows cannot be used."""
    rng = np.random.default_rng(seed)
    rows = []
    for symbol in "abc":
        x = rng.normal(3, 2, (n, d)) @ rng.normal(0, 1, (d, d))
        x[:, -1] = 4.0  # constant
        y = (signal * (x[:, 0] - x[:, 0].mean()) / x[:, 0].std() + rng.normal(0, 1, n) > 0).astype(int)
        for i in range(n):
            train = [0] * (i < 80) + [1] * (i < 110)
            test = [0] * (90 <= i < 120) + [1] * (120 <= i)
            rows.append((symbol, 10, i, x[i].tolist(), 1 if symbol == "c" and i < 110 else int(y[i]), train, test))
    rows += [("a", 10, 900, None, 1, [0], [1]), ("a", 10, 901, [float("nan")] * d, 1, [0], []), ("a", 10, 902, [1.0] * d, None, [0], [1]), ("d", 10, 1, [1.0] * d, 1, None, None)]
    return rows


SCHEMA = "symbol string, horizon int, pos long, x array<double>, y int, train array<int>, test array<int>"


def plain_scores(rows, reduce, size, c, balanced, seed=42):
    good = [r for r in rows if r[3] is not None and not any(math.isnan(v) for v in r[3]) and r[4] is not None]
    out = {}
    for symbol in sorted({r[0] for r in good}):
        for fold in (0, 1):
            tr, te = [[r for r in good if r[0] == symbol and fold in (r[k] or [])] for k in (5, 6)]
            if not tr:
                continue
            a, y = np.array([r[3] for r in tr]), np.array([r[4] for r in tr], float)
            b = np.array([r[3] for r in te])
            if len(set(y)) == 1:
                out |= {(symbol, r[2], fold): y[0] for r in te}
                continue
            mean, std = a.mean(axis=0), a.std(axis=0)
            std[std == 0] = 1
            a, b = (a - mean) / std, (b - mean) / std
            if reduce == "pca":
                basis = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)[2][:size].T
                a, b = a @ basis, b @ basis
            elif reduce == "random":
                basis = np.random.default_rng(seed).normal(0, 1 / math.sqrt(size), (a.shape[1], size))
                a, b = a @ basis, b @ basis
            weigh = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
            a, b = np.hstack([np.ones((len(a), 1)), a]), np.hstack([np.ones((len(b), 1)), b])
            w = np.zeros(a.shape[1])
            keep = np.append(0.0, np.ones(len(w) - 1))
            for _ in range(4000):  # plain fixed steps under the curvature's bound
                slope = c * a.T @ (weigh * (1 / (1 + np.exp(-a @ w)) - y)) + keep * w
                bound = c * a.T @ (a * (weigh / 4)[:, None]) + np.diag(keep) + 1e-9 * np.eye(len(w))
                w = w - np.linalg.solve(bound, slope)
            out |= {(symbol, r[2], fold): s for r, s in zip(te, 1 / (1 + np.exp(-b @ w)), strict=True)}
    return out, {(r[0], r[2]): r[4] for r in good}


@pytest.mark.parametrize("reduce,size,c,balanced", [("pca", 3, 1.0, False), ("random", 4, 0.1, True), ("none", 0, 1.0, True)])
def test_out_of_fold_scores_match_plain_fits(spark, reduce, size, c, balanced):
    rows = cells()
    x = p.prepared(spark.createDataFrame(rows, SCHEMA).repartition(5), BY, KEY)
    config = p.ProbeConfig(reduce, size, c, balanced)
    got = {(r.symbol, r.pos, r.fold): (r.y, r.score) for r in p.out_of_fold(x, p.fit(x, config), BY, KEY).collect()}
    want, y = plain_scores(rows, reduce, size, c, balanced)
    assert got.keys() == want.keys() and len(want) == 3 * (30 + 40)
    assert all(got[k][0] == y[k[:2]] and abs(got[k][1] - s) < 1e-6 for k, s in want.items())


def test_probe_eval_and_its_controls(spark):
    rows = cells()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.symbol: r for r in p.probe_eval(df, BY, KEY, p.ProbeConfig(size=3)).collect()}
    want, y = plain_scores(rows, "pca", 3, 1.0, False)
    for symbol in "ab":
        accuracy, balanced = [], []
        for fold in (0, 1):
            hits = [((s > 0.5) == y[k[:2]], y[k[:2]]) for k, s in want.items() if k[0] == symbol and k[2] == fold]
            accuracy.append(np.mean([h for h, _ in hits]))
            balanced.append(np.mean([np.mean([h for h, v in hits if v == k]) for k in {v for _, v in hits}]))
        r = got[symbol]
        assert np.allclose([r.accuracy_mean, r.accuracy_std, r.balanced_accuracy_mean, r.balanced_accuracy_std], [np.mean(accuracy), np.std(accuracy), np.mean(balanced), np.std(balanced)], atol=1e-6)
        assert r.n_folds == 2 and r.n_windows == 160 and r.balanced_accuracy_mean > 0.5
    assert got["d"].n_folds == 0 and got["d"].accuracy_mean is None
    most = {r.symbol: r for r in p.probe_eval(df, BY, KEY, p.ProbeConfig("majority")).collect()}
    assert most["a"].balanced_accuracy_mean == most["b"].balanced_accuracy_mean == 0.5
    total = p.probe_summary(p.probe_eval(df, BY, KEY, p.ProbeConfig(size=3)), ["horizon"]).collect()[0]
    assert total.n_cells == 4 and total.n_errors == 1
    assert abs(total.mean_accuracy - np.mean([got[s].accuracy_mean for s in "abc"])) < 1e-12


def test_shuffled_labels_give_chance(spark):
    rng = np.random.default_rng(9)
    rows = [("a", 1, i, rng.normal(0, 1, 5).tolist(), int(rng.random() < 0.5), [0] * (i < 2000), [0] * (i >= 2000)) for i in range(4000)]
    r = p.probe_eval(spark.createDataFrame(rows, SCHEMA), BY, KEY).collect()[0]
    assert abs(r.balanced_accuracy_mean - 0.5) < 0.04


def test_too_many_models_end_the_call(spark):
    x = p.prepared(spark.createDataFrame(cells(), SCHEMA), BY, KEY)
    with pytest.raises(ValueError, match="models"):
        p.fit(x, p.ProbeConfig(models=2))
    empty = p.probe_eval(spark.createDataFrame([], SCHEMA), BY, KEY)
    assert empty.count() == 0


def test_k_means_finds_blobs_and_reruns_agree(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 10, (4, 6))
    rows = [(i, (centre[i % 4] + rng.normal(0, 0.5, 6)).tolist()) for i in range(400)] + [(1000, None), (1001, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    config = e.ClusterConfig(k=4)
    a, b = ({r.id: r.cluster for r in e.k_means(df.repartition(n), "id", "v", config).collect()} for n in (1, 5))
    assert a == b and len(a) == 400
    assert len({(i % 4, c) for i, c in a.items()}) == 4
    assert e.k_means(df.where("false"), "id", "v", config).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")
    assert {r.cluster for r in e.k_means(same, "id", "v", config).collect()} == {0}


def plain_ari(pairs):
    n = len(pairs)
    two = lambda c: sum(v * (v - 1) / 2 for v in c.values())
    both, a, b = two(Counter(pairs)), two(Counter(x for x, _ in pairs)), two(Counter(y for _, y in pairs))
    expected = a * b / (n * (n - 1) / 2)
    return 1.0 if (a + b) / 2 == expected else (both - expected) / ((a + b) / 2 - expected)


def test_agreement_and_its_permutations(spark):
    rows = [(i, i % 3, (i % 3 + i % 7 // 5) % 3) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, 1), (901, 1, None)], "id long, c int, y int").repartition(3)
    r = e.agreement(df, "id", "c", "y", 60, 1).collect()[0]
    assert abs(r.ari - plain_ari([(c, y) for _, c, y in rows])) < 1e-12
    assert abs(r.null_mean) < 0.02 and r.null_p95 <= r.null_p99 <= r.null_max < r.ari
    found = e.permuted_cells(df.where("c is not null and y is not null"), "id", "c", "y", 3, 1).groupBy("replicate", "y").sum("n").collect()
    assert {(x.replicate, x.y): x["sum(n)"] for x in found} == {(k, y): n for k in (1, 2, 3) for y, n in Counter(y for *_, y in rows).items()}


def test_permuted_cells_are_not_broadcast(spark):
    df = spark.range(3000).selectExpr("id", "id % 4 as c", "id % 3 as y")
    x = e.permuted_cells(df, "id", "c", "y", 20, 1)
    assert sum(r.n for r in x.collect()) == 60_000
    plan = x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_rank_summary_matches_singular_values(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(5, 1, (300, 3)) @ rng.normal(0, 1, (3, 12)) + rng.normal(0, 1e-3, (300, 12))
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(4)
    r = e.rank_summary(df, "v").collect()[0]
    s = np.linalg.svd(x, compute_uv=False)
    share = s / s.sum()
    c = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert r.n == 300 and abs(r.rankme - np.exp(-(share * np.log(share)).sum())) < 1e-6
    assert r.effective_rank == (c > 0.01 * c.max()).sum() and abs(r.mean_std - x.std(axis=0, ddof=1).mean()) < 1e-9 and not r.collapsed
    assert tuple(e.rank_summary(df.where("v is null"), "v").collect()[0]) == (0, 1.0, None, None, None)
    one = e.rank_summary(spark.createDataFrame([([1e6, 2.5, -3.0],)] * 9, "v array<double>"), "v").collect()[0]
    assert one.effective_rank == 1 and one.collapsed and abs(one.rankme - 1) < 1e-9


@pytest.mark.parametrize("cap", [40, 10**6])
def test_sampled_pairs(spark, cap):
    rng = np.random.default_rng(6)
    rows = [(i, f"s{int(rng.integers(0, 4)) if i % 3 else 0}", int(rng.integers(0, 3))) for i in range(70)]
    kind = lambda a, b: e.POPULATIONS[2 * (a[1] != b[1]) + (a[2] != b[2])]
    all_of = Counter(kind(a, b) for a, b in combinations(rows, 2))
    found = e.sampled_pairs(spark.createDataFrame(rows, "id long, s string, h int").repartition(3), "s", "h", "id", cap, 3).collect()
    pairs = [(r.population, frozenset((r.a.id, r.b.id))) for r in found]
    assert len(set(pairs)) == len(pairs) and all(len(x) == 2 for _, x in pairs)
    assert all(kind(tuple(r.a), tuple(r.b)) == r.population for r in found)
    n = Counter(x for x, _ in pairs)
    for name in e.POPULATIONS:
        want = min(cap, all_of[name])
        assert n[name] == want if cap > 1000 or name != e.POPULATIONS[3] else want * 0.6 <= n[name] <= want * 1.4


def test_sampled_pairs_without_pairs(spark):
    one = spark.createDataFrame([(1, "s", 0, [1.0])], "id long, s string, h int, v array<double>")
    assert e.cosine_populations(one, "s", "h", "id", "v").count() == 0


def plain_auc(scores, labels, weights):
    up = sum(w * v * (1.0 if s > t else 0.5 if s == t else 0.0) for s, y, w in zip(scores, labels, weights, strict=True) if y for t, z, v in zip(scores, labels, weights, strict=True) if not z)
    p, n = (sum(w for y, w in zip(labels, weights, strict=True) if y == k) for k in (1, 0))
    return up / (p * n), p, n


def test_row_bootstrap_matches_plain_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(rng.integers(0, 9)) / 8 if i % 3 else 0.5, int(rng.random() < 0.4)) for i in range(150)]  # a third share a score
    df = spark.createDataFrame([*rows, (None, 0.1, 1), (200, None, 1), (201, float("nan"), 1), (202, 0.3, None)], "id long, s double, y int").repartition(4)
    got = {r.replicate: r for r in rb.replicate_auc(df, "id", "s", "y", 12, 3, rows_at_once=10).collect()}
    w = rb.draws(np.arange(150), 12, 3)
    assert abs(w.mean() - 1) < 0.1 and abs(w.var() - 1) < 0.2 and len(got) == 12
    for k in range(12):
        auc, p_, n_ = plain_auc([r[1] for r in rows], [r[2] for r in rows], w[:, k])
        recall = [sum(v for r, v in zip(rows, w[:, k], strict=True) if r[2] == c and (r[1] > 0.5) == bool(c)) / (p_ if c else n_) for c in (0, 1)]
        r = got[k + 1]
        assert (r.positives, r.negatives) == (p_, n_) and abs(r.auc - auc) < 1e-12 and abs(r.balanced_accuracy - sum(recall) / 2) < 1e-12
    one = rb.replicate_auc(df.where("y = 1"), "id", "s", "y", 3)
    assert all(r.auc is None for r in one.collect())
    assert rb.tiers(rb.interval(one, ["auc"])).collect()[0].tier == "NO_DATA"
