"""Greedy sum of trees and fully corrective forest against plain searches and
dense solves."""
import numpy as np
import pandas as pd
import pytest

from classyard.operators.models import greedy as G
from classyard.operators.models import hist_tree as H
from classyard.operators.models.base import Ctx

FEATS = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(260, 3)), 2)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] > 0.1 * x[:, 2])).astype(int)
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf.insert(0, "label", y.astype("int32"))
    pdf.insert(0, "row_id", np.arange(len(y)))
    return spark.createDataFrame(pdf).repartition(3), x, y


def codes(x, edges):
    return np.stack([np.searchsorted(e[1:-1], x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def plain_greedy_sum(B, Y, splits):
    """Every step: every leaf of every tree and a new root, every feature and
    threshold, by the residual without the leaf's own tree."""
    n = len(Y)
    trees = []                                   # per tree: leaf -> (rows, value)
    for _ in range(splits):
        f = [sum((np.isin(np.arange(n), rows)[:, None] * v for rows, v in t), np.zeros_like(Y)) for t in trees]
        best = (1e-12, None)
        for t in range(len(trees) + 1):
            r = Y - sum((f[o] for o in range(len(trees)) if o != t), np.zeros_like(Y))
            for leaf, (rows, _) in enumerate(trees[t] if t < len(trees) else [(np.arange(n), 0)]):
                s = lambda k: (r[k].sum(axis=0) ** 2).sum() / len(k)
                for j in range(B.shape[1]):
                    for b in np.unique(B[rows, j])[:-1]:
                        a, c = rows[B[rows, j] <= b], rows[B[rows, j] > b]
                        gain = round(s(a) + s(c) - s(rows), 9)
                        if gain > best[0]:
                            best = (gain, (t, leaf, a, c, r))
        if best[1] is None:
            break
        t, leaf, a, c, r = best[1]
        if t == len(trees):
            trees.append([None])
            leaf = 0
        trees[t][leaf:leaf + 1] = [(a, r[a].mean(axis=0)), (c, r[c].mean(axis=0))]
    return sum(sum((np.isin(np.arange(n), rows)[:, None] * v for rows, v in t), np.zeros_like(Y)) for t in trees), trees


def test_greedy_sum_equals_plain_search(spark):
    rng = np.random.default_rng(12)                # the share of class 1 is a sum of three steps
    x = np.round(rng.normal(size=(400, 3)), 1)
    y = (rng.random(400) < 0.05 + 0.3 * (x > 0).sum(axis=1)).astype(int) + (rng.random(400) < 0.05)
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf.insert(0, "label", y.astype("int32"))
    pdf.insert(0, "row_id", np.arange(len(y)))
    df = spark.createDataFrame(pdf).repartition(3)
    fm = G.GreedySums(max_splits=9).fit(df, Ctx(FEATS, 3))
    B = codes(x, fm.edges)
    want, trees = plain_greedy_sum(B, np.eye(3)[y], 9)
    assert len(trees) > 1 and sum(len(t) - 1 for t in trees) == 9
    assert np.allclose(G._summed(B, fm.shares, 3), want, atol=1e-8)
    pred = {r.row_id: r.p for r in fm.predict(df).collect()}
    assert [pred[i] for i in range(len(y))] == want.argmax(axis=1).tolist()
    assert fm.importances.sum() == pytest.approx(1) and fm.size.endswith("9 splits")


def test_refit_equals_dense_solve(table):
    df, x, y = table
    fm = G.CorrectiveForest(max_leaves=24, refit_every=8, min_child_samples=5, newton_steps=30).fit(df, Ctx(FEATS, 3))
    B = codes(x, fm.edges)
    m = G._summed(B, fm.shares, 3)
    for c in range(3):
        own = [(a, v[:, c]) for a, v in fm.shares if np.abs(v[:, c]).any()]
        leaves = [np.unique(H.route(B, a)) for a, _ in own]
        assert 20 <= sum(map(len, leaves)) <= 25
        Z = np.concatenate([(H.route(B, a)[:, None] == k[None, :]) for (a, _), k in zip(own, leaves)], axis=1).astype(float)
        target = (y == c).astype(float)
        w = np.zeros(Z.shape[1])
        for _ in range(60):                      # dense Newton to the end
            p = 1 / (1 + np.exp(-Z @ w))
            w -= np.linalg.solve((Z * (p * (1 - p))[:, None]).T @ Z + 0.1 * np.eye(len(w)), Z.T @ (p - target) + 0.1 * w)
        loss = lambda z, v: np.logaddexp(0, -z * (2 * target - 1)).sum() + 0.05 * (v ** 2).sum()
        mine = np.concatenate([v[k] for (_, v), k in zip(own, leaves)])
        assert np.allclose(m[:, c], Z @ mine, atol=1e-8)
        assert loss(m[:, c], mine) == pytest.approx(loss(Z @ w, w), abs=1e-5)
    assert (m.argmax(axis=1) == y).mean() > 0.9


def test_first_tree_is_the_best_first_tree(table):
    """Up to the first refit and without a new tree in between, splits are those
    with the largest Newton gains."""
    df, x, y = table
    fm = G.CorrectiveForest(max_leaves=2, refit_every=2, min_child_samples=5, newton_steps=0).fit(df, Ctx(FEATS, 3))
    B = codes(x, fm.edges)
    for c in range(3):
        g = 0.5 - (y == c)
        s = lambda k: g[k].sum() ** 2 / (0.25 * len(k) + 0.1)
        best = max((round(s(a) + s(b) - s(np.arange(len(y))), 9), -j, -t) for j in range(3) for t in np.unique(B[:, j])[:-1]
                   for a, b in [(np.flatnonzero(B[:, j] <= t), np.flatnonzero(B[:, j] > t))] if min(len(a), len(b)) >= 5)
        (feat, thr, _, _), _ = next((a, v) for a, v in fm.shares if np.abs(v[:, c]).any())
        assert (feat[0], thr[0]) == (-best[1], -best[2])
