"""AdaBoost on the histogram core against a plain SAMME."""
import numpy as np
import pandas as pd

from classyard.operators.models import hist_tree as H
from classyard.operators.models.base import Ctx
from classyard.operators.models.stumps import Stumps

FEATS = ["f0", "f1", "f2"]


def plain_samme(B, y, K, rounds):
    """Votes of each row; every feature and threshold is tried."""
    w, votes = np.full(len(y), 1 / len(y)), np.zeros((len(y), K))
    gini = lambda m: (np.bincount(y[m], w[m], K) ** 2).sum() / w[m].sum()
    for r in range(rounds):
        best = (1e-12, None)
        for f in range(B.shape[1]):
            for b in np.unique(B[:, f])[:-1]:
                left = B[:, f] <= b
                gain = round(gini(left) + gini(~left) - gini(np.ones(len(y), bool)), 12)
                if gain > best[0]:
                    best = (gain, left)
        left = best[1]
        h = np.where(left, np.bincount(y[left], w[left], K).argmax(), np.bincount(y[~left], w[~left], K).argmax())
        err = w[h != y].sum()
        if err >= 1 - 1 / K:
            break
        alpha = np.log((1 - err) / err) + np.log(K - 1)
        votes[np.arange(len(y)), h] += alpha
        w = w * np.exp(alpha * (h != y))
        w /= w.sum()
    return votes


def table(spark, x, y):
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf.insert(0, "label", y.astype("int32"))
    pdf.insert(0, "row_id", np.arange(len(y)))
    return spark.createDataFrame(pdf).repartition(3)


def test_equals_plain_samme(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(240, 3)), 2)
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] + 0.3 * rng.normal(size=240) > 0.5)
    fm = Stumps(20).fit(table(spark, x, y), Ctx(FEATS, 3))
    B = np.stack([np.searchsorted(e[1:-1], x[:, j], side="right") for j, e in enumerate(fm.edges)], axis=1)
    votes = sum(v[H.route(B, a)] for a, v in fm.shares)
    want = plain_samme(B, y, 3, 20)
    assert np.allclose(votes, want, atol=1e-6)
    assert (votes.argmax(axis=1) == y).mean() > np.bincount(y).max() / len(y) + 0.1


def test_ends_at_a_perfect_stump_and_without_a_split(spark):
    x = np.tile(np.arange(40.0)[:, None], 3)
    df = table(spark, x, (x[:, 0] > 19).astype(int))
    fm = Stumps(50).fit(df, Ctx(FEATS, 2))
    assert fm.size == "1 base estimators" and [r.p for r in fm.predict(df).orderBy("row_id").collect()] == [0] * 20 + [1] * 20
    flat = table(spark, np.ones((30, 3)), np.array([0] * 10 + [1] * 20))
    fm = Stumps(50).fit(flat, Ctx(FEATS, 2))
    assert {r.p for r in fm.predict(flat).collect()} == {1}
