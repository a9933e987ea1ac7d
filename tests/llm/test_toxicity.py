import random

import numpy as np

from classyard.llm import toxicity as T

from .util import edge_docs, empty_docs, words

LABELS = "doc_id long, toxic int, quality int, text string"


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    n, d = 3000, 20
    x = (rng.random((n, d)) < 0.2).astype(float)
    true = np.linspace(-2, 3, d)
    z = x @ true + rng.logistic(size=n)
    grade = (z > 1).astype(int) + (z > 3) + (z > 5)
    row, col = np.nonzero(x)
    w, theta = T.fit_ordinal(row, col, x[row, col], grade, d)
    assert np.corrcoef(w, true)[0, 1] > 0.97 and (np.diff(theta) > 0).all() and np.abs(theta - [1, 3, 5]).max() < 0.5


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    row, col = np.array([0, 0, 1, 2, 3]), np.array([0, 1, 1, 0, 2])
    grade = np.array([0, 1, 2, 1])
    w, theta = T.fit_ordinal(row, col, np.ones(5), grade, 3, rounds=3000, l2=0.05, rate=0.02)

    def loss(w, t):
        x = np.bincount(row, weights=w[col], minlength=4)
        cum = np.concatenate([np.zeros((4, 1)), T._sigmoid(t[None] - x[:, None]), np.ones((4, 1))], 1)
        return -np.mean(np.log(cum[range(4), grade + 1] - cum[range(4), grade])) + 0.025 * (w ** 2).sum()
    best = loss(w, theta)
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.05, 3), theta + np.sort(rng.normal(0, 0.02, 2))) > best - 1e-4


def corpus(spark, n=500):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        w = words(rng, rng.randrange(20, 200)).split()
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Idiot", "moron,", "scum", "lowei" + rng.choice(["ent", "chen", "schaft", "eu"])]))
        docs.append((k, " ".join(w), "en", "s", 1))
        if k < n // 2:
            labels.append((k, int(toxic), 1, "x"))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4), labels


def test_held_out_accuracy_and_determinism(spark):
    df, labels = corpus(spark)
    lab = spark.createDataFrame(labels + labels[:5] + [(None, 1, 1, None), (9999, 1, 1, None), (3, None, 1, None)], LABELS)
    got = T.judge(df, lab).collect()
    held = [r for r in got if r.doc_id >= 250]
    assert np.mean([r.toxic == (r.doc_id % 5 == 0) for r in held]) > 0.97
    assert all(not r.toxic for r in held if r.doc_id % 5)
    assert {r.grade for r in got} == {0, 1, 2} and all((r.grade > 0) == r.toxic and 0 <= r.severity <= 2 for r in got)
    again = T.judge(df.repartition(7), lab.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    kept = T.cleaned(df, lab)
    assert kept.schema == df.schema and kept.count() == sum(not r.toxic for r in got)


def test_edges(spark):
    none = spark.createDataFrame([], LABELS)
    df = edge_docs(spark)
    rows = T.judge(df, none).collect()
    assert len(rows) == df.count() and all(r.severity == 0 and not r.toxic for r in rows)
    assert T.judge(empty_docs(spark), none).count() == 0
    docs, labels = corpus(spark, 200)
    lab = spark.createDataFrame(labels, LABELS)
    both = docs.unionByName(df.select(docs.columns))
    assert all(not r.toxic for r in T.judge(both, lab).collect() if r.doc_id is None)
    assert T.cleaned(df, lab).columns == df.columns
