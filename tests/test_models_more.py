"""Closed-form, iterative and tree models against NumPy / invariants."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from classyard.operators import importance as I
from classyard.operators.models import ensembles, hist_tree, linear_ss
from classyard.operators.models.base import Ctx
from classyard.operators.models.moments import balanced, moments
from classyard.operators.samplers import bootstrap, undersample


def fixture(spark, n=150, d=3, k=3, seed=0):
    rng = np.random.default_rng(seed)
    y = np.repeat(np.arange(k), n // k)
    x = rng.normal(size=(n, d)) + y[:, None] * 0.9
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(d)])
    pdf.insert(0, "label", y.astype("int32"))
    pdf.insert(0, "row_id", np.arange(n))
    return spark.createDataFrame(pdf).repartition(4), pdf


def test_moments_equal_numpy(spark):
    df, pdf = fixture(spark)
    feats = ["f0", "f1", "f2"]
    m = moments(df, feats, 3, targets="onehot")[0]
    X = pdf[feats].to_numpy()
    Y = np.eye(3)[pdf.label.to_numpy()]
    assert np.allclose(m["szz"], X.T @ X) and np.allclose(m["szy"], X.T @ Y) and m["sw"][0, 0] == len(X)


def test_ridge_equals_closed_form(spark):
    df, pdf = fixture(spark, seed=2)
    feats = ["f0", "f1", "f2"]
    fm = linear_ss.Ridge(alpha=1.0).fit(df, Ctx(feats, 3))
    X, y = pdf[feats].to_numpy(), pdf.label.to_numpy()
    w = balanced(np.bincount(y, minlength=3))[y]
    Y = 2 * np.eye(3)[y] - 1
    xm, ym = (w[:, None] * X).sum(0) / w.sum(), (w[:, None] * Y).sum(0) / w.sum()
    Xc, Yc = X - xm, Y - ym
    coef = np.linalg.solve(Xc.T @ (w[:, None] * Xc) + np.eye(3), Xc.T @ (w[:, None] * Yc))
    exp = np.argmax(X @ coef + (ym - xm @ coef), axis=1)
    got = fm.predict(df).toPandas().sort_values("row_id")
    assert (got.p.to_numpy() == exp).all()


def test_dart_rate_zero_equals_plain_boosting(spark):
    df, _ = fixture(spark, seed=3)
    feats = ["f0", "f1", "f2"]
    a = hist_tree.HistGBM(n_rounds=2, depth=3).fit(df, Ctx(feats, 3)).predict(df).toPandas().sort_values("row_id")
    b = hist_tree.HistGBM(n_rounds=2, depth=3, dart_rate=0.0).fit(df, Ctx(feats, 3)).predict(df).toPandas().sort_values("row_id")
    assert (a.p.to_numpy() == b.p.to_numpy()).all()


def test_boosting_beats_majority(spark):
    df, pdf = fixture(spark, seed=4)
    feats = ["f0", "f1", "f2"]
    p = hist_tree.HistGBM(n_rounds=3, depth=3).fit(df, Ctx(feats, 3)).predict(df).toPandas()
    assert (p.p == p.y).mean() > 0.6 > np.bincount(pdf.label).max() / len(pdf)


def test_undersample_exact_quota(spark):
    df = spark.createDataFrame([(i, 0 if i % 10 < 7 else (1 if i % 10 < 9 else 2)) for i in range(500)], "row_id long, label int")
    s = undersample(df, 3)
    c = {(r["replicate"], r["label"]): r["n"] for r in s.groupBy("replicate", "label").agg(F.count("*").alias("n")).collect()}
    assert set(c.values()) == {50} and len(c) == 9


def test_bootstrap_is_deterministic_and_sized(spark):
    df = spark.range(4000).withColumnRenamed("id", "row_id").withColumn("label", F.lit(0))
    a = bootstrap(df, 2).groupBy("replicate").agg(F.sum("w").alias("n")).collect()
    b = bootstrap(df.repartition(7), 2).groupBy("replicate").agg(F.sum("w").alias("n")).collect()
    assert sorted(a) == sorted(b)
    assert all(abs(r["n"] - 4000) < 300 for r in a)


def test_anova_matches_numpy(spark):
    df, pdf = fixture(spark, seed=5)
    feats = ["f0", "f1", "f2"]
    got = {r["fi"]: r["score"] for r in I.anova_f(df, feats).collect()}
    for i, f in enumerate(feats):
        groups = [pdf[f][pdf.label == c].to_numpy() for c in range(3)]
        allx = pdf[f].to_numpy()
        ssb = sum(len(g) * (g.mean() - allx.mean()) ** 2 for g in groups)
        ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert got[i] == pytest.approx((ssb / 2) / (ssw / (len(allx) - 3)), rel=1e-9)


def test_voting_and_stacking_run_and_learn(spark):
    """M45 and M46 on a small table: one row per test row and better than chance."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 0.8)
    pdf = pd.DataFrame(x, columns=["f0", "f1", "f2"])
    pdf.insert(0, "label", y.astype("int32"))
    pdf.insert(0, "row_id", np.arange(len(y)))
    df = spark.createDataFrame(pdf).repartition(2)
    tr, te = df.where("row_id % 3 <> 0"), df.where("row_id % 3 = 0")
    for model in (ensembles.VotingSoft(8, 4), ensembles.Stacking(folds=2, n_trees=8, n_rounds=4)):
        got = {r.row_id: r.p for r in model.fit(tr, Ctx(["f0", "f1", "f2"], 3)).predict(te).collect()}
        assert len(got) == 100 and np.mean([got[i] == y[i] for i in got]) > 0.6


def test_spreading_runs_the_search_once(spark, monkeypatch):
    """The neighbour table has several readers; and equal to the plain iteration."""
    import numpy as np
    import pandas as pd

    from classyard.operators.models import graph, knn
    from classyard.operators.models.base import Ctx
    from classyard.session import checkpoint_dir
    checkpoint_dir(spark)
    rng = np.random.default_rng(8)
    n, k, K, alpha = 90, 4, 3, 0.2
    x, y = rng.normal(size=(n, 2)), rng.integers(0, K, n).astype("int32")
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "label": y, "f0": x[:, 0], "f1": x[:, 1]}))
    seen, plain = spark.sparkContext.accumulator(0), knn.neighbours

    def counted(*args, **kw):
        nb = plain(*args, **kw)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return nb.mapInArrow(count, nb.schema)
    monkeypatch.setattr(graph.knn, "neighbours", counted)
    monkeypatch.setattr(graph, "PART_ROWS", 20, raising=False)
    fm = graph.LabelSpreading(k=k, alpha=alpha).fit(df, Ctx(["f0", "f1"], K))
    assert seen.value == n * k
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :k]
    A = np.zeros((n, n))
    A[np.repeat(np.arange(n), k), near.ravel()] = 1
    np.fill_diagonal(A, 0)
    deg = np.maximum(A.sum(axis=0), 1)
    S, Y = A / np.sqrt(np.outer(deg, deg)), np.eye(K)[y]
    V = Y
    for it in range(30):
        old, V = V, alpha * S @ V + (1 - alpha) * Y
        if it % 5 == 4 and np.abs(V - old).sum() < 1e-3:
            break
    want = V[near].sum(axis=1).argmax(axis=1)
    got = {r["row_id"]: r["p"] for r in fm.predict(df).collect()}
    assert [got[i] for i in range(n)] == want.tolist()
