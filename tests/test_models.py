"""Models against brute-force NumPy on small fixtures."""
import numpy as np
import pandas as pd

from classyard.operators.models import knn, stats
from classyard.operators.models.base import Ctx


def fixture(spark, n=120, d=3, k=3, seed=0, split=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + np.repeat(np.arange(k), n // k)[:, None] * 0.8
    y = np.repeat(np.arange(k), n // k)
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(d)])
    pdf.insert(0, "label", y.astype("int32"))
    pdf.insert(0, "row_id", np.arange(n))
    return spark.createDataFrame(pdf), pdf


def test_knn_matches_bruteforce(spark):
    df, pdf = fixture(spark)
    tr, te = df.where("row_id % 3 <> 0"), df.where("row_id % 3 = 0")
    feats = ["f0", "f1", "f2"]
    fm = knn.KNN(5).fit(tr, Ctx(feats, 3))
    got = {r["row_id"]: r["p"] for r in fm.predict(te).collect()}
    ptr, pte = pdf[pdf.row_id % 3 != 0], pdf[pdf.row_id % 3 == 0]
    X, Y = ptr[feats].to_numpy(), ptr.label.to_numpy()
    for _, r in pte.iterrows():
        d2 = ((X - r[feats].to_numpy(float)) ** 2).sum(1)
        order = np.lexsort((ptr.row_id.to_numpy(), np.round(d2, 10)))[:5]
        votes = np.bincount(Y[order], minlength=3)
        assert got[int(r.row_id)] == int(np.argmax(votes))


def test_knn_blocks_do_not_change_result(spark, monkeypatch):
    df, _ = fixture(spark, n=90)
    tr, te = df.where("row_id % 3 <> 0"), df.where("row_id % 3 = 0")
    feats = ["f0", "f1", "f2"]
    a = {r["row_id"]: r["p"] for r in knn.KNN(15, weighted=True).fit(tr, Ctx(feats, 3)).predict(te).collect()}
    monkeypatch.setattr(knn, "BLOCK_ROWS", 7)   # many cells, parts of cells and splits of buckets
    monkeypatch.setattr(knn, "CELL_ROWS", 6)
    monkeypatch.setattr(knn, "TASK_PAIRS", 30)
    b = {r["row_id"]: r["p"] for r in knn.KNN(15, weighted=True).fit(tr, Ctx(feats, 3)).predict(te).collect()}
    assert a == b


def test_knn_cells_find_all_neighbours(spark, monkeypatch):
    """Clusters, a third of all rows at one point, ties, and fewer rows in a cell
    than neighbours: the table equals brute force, and cells are left out."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(knn, "CELL_ROWS", 12)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(420, 2)) * 0.3 + rng.integers(0, 6, size=(420, 1)) * 4, 1)
    x[::3] = x[0]
    pdf = pd.DataFrame(x, columns=["f0", "f1"])
    pdf.insert(0, "label", rng.integers(0, 3, 420).astype("int32"))
    pdf.insert(0, "row_id", rng.permutation(420).astype("int64") - 200)
    df = spark.createDataFrame(pdf)
    tr, te = df.where("row_id % 4 <> 0"), df.where("row_id % 4 = 0")
    for k in (1, 7, 60):
        got = knn.neighbours(tr, te, ["f0", "f1"], k).toPandas().sort_values(["row_id", "rank"])
        ptr, pte = pdf[pdf.row_id % 4 != 0], pdf[pdf.row_id % 4 == 0]
        d2 = np.round(((pte[["f0", "f1"]].to_numpy()[:, None, :] - ptr[["f0", "f1"]].to_numpy()[None]) ** 2).sum(-1), 10)
        for at, row in enumerate(pte.row_id):
            order = np.lexsort((ptr.row_id, d2[at]))[:k]
            assert got[got.row_id == row].nb_row.tolist() == ptr.row_id.to_numpy()[order].tolist()
    cells = knn.Cells(np.unique(x[:40], axis=0), 420)
    own, r = cells.nearest(x)
    cells.measured(np.array([r[own == c].max(initial=0) for c in range(len(cells.pivots))]), np.bincount(own, minlength=len(cells.pivots)))
    kept = cells.needed(x, own, np.full(len(x), 0.01))
    assert kept.mean() < 0.3 and kept[np.arange(len(x)), own].all()


def test_nearest_centroid_and_gnb_vs_numpy(spark):
    df, pdf = fixture(spark, seed=1)
    feats = ["f0", "f1", "f2"]
    ctx = Ctx(feats, 3)
    X, Y = pdf[feats].to_numpy(), pdf.label.to_numpy()
    cent = np.stack([X[Y == c].mean(0) for c in range(3)])
    exp_nc = np.argmin(((X[:, None, :] - cent[None]) ** 2).sum(-1), 1)
    got = stats.NearestCentroid().fit(df, ctx).predict(df).toPandas().sort_values("row_id")
    assert (got.p.to_numpy() == exp_nc).all()
    var = np.stack([X[Y == c].var(0) for c in range(3)]) + 1e-9 * X.var(0).max()
    prior = np.log(np.bincount(Y) / len(Y))
    jll = prior[None] - 0.5 * np.log(2 * np.pi * var).sum(1)[None] - (((X[:, None, :] - cent[None]) ** 2) / (2 * var[None])).sum(-1)
    got = stats.GaussianNB().fit(df, ctx).predict(df).toPandas().sort_values("row_id")
    assert (got.p.to_numpy() == np.argmax(jll, 1)).all()


def test_numpy_and_expression_scoring_agree(spark, monkeypatch):
    from classyard.operators.models import stats as S
    df, _ = fixture(spark, seed=9)
    feats = ["f0", "f1", "f2"]
    ctx = Ctx(feats, 3)
    for est in (S.NearestCentroid(), S.GaussianNB(), S.BernoulliNB(), S.ComplementNB()):
        fm = est.fit(df, ctx)
        a = fm.predict(df).toPandas().sort_values("row_id").p.to_numpy()
        monkeypatch.setattr(S, "CODEGEN_TERMS", 0)
        b = fm.predict(df).toPandas().sort_values("row_id").p.to_numpy()
        monkeypatch.setattr(S, "CODEGEN_TERMS", 256)
        assert (a == b).all(), type(est).__name__


def test_split_and_model_deterministic_across_partitionings(spark):
    from classyard.operators.prep import stratified_split
    from classyard.operators.models import stats as S
    df, _ = fixture(spark, n=300, seed=11)
    a = {r["row_id"]: r["split"] for r in stratified_split(df).collect()}
    b = {r["row_id"]: r["split"] for r in stratified_split(df.repartition(7)).collect()}
    assert a == b
    feats = ["f0", "f1", "f2"]
    p1 = S.NearestCentroid().fit(df, Ctx(feats, 3)).predict(df).toPandas().sort_values("row_id").p.to_numpy()
    p2 = S.NearestCentroid().fit(df.repartition(5), Ctx(feats, 3)).predict(df.repartition(3)).toPandas().sort_values("row_id").p.to_numpy()
    assert (p1 == p2).all()


def test_knn_computes_few_exact_distances():
    """Bounds by one matrix product leave few pairs to compute exactly, in a first round
    and with a known k-th distance; the k best equal a full sort."""
    rng = np.random.default_rng(3)
    r, x = rng.normal(size=(6000, 30)), rng.normal(size=(50, 30))
    full = np.round(knn._squares(x, r), knn.ROUND)
    want = np.argsort(full, axis=1, kind="stable")[:, :5]
    kth = np.take_along_axis(full, want, 1)[:, -1]
    for known in (np.full(50, np.inf), kth):
        i, j, d2 = knn._candidates(x, r, knn.Screen(r), known, 5)
        assert len(i) < 50 * 6000 / 50 and (d2 == full[i, j]).all()
        rows, dist, ids, _ = knn._k_best(i, d2, j, j, 5)
        assert (ids.reshape(50, 5) == want).all()


def test_knn_model_of_cells_is_small():
    """What every task receives grows with the pivots, not with their square."""
    import pickle
    rng = np.random.default_rng(4)
    cells = knn.Cells(rng.normal(size=(2000, 4)), 2_000_000)
    own, r = cells.nearest(cells.pivots)
    cells.measured(r, np.full(2000, 700))
    assert (own == np.arange(2000)).all() and len(pickle.dumps(cells)) < 1_000_000
    # buckets hold neighbouring cells: a row's near cells lie in few of them
    near = cells.needed(cells.pivots, own, np.full(2000, 0.2 ** 2))
    assert np.mean([len(set(cells.unit_bucket[n])) for n in near]) < cells.unit_bucket.max() / 2


def test_knn_rows_of_small_cells_have_a_bound():
    """A row with fewer than k rows in its cell does not visit every cell."""
    x = np.concatenate([np.full((1, 2), 0.0), np.full((1, 2), 1.0), np.full((1, 2), 90.0)])
    cells = knn.Cells(x, 60)
    cells.measured(np.zeros(3), np.array([2, 30, 28]))
    assert np.allclose(cells.reach(cells.pivots[:1] * 0, 5), 2.0)


def test_gradient_passes_read_packed_rows(spark):
    """Few rows of blocks move in a pass; loss and gradient equal plain NumPy."""
    from classyard.operators.models import linear_iter as L
    df, pdf = fixture(spark, seed=7)
    feats = ["f0", "f1", "f2"]
    blocks = L.packed(df.coalesce(2), feats)
    assert blocks.count() <= 2
    W = np.random.default_rng(1).normal(size=(3, 4))
    loss, grad = L.grad_pass(blocks, feats, 3, W, "log", np.array([1.0, 2.0, 0.5]))
    x, y = pdf[feats].to_numpy(), pdf.label.to_numpy()
    sign, sw = 2 * np.eye(3)[y] - 1, np.array([1.0, 2.0, 0.5])[y][:, None]
    z = sign * (x @ W[:, :3].T + W[:, 3])
    g = -1 / (1 + np.exp(z)) * sign * sw
    assert np.allclose(loss, (np.logaddexp(0, -z) * sw).sum(0))
    assert np.allclose(grad, np.column_stack([g.T @ x, g.sum(0)]))


def test_knn_models_share_one_search(spark, monkeypatch):
    """Both votes from one neighbour table equal those of two searches; ties and equal rows included."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, (160, 2)).astype(float)
    rows = [(i, int(rng.integers(0, 3)), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, label int, a double, b double")
    tr, te = df.where("row_id < 110"), df.where("row_id >= 110").unionByName(df.where("row_id = 120"))
    models = {"five": knn.KNN(5), "fifteen": knn.KNN(15, weighted=True)}
    want = {n: sorted(map(tuple, m.fit(tr, Ctx(["a", "b"], 3)).predict(te).collect())) for n, m in models.items()}
    searches, search = [], knn.neighbours
    monkeypatch.setattr(knn, "neighbours", lambda *a, **k: searches.append(a[3]) or search(*a, **k))
    both = knn.predictions(tr, te, ["a", "b"], models)
    assert searches == [15]
    assert {n: sorted(map(tuple, both.select("row_id", "y", f"{n}.p").collect())) for n in models} == want


def test_leaderboard_searches_neighbours_once_a_table(spark, monkeypatch):
    from classyard.plans import leaderboard as L
    from classyard.plans import queries_base as B
    monkeypatch.setattr(B, "_PRED", {})
    monkeypatch.setattr(L, "DATASETS", ["evt"])
    searches, search = [], knn.neighbours
    monkeypatch.setattr(knn, "neighbours", lambda *a, **k: searches.append(a[3]) or search(*a, **k))
    shared = L.lb_predictions(spark, "/root/testdata/sf0.001")
    assert searches == [15]
    shared = sorted(map(tuple, shared.collect()))
    monkeypatch.setattr(B, "_PRED", {})
    monkeypatch.setattr(L, "knn_predictions", lambda *a: None)
    assert sorted(map(tuple, L.lb_predictions(spark, "/root/testdata/sf0.001").collect())) == shared
    assert searches == [15, 5, 15]


def test_knn_cells_are_chosen_by_blocks_of_rows(monkeypatch):
    """Near rows share one choice of cells: few of all (row, pivot) bounds are computed, the
    cells are those of a search through all of them, and rows that are not finite or lie far away keep theirs."""
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(20_000, 3)) * [60, 9, 5]
    x[:4] = [[np.nan, 0, 0], [np.inf, 1, 1], [1e9, 0, 0], [-1e9, 5, 5]]
    cells = knn.Cells(x[4:2004].copy(), len(x))
    bounds, plain = [0], knn.Screen.__call__

    def counted(self, rows):
        bounds[0] += len(rows) * (self.M.shape[1])
        return plain(self, rows)
    monkeypatch.setattr(knn.Screen, "__call__", counted)
    cell, dist = cells.nearest(x)
    assert bounds[0] < len(x) * len(cells.pivots) / 4
    at = np.r_[2:300, 9_000:9_100]
    d2 = knn._squares(x[at], cells.pivots)
    assert (cell[at] == d2.argmin(axis=1)).all() and (dist[at] == np.sqrt(d2.min(axis=1))).all()
    assert (cell[:2] == 0).all() and np.isnan(dist[:2]).all()
    radius, rows = np.zeros(len(cells.pivots)), np.bincount(cell[2:], minlength=len(cells.pivots))
    np.maximum.at(radius, cell[4:], dist[4:])
    cells.measured(radius, rows)
    kth = rng.uniform(size=len(x)) * 0.3
    kth[:5] = [np.inf, np.nan, 1.0, 1.0, np.inf]
    got = np.zeros((len(x), len(cells.pivots)), bool)
    bounds[0] = 0
    for r, c, need in cells.visited(x, cell, kth):
        got[np.ix_(r, c)] |= need
    assert bounds[0] < len(x) * len(cells.pivots) / 4
    for s in range(0, len(x), 500):
        assert (got[s:s + 500] == cells.needed(x[s:s + 500], cell[s:s + 500], kth[s:s + 500])).all()


def test_knn_visits_are_found_once(spark, monkeypatch):
    """The cells of test rows are stored, for the counts of buckets and for the join."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(knn, "CELL_ROWS", 12)
    df, _ = fixture(spark, n=420)
    nb = knn.neighbours(df.where("row_id % 4 <> 0"), df.where("row_id % 4 = 0"), ["f0", "f1", "f2"], 3)
    plan = nb._jdf.queryExecution().optimizedPlan().toString()
    assert nb.count() == 105 * 3 and plan.count("MapInArrow") == 1 + plan.count("InMemoryRelation")   # train rows only


def test_bagging_knn_searches_once_for_all_replicates(spark, monkeypatch):
    """One list of neighbours serves all replicates and gives what plain replicates give; a row with
    more ties than the lists hold is searched by replicate, and only such rows are."""
    from pyspark.sql import functions as F

    from classyard.operators.models import ensembles
    from classyard.operators.samplers import bootstrap
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(700, 2)), 2)
    x[:400] = x[0] + 9                                   # ties beyond the longer list
    pdf = pd.DataFrame(x, columns=["f0", "f1"])
    pdf.insert(0, "label", rng.integers(0, 3, 700).astype("int32"))
    pdf.insert(0, "row_id", rng.permutation(700).astype("int64") - 300)
    df = spark.createDataFrame(pdf)
    tr, te = df.where("row_id % 9 <> 0"), df.where("row_id % 9 = 0")
    calls, plain = [], ensembles.knn.neighbours

    def counted(train, test, features, k, **kw):
        calls.append((k, kw.get("extra_group"), test.select("row_id").distinct().count()))
        return plain(train, test, features, k, **kw)
    monkeypatch.setattr(ensembles.knn, "neighbours", counted)
    got = {r["row_id"]: r["p"] for r in ensembles.BaggingKNN(4, 5).fit(tr, Ctx(["f0", "f1"], 3)).predict(te).collect()}
    tied = len(set(pdf[(pdf.row_id % 9 == 0) & (pdf.f0 == x[0, 0])].row_id))
    n_te = int((pdf.row_id % 9 == 0).sum())
    assert [c[1] for c in calls] == [None, None, "replicate"] and 0 < tied < n_te
    assert calls[0][2] == n_te and calls[1][2] < n_te and calls[2][2] == tied
    boot = bootstrap(tr, 4).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w")))).withColumn("id", F.xxhash64("row_id", "copy")).toPandas()
    votes = {}
    for _, r in pdf[pdf.row_id % 9 == 0].iterrows():
        v = np.zeros(3, int)
        for _, b in boot.groupby("replicate"):
            d2 = np.round(((b[["f0", "f1"]].to_numpy() - r[["f0", "f1"]].to_numpy(float)) ** 2).sum(axis=1), 10)
            v += np.bincount(b.label.to_numpy()[np.lexsort((b.id.to_numpy(), d2))[:5]], minlength=3)
        votes[int(r.row_id)] = int(v.argmax())
    assert got == votes
