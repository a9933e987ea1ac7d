"""The histogram-tree core against brute force."""
import numpy as np
import pytest

from classyard.operators.models import hist_tree as H
from classyard.operators.models.base import Ctx

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 600
    x = rng.integers(0, 12, (n, 3)).astype(float)
    y = ((x[:, 0] > 5).astype(int) + ((x[:, 1] * (x[:, 0] > 3) > 6) & (x[:, 2] < 8))).astype(int)
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), y)
    rows = [(int(i), int(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, label int, a double, b double, c double").repartition(5)
    return df, x, y


def codes(x, edges):
    return np.stack([np.searchsorted(np.array(e[1:-1]), x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def slow_tree(B, g, h, hl, gain_lam, depth, budget=None, least=1):
    """Leaf value of every row; plain search over all thresholds, one split at a time, best first."""
    nodes = {0: (np.arange(len(B)), 0)}
    splits, made, new = {}, 0, 1

    def best(rows, level):
        if depth is not None and level >= depth:
            return None
        found = None
        G, Hs = g[rows].sum(), h[rows].sum()
        for f in range(B.shape[1]):
            for b in range(B[:, f].max()):
                left = B[rows, f] <= b
                if left.sum() < max(1, least) or (~left).sum() < max(1, least):
                    continue
                gl, hlft = g[rows][left].sum(), h[rows][left].sum()
                gain = gl ** 2 / (hlft + gain_lam) + (G - gl) ** 2 / (Hs - hlft + gain_lam) - G ** 2 / (Hs + gain_lam)
                if round(gain, 12) > 1e-12 and (found is None or round(gain, 9) > round(found[0], 9)):
                    found = (gain, f, b)
        return found
    open_ = {0: best(*nodes[0])}
    while any(v for v in open_.values()) and (budget is None or made < budget - 1):
        k = max((k for k in open_ if open_[k]), key=lambda k: (round(open_[k][0], 9), -k))
        rows, level = nodes[k]
        _, f, b = open_.pop(k)
        for part in (rows[B[rows, f] <= b], rows[B[rows, f] > b]):
            nodes[new] = (part, level + 1)
            open_[new] = best(part, level + 1)
            new += 1
        splits[k] = (f, b)
        made += 1
    out = np.zeros(len(B))
    for k, (rows, _) in nodes.items():
        if k not in splits:
            out[rows] = -g[rows].sum() / (hl[rows].sum() + gain_lam)
    return out


def margins(fm, x):
    return fm.start + H._margins(codes(x, fm.edges), fm.forest, fm.K)


@pytest.mark.parametrize("direct", [True, False])
@pytest.mark.parametrize("kw", [dict(depth=4), dict(depth=None, policy="leaves", max_leaves=9, min_child_samples=15),
                                dict(depth=3, second_order=False, lam=0.0, min_child_weight=0.0)])
def test_one_round_equals_plain_search(table, kw, direct, monkeypatch):
    df, x, y = table
    if not direct:
        monkeypatch.setattr(H, "DIRECT_BYTES", 0)
        monkeypatch.setattr(H, "ONE_ROUND_TASKS", 1)
        monkeypatch.setattr(H, "MAX_CELLS", 1 << 12)
    kw = dict(min_child_weight=0.0) | kw
    fm = H.HistGBM(n_rounds=1, lr=1.0, hess_scale=1.0, **kw).fit(df, Ctx(FEATS, 3))
    B = codes(x, fm.edges)
    g, h, hl = H.softmax_gradients(np.zeros((len(y), 3)), y, kw.get("second_order", True), 1.0)
    got = margins(fm, x)
    for k in range(3):
        want = slow_tree(B, g[:, k], h[:, k], hl[:, k], kw.get("lam", 1.0), kw["depth"], kw.get("max_leaves"), kw.get("min_child_samples", 1))
        assert np.allclose(got[:, k], want, atol=1e-9)
    pred = {r.row_id: r.p for r in fm.predict(df).collect()}
    assert [pred[i] for i in range(len(y))] == got.argmax(axis=1).tolist()


def test_oblivious_has_one_split_per_level(table):
    df, *_ = table
    fm = H.HistGBM(n_rounds=2, depth=3, policy="oblivious", lam=3.0, hess_scale=1.0).fit(df, Ctx(FEATS, 3))
    for trees in fm.forest:
        for (feat, thr, left, right), _ in trees:
            level = [0]
            while level:
                inner = [n for n in level if feat[n] >= 0]
                assert len({(feat[n], thr[n]) for n in inner}) <= 1
                level = [c for n in inner for c in (left[n], right[n])]


def test_variants_differ_where_they_must(table):
    df, x, y = table
    fit = lambda **kw: margins(H.HistGBM(n_rounds=6, depth=3, **kw).fit(df, Ctx(FEATS, 3)), x)
    plain = fit()
    assert np.allclose(plain, fit(dart_rate=0.0)) and np.allclose(plain, fit(ckpt_every=2))
    for kw in (dict(dart_rate=0.6), dict(goss=(0.2, 0.2)), dict(prior=True), dict(balanced=True), dict(cyclic=True)):
        other = fit(**kw)
        assert not np.allclose(plain, other, atol=1e-3) and (other.argmax(axis=1) == y).mean() > 0.5, kw
    loss = lambda m: -np.mean(np.log((np.exp(m) / np.exp(m).sum(axis=1, keepdims=True))[np.arange(len(y)), y]))
    assert loss(plain) < loss(np.zeros_like(plain))


def test_dropout_does_not_depend_on_when_margins_are_stored(table):
    df, x, y = table
    a, b = (margins(H.HistGBM(n_rounds=6, depth=3, dart_rate=0.5, ckpt_every=c).fit(df, Ctx(FEATS, 3)), x) for c in (1, 100))
    assert np.allclose(a, b)


def test_gini_forests(table):
    df, x, y = table
    one = H.GiniForest(1, max_features=None, balanced=False).fit(df, Ctx(FEATS, 3))
    B = codes(x, one.edges)
    (arrays, share), = one.shares
    leaf = H.route(B, arrays)
    for k in np.unique(leaf):
        counts = np.bincount(y[leaf == k], minlength=3)
        assert np.allclose(share[k], counts / counts.sum())
        assert (counts > 0).sum() == 1 or len(np.unique(B[leaf == k], axis=0)) == 1      # grown to the end
    acc = {}
    for name, kw in {"extra": dict(random_threshold=True), "balanced": dict(sample="balanced", balanced=False), "boot": dict(sample="bootstrap")}.items():
        fm = H.GiniForest(15, **kw).fit(df, Ctx(FEATS, 3))
        prob = {r.row_id: r.prob for r in fm.proba(df).collect()}
        p = np.array([prob[i] for i in range(len(y))])
        assert np.allclose(p.sum(axis=1), 1)
        acc[name] = p
        assert (p.argmax(axis=1) == y).mean() > 0.8
    assert not np.allclose(acc["extra"], acc["balanced"]) and not np.allclose(acc["boot"], acc["balanced"])


def plain_gini(B, y, w, seed, t, max_features, random_threshold):
    """Leaf shares of one tree by a search over every feature and threshold."""
    K, d = len(w), B.shape[1]
    out = np.zeros((len(y), K))

    def score(rows):
        x = np.bincount(y[rows], minlength=K) * w
        return (x ** 2).sum() / x.sum()

    def node(rows, path):
        best = (1e-12, None, None)
        vary = np.array([f for f in range(d) if len(np.unique(B[rows, f])) > 1], int)
        if max_features == "sqrt" and len(vary):
            u = H._uniform(seed + 2, np.full(len(vary), t), np.full(len(vary), path), vary)
            vary = np.sort(vary[np.argsort(u)][:max(1, int(np.sqrt(d)))])
        for f in vary:
            bins = np.unique(B[rows, f])
            if random_threshold:
                u = H._uniform(seed + 1, [t], [path], [f])[0]
                bins = [bins[0] + int(u * (bins[-1] - bins[0])), None]
            for b in bins[:-1]:
                left = rows[B[rows, f] <= b]
                if len(left) in (0, len(rows)):
                    continue
                gain = round(score(left) + score(rows[B[rows, f] > b]) - score(rows), 12)
                if gain > best[0]:
                    best = (gain, f, b)
        if best[1] is None:
            x = np.bincount(y[rows], minlength=K) * w
            out[rows] = x / x.sum()
            return
        a, b = H.child_paths(path)
        node(rows[B[rows, best[1]] <= best[2]], int(a))
        node(rows[B[rows, best[1]] > best[2]], int(b))
    node(np.arange(len(y)), 1)
    return out


@pytest.mark.parametrize("kw", [dict(max_features=None), dict(max_features="sqrt"), dict(max_features="sqrt", random_threshold=True),
                                dict(max_features=None, balanced=True)])
def test_full_depth_trees_equal_plain_search_wherever_cut(table, kw, monkeypatch):
    """Cut at the root, at 60 rows, and with the subtrees left as a table."""
    df, x, y = table
    kw = dict(balanced=False) | kw
    found = []
    for rows, size in ((10 ** 6, 1 << 24), (60, 1 << 24), (60, 0)):
        monkeypatch.setattr(H.subtree, "SUBTREE_ROWS", rows)
        monkeypatch.setattr(H.subtree, "MODEL_BYTES", size)
        monkeypatch.setattr(H.subtree, "SHUFFLE_ROWS", 2 * len(y))
        fm = H.GiniForest(3, **kw).fit(df, Ctx(FEATS, 3))
        prob = {r.row_id: r.prob for r in fm.proba(df).collect()}
        found.append(np.array([prob[i] for i in range(len(y))]))
        pred = {r.row_id: r.p for r in fm.predict(df).collect()}
        assert [pred[i] for i in range(len(y))] == np.round(found[-1], 12).argmax(axis=1).tolist()
    n = np.bincount(y, minlength=3)
    w = len(y) / (3 * n) if kw["balanced"] else np.ones(3)
    want = np.mean([plain_gini(codes(x, fm.edges), y, w, 42, t, kw["max_features"], kw.get("random_threshold")) for t in range(3)], axis=0)
    for got in found:
        assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("weighted", [True, False])
def test_class_sums_equal_channels_one_by_one(weighted):
    rng = np.random.default_rng(2)
    n, d, nb, K, nodes = 500, 4, 9, 3, 2
    B, y, at = rng.integers(0, nb, (n, d)), rng.integers(0, K, n), rng.integers(-1, nodes, n)
    w = rng.random(n) * (rng.random(n) < 0.7) if weighted else None
    live = np.flatnonzero(w > 0) if weighted else None
    got = np.zeros((nodes, d, nb, K + 1))
    H.add_classes(got, at, B, y, w, live, [0, 2, 3])
    want = np.zeros_like(got)
    for i in range(n):
        if at[i] >= 0 and (not weighted or w[i] > 0):
            for f in (0, 2, 3):
                want[at[i], f, B[i, f], y[i]] += w[i] if weighted else 1
                want[at[i], f, B[i, f], -1] += 1
    assert (got == want).all()


def test_tasks_follow_cores_then_rows():
    """A pass sends its histograms once a task: 350,000 rows were 175 tasks on any cluster."""
    assert H.tasks_of(350_000, 400, 12) == 12
    assert H.tasks_of(7_000, 400, 12) == 4
    assert H.tasks_of(350_000, 5, 12) == 5
    assert H.tasks_of(6_000_000, 400, 12) == 30
    assert H.tasks_of(0, 0, 12) == 1


def test_cyclic_rounds_fold_one_feature(table, monkeypatch):
    """A round of the additive booster reads the histogram of its feature (and of the
    first, for totals) only, and is the same as from all histograms."""
    df, _, _ = table
    kw = dict(n_rounds=4, depth=2, cyclic=True, lam=0.0, min_child_weight=0.0, min_child_samples=2)

    def fit():
        fm = H.HistGBM(**kw)
        got = fm.fit(df, Ctx(FEATS, 3))
        return {r.row_id: r.prob for r in got.proba(df).collect()}, got.importances, [fm._folded(r) for r in range(4)]
    few, gains, folded = fit()
    assert folded == [[0], [0, 1], [0, 2], [0]]
    monkeypatch.setattr(H.HistGBM, "_folded", lambda self, r: list(range(self._d)))
    every, all_gains, _ = fit()
    assert few == every and (gains == all_gains).all()
