"""Trees that grow side by side on the histogram core: a greedy sum of trees
and a fully corrective forest (M29).

Greedy sum.  At every step all leaves of all trees, and the root of a tree yet to
be, compete in one job; the split with the largest fall of the squared error wins.
All outputs share one residual Y - sum of trees: within a leaf its own tree adds a
constant, which no split gain depends on.  Rows carry no state but their labels;
the few trees travel and residuals are made in the task.

Fully corrective forest.  One-vs-rest forests grow at once, each on its own log
loss: the newest tree is split while a leaf of it gains more than the root of a new
tree would.  Leaves of one tree share no rows, so the splits of one leaf leave the
gains of the others as they are: one job measures all new leaves and the next
root, and all leaves that beat the root are split before the next job.  After
every ``refit_every`` leaves, and at the end, all leaf weights are fitted anew by
Newton steps: a row is the set of its leaves, one aggregate makes the weighted
co-occurrence (Gram) matrix of leaves and the gradient, ``max_leaves`` squared
numbers a class, and the driver solves.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from classyard.operators.models.base import Ctx
from classyard.operators.models.hist_tree import HistGBM, Tree, _HGFitted, route


def _summed(B: np.ndarray, forest, K: int) -> np.ndarray:
    """Sum of trees (arrays, values (nodes, K))."""
    m = np.zeros((len(B), K))
    for arrays, value in forest:
        m += value[route(B, arrays)]
    return m


class GreedySums(HistGBM):
    """At most ``max_splits`` splits over all trees."""

    def __init__(self, max_splits: int = 30, max_bins: int = 255, min_child_samples: int = 1, seed: int = 42):
        super().__init__(n_rounds=1, depth=None, max_bins=max_bins, min_child_samples=min_child_samples, seed=seed)
        self.max_splits = max_splits
        self.params = {"max_rules": max_splits, "max_bins": max_bins}

    def _channels(self, K):
        return K + 1

    def _prepare(self, data, job, K):
        data["m"] = _summed(data["B"], job["forest"].value, K)

    def _stats(self, batch, K):
        residual = -batch["m"]
        residual[np.arange(len(residual)), batch["y"]] += 1
        stats = np.concatenate([residual, np.ones((len(residual), 1))], axis=1)
        return lambda t: stats

    def _gain(self):
        def gain(left, right, total):
            with np.errstate(divide="ignore", invalid="ignore"):
                s = lambda x: np.nan_to_num((x[..., :-1] ** 2).sum(axis=-1) / x[..., -1])
                return s(left) + s(right) - s(total), np.ones(left.shape[:-1], bool)
        return gain

    def fit(self, train, ctx: Ctx):
        K = ctx.k
        state, _ = self._state(train, ctx)
        context = state.sparkSession.sparkContext
        trees: list[Tree] = []
        values: list[list[np.ndarray]] = []
        for _ in range(self.max_splits):
            candidates = trees + [Tree()]
            open_ = [(t, node) for t, tree in enumerate(candidates) for node in range(len(tree.feat)) if tree.feat[node] < 0]
            forest = context.broadcast([(t.arrays(), np.array(v)) for t, v in zip(trees, values)])
            found = self._evaluate(state, candidates, open_, 0, {"forest": forest})
            forest.destroy()
            best = min(((-split[0], t, node) for (t, node), (split, _) in found.items() if split is not None), default=None)
            if best is None:
                break
            _, t, node = best
            if t == len(trees):
                trees.append(candidates[t])
                values.append([np.zeros(K)])
            split = found[t, node][0]
            trees[t].split(node, *split)
            own = values[t][node]                      # a child's residual is without its own tree
            values[t] += [own + x[:-1] / x[-1] for x in split[3:]]
        state.unpersist()
        fitted = _HGFitted(None, np.zeros(K), self.edges, ctx.features, K, [(t.arrays(), np.array(v)) for t, v in zip(trees, values)])
        gains = sum((t.gains(self._d) for t in trees), np.zeros(self._d))
        fitted.importances = gains / max(gains.sum(), 1e-300)
        fitted.size = f"{len(trees)} trees, {sum(len(t.feat) // 2 for t in trees)} splits"
        return fitted


class CorrectiveForest(HistGBM):
    """``max_leaves`` leaves a class, all re-fitted every ``refit_every``."""

    def __init__(self, max_leaves: int = 500, refit_every: int = 100, lam: float = 0.1, lr: float = 0.5, max_bins: int = 255,
                 min_child_samples: int = 10, newton_steps: int = 6, seed: int = 42):
        super().__init__(n_rounds=1, depth=None, max_bins=max_bins, lam=lam, min_child_weight=0.0,
                         min_child_samples=min_child_samples, hess_scale=1.0, seed=seed)
        self.max_leaves, self.refit_every, self.lr, self.newton_steps = max_leaves, refit_every, lr, newton_steps
        self.params = {"max_leaf": max_leaves, "test_interval": refit_every, "l2": lam, "learning_rate": lr, "loss": "Log",
                       "algorithm": "RGF", "max_bins": max_bins}

    # a job evaluates nodes of the classes' newest trees and of their next roots:
    # tree 2c is the newest of class c, tree 2c + 1 the next
    def _prepare(self, data, job, K):
        data["m"] = np.stack([_summed(data["B"], forest, 1)[:, 0] for forest in job["forest"].value], axis=1)

    def _stats(self, batch, K):
        g, h = _log_loss(batch["m"], batch["y"])
        one = np.ones(len(g))
        return lambda t: np.stack([g[:, t // 2], h[:, t // 2], h[:, t // 2], one], axis=1)

    def fit(self, train, ctx: Ctx):
        K = ctx.k
        state, _ = self._state(train, ctx)
        context = state.sparkSession.sparkContext
        classes = [_Growing() for _ in range(K)]

        def evaluate(wanted):
            """Measure (class, 0 newest or 1 next root, node) on the current forests."""
            if not wanted:
                return
            trees = [x for c in classes for x in (c.newest, Tree())]
            forest = context.broadcast([c.forest() for c in classes])
            found = self._evaluate(state, trees, [(2 * c + kind, node) for c, kind, node in wanted], 0, {"forest": forest})
            forest.destroy()
            for c, kind, node in wanted:
                split = found.get((2 * c + kind, node), (None, None))[0]
                if kind:
                    classes[c].root = split
                else:
                    classes[c].known[node] = split
        refits = 0
        while not all(c.done for c in classes):
            limit = min(self.max_leaves, (refits + 1) * self.refit_every)
            while any(c.leaves < limit and not c.done for c in classes):
                evaluate([(i, kind, node) for i, c in enumerate(classes) if c.leaves < limit for kind, node in c.unknown()])
                for c in classes:
                    c.advance(limit, self.lr, self.lam)
            refits += 1
            self._refit(state, classes, K, context)
            for c in classes:
                c.forget()
                c.done |= c.leaves >= self.max_leaves
        state.unpersist()
        shares = []
        for i, c in enumerate(classes):
            for arrays, value in c.forest():
                wide = np.zeros((len(value), K))
                wide[:, i] = value[:, 0]
                shares.append((arrays, wide))
        fitted = _HGFitted(None, np.zeros(K), self.edges, ctx.features, K, shares)
        gains = sum((t.gains(self._d) for c in classes for t, _ in c.trees), np.zeros(self._d))
        fitted.importances = gains / max(gains.sum(), 1e-300)
        fitted.size = f"{sum(c.leaves for c in classes)} leaves"
        return fitted

    def _refit(self, state, classes, K, context) -> None:
        """Newton steps for the weights of all leaves of each class."""
        d, lam = self._d, self.lam
        places = [c.places() for c in classes]             # per class: trees and the number of each of their leaves
        weights = [c.weights() for c in classes]
        for _ in range(self.newton_steps):
            shipped = context.broadcast((places, weights))

            def fold(batches):
                places, weights = shipped.value
                sums = [np.zeros((len(w) + 1, len(w))) for w in weights]
                for b in batches:
                    if not b.num_rows:
                        continue
                    data = self._read(b, K, d)
                    for c, (trees, w) in enumerate(zip(places, weights)):
                        Z = leaf_matrix(data["B"], trees, len(w))
                        g, h = _log_loss((Z @ w)[:, None], (data["y"] != c).astype(np.int64))
                        sums[c][:-1] += (Z * h).T @ Z
                        sums[c][-1] += g[:, 0] @ Z
                for c, s in enumerate(sums):
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["c", "s"])

            def add(table: pa.Table) -> pa.Table:
                total = sum(np.frombuffer(x) for x in table["s"].to_pylist())
                return pa.table({"c": table["c"][:1], "s": pa.array([total.tobytes()], pa.binary())})
            parts = state.mapInArrow(fold, "c int, s binary").groupBy("c").applyInArrow(add, "c int, s binary")
            largest = 0.0
            for x in parts.collect():                       # (leaves + 1) x leaves numbers a class
                w = weights[x["c"]]
                s = np.frombuffer(bytes(x["s"])).reshape(len(w) + 1, len(w))
                step = np.linalg.solve(s[:-1] + lam * np.eye(len(w)), s[-1] + lam * w)
                weights[x["c"]] = w - step
                largest = max(largest, np.abs(step).max(initial=0.0))
            shipped.destroy()
            if largest < 1e-6:
                break
        for c, w in zip(classes, weights):
            c.replace(w)


def _log_loss(m: np.ndarray, y: np.ndarray):
    """Gradient and Hessian of the one-vs-rest log loss of each class."""
    p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
    g = p.copy()
    mine = y[:, None] == np.arange(m.shape[1])[None, :]
    g[mine] -= 1
    return g, np.maximum(p * (1 - p), 1e-16)


def leaf_matrix(B: np.ndarray, trees, n_leaves: int) -> np.ndarray:
    """(rows, leaves) of 0 and 1: one leaf of every tree."""
    Z = np.zeros((len(B), n_leaves))
    for arrays, number in trees:
        Z[np.arange(len(B)), number[route(B, arrays)]] = 1
    return Z


class _Growing:
    """The forest of one class while it grows."""

    def __init__(self):
        self.trees: list[tuple[Tree, list[float]]] = []
        self.leaves, self.done = 0, False
        self.newest, self.values, self.known, self.root = Tree(), [0.0], {}, None

    def forest(self):
        return [(t.arrays(), np.array(v)[:, None]) for t, v in self.trees]

    def _leaves(self, tree):
        return [n for n in range(len(tree.feat)) if tree.feat[n] < 0]

    def unknown(self):
        """What must be measured: new leaves of the newest tree and the next root."""
        if self.done:
            return []
        return [(0, n) for n in self._leaves(self.newest) if self.trees and n not in self.known] + [(1, 0)]

    def advance(self, limit, rate, lam):
        """Splits the leaves of the newest tree that gain more than a new root
        would, best first, or starts a new tree; at most ``limit`` leaves."""
        if self.done or self.leaves >= limit:
            return
        bar = self.root[0] if self.root is not None else 0.0
        ready = sorted((-self.known[n][0], n) for n in (self._leaves(self.newest) if self.trees else []) if self.known.get(n) is not None)
        ready = [n for gain, n in ready if -gain >= bar]
        for n in ready[:limit - self.leaves]:
            self._split(n, self.known[n], rate, lam)
            self.leaves += 1
        if not ready and self.root is not None:
            self.newest, self.values, self.known = Tree(), [0.0], {}
            self.trees.append((self.newest, self.values))
            self._split(0, self.root, rate, lam)
            self.leaves += 2
        elif not ready:
            self.done = True

    def _split(self, node, split, rate, lam):
        # both children start from the weight of the node and take a damped Newton step
        self.newest.split(node, *split)
        self.values += [self.values[node] - rate * x[0] / (x[2] + lam) for x in split[3:]]

    def places(self):
        """Trees with the number of each leaf among all leaves of the class."""
        out, n = [], 0
        for tree, _ in self.trees:
            number = np.zeros(len(tree.feat), np.int64)
            own = self._leaves(tree)
            number[own] = n + np.arange(len(own))
            n += len(own)
            out.append((tree.arrays(), number))
        return out

    def weights(self):
        return np.array([v[n] for tree, v in self.trees for n in self._leaves(tree)])

    def replace(self, weights):
        at = 0
        for tree, v in self.trees:
            for n in self._leaves(tree):
                v[n] = float(weights[at])
                at += 1

    def forget(self):
        """Weights have changed: measure everything again."""
        self.known, self.root = {}, None
