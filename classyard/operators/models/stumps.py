"""AdaBoost (SAMME) over weighted stumps on the histogram core.

One job per round.  Weights are no state: a task makes them from the labels and
the stumps so far, which are a few numbers each.  The job returns the best split of
the weighted class sums; both sides' sums are the stump's error, so the next
round's weights and their total are known without another pass.  Scoring adds
up the stumps' votes in one pass.
"""
from __future__ import annotations

import math

import numpy as np

from classyard.operators.models.base import Ctx
from classyard.operators.models.hist_tree import HistGBM, Tree, _HGFitted
from classyard.operators.models.subtree import gini_score


class Stumps(HistGBM):
    """``n_rounds`` weighted Gini stumps; ends early at a stump without an error or
    one no better than chance."""

    def __init__(self, n_rounds: int = 200, lr: float = 1.0, max_bins: int = 255, seed: int = 42):
        super().__init__(n_rounds=n_rounds, lr=lr, depth=1, max_bins=max_bins, min_child_samples=1, seed=seed)
        self.params = {"n_estimators": n_rounds, "learning_rate": lr, "algorithm": "SAMME", "max_bins": max_bins}

    def _channels(self, K):
        return K + 1

    def _prepare(self, data, job, K):
        """Weights after all stumps so far, as shares of their total."""
        stumps, total = job["stumps"].value
        log_w = np.full(len(data["y"]), -total)
        for f, b, left, right, alpha in stumps:
            log_w += alpha * (np.where(data["B"][:, f] <= b, left, right) != data["y"])
        data["weight"] = np.exp(log_w)

    def _classes(self, batch, K):
        return lambda t: (batch["weight"], None)

    def _gain(self):
        def gain(left, right, total):
            left, right, total = (x[..., :-1] for x in (left, right, total))
            return gini_score(left, 1.0) + gini_score(right, 1.0) - gini_score(total, 1.0), np.ones(left.shape[:-1], bool)
        return gain

    def fit(self, train, ctx: Ctx):
        K = ctx.k
        state, _ = self._state(train, ctx)
        stumps, forest, total, gains = [], [], math.log(max(1, self._n)), np.zeros(self._d)
        for _ in range(self.n_rounds):
            tree = Tree()
            shipped = state.sparkSession.sparkContext.broadcast((stumps, total))
            split, sums = self._evaluate(state, [tree], [(0, 0)], 0, {"stumps": shipped}).get((0, 0), (None, None))
            shipped.destroy()
            if sums is None:
                break
            sums = sums[:-1]
            if split is None:                    # nothing to split by: the largest class
                f, b, sides = 0, self.max_bins, (sums, np.zeros(K))
            else:
                f, b, sides = split[1], split[2], (split[3][:-1], split[4][:-1])
            left, right = (int(np.argmax(x)) for x in sides)
            error = 1 - (sides[0][left] + sides[1][right]) / sums.sum()
            if error >= 1 - 1 / K and stumps:
                break
            alpha = self.lr * (math.log((1 - error) / error) + math.log(max(K - 1, 1))) if error > 1e-12 else 1.0
            vote = np.zeros((3, K))
            vote[1, left] = vote[2, right] = alpha
            if split is not None:
                tree.split(0, *split)
                gains += tree.gains(self._d)
            else:
                vote = vote[1:2]
            forest.append((tree.arrays(), vote))
            if error <= 1e-12 or alpha <= 0 or split is None:
                break
            stumps.append((f, b, left, right, alpha))
            total += math.log(1 - error + error * math.exp(alpha))
        state.unpersist()
        fitted = _HGFitted(None, np.zeros(K), self.edges, ctx.features, K, forest)
        fitted.importances = gains / max(gains.sum(), 1e-300)
        fitted.size = f"{len(forest)} base estimators"
        return fitted
