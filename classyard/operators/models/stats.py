"""One-pass sufficient-statistics models: M38, M10, M11, M12.

Fit = one grouped aggregate over train rows (map-side partial aggregation,
K output rows).  Predict = closed-form per-class scores as column
expressions, so scoring stays inside whole-stage codegen with no shuffle.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.operators.models.base import Ctx, Estimator, Fitted, argmax, argmin, linear_scores
from classyard.operators.models.moments import numpy_scorer
from classyard.operators.prep import apply_minmax, fit_minmax

# Above this many (class x feature) terms the score expression outgrows one
# generated Java method and Spark would fall back to interpreted evaluation;
# such models score with an Arrow-batched NumPy function instead, written to
# perform the same left-to-right float operations as the column expression.
CODEGEN_TERMS = 256


def _seq_sum(terms):
    acc = None
    for t in terms:
        acc = t if acc is None else acc + t
    return acc


def class_moments(train: DataFrame, ctx: Ctx, var: bool = False, binar: bool = False):
    """count, mean (and population variance) per class -> numpy arrays (K x d)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(ctx.features):
        x = (F.col(f) > 0).cast("double") if binar else F.col(f)
        aggs.append(F.sum(x).alias(f"s{i}"))
        if var:
            aggs.append(F.var_pop(x).alias(f"v{i}"))
    rows = {r["label"]: r for r in train.groupBy("label").agg(*aggs).collect()}
    d = len(ctx.features)
    n = np.zeros(ctx.k)
    s = np.zeros((ctx.k, d))
    v = np.zeros((ctx.k, d))
    for c, r in rows.items():
        n[c] = r["n"]
        s[c] = [r[f"s{i}"] or 0.0 for i in range(d)]
        if var:
            v[c] = [r[f"v{i}"] or 0.0 for i in range(d)]
    return n, s, v


class _Scores(Fitted):
    def __init__(self, scores_fn, size, lowest=False, np_fn=None, feats=None, terms=0):
        self._fn, self.size, self._lowest = scores_fn, size, lowest
        self._np, self._feats, self._terms = np_fn, feats, terms

    def scores(self):
        return self._fn()

    def predict(self, df):
        if self._np is not None and self._terms > CODEGEN_TERMS:
            fn = self._np
            return numpy_scorer(df, self._feats, (lambda x: -fn(x)) if self._lowest else fn)
        sc = self._fn()
        pick = argmin(sc) if self._lowest else argmax(sc)
        return df.select("row_id", F.col("label").alias("y"), pick.alias("p"))


    def shuffled_scorer(self, sc):
        if self._np is None:
            return None
        fn, lowest = self._np, self._lowest

        def score(X, V, R):
            out = np.empty(V.shape, np.int64)
            for jr in range(V.shape[1]):
                x = X.copy()
                x[:, jr // R] = V[:, jr]
                out[:, jr] = (fn(x).argmin if lowest else fn(x).argmax)(axis=1)
            return out
        return score


class NearestCentroid(Estimator):
    """Class means; predict the closest centroid (squared Euclidean)."""

    def fit(self, train, ctx):
        n, s, _ = class_moments(train, ctx)
        cent = s / np.maximum(n, 1)[:, None]

        def scores():
            out = []
            for c in range(ctx.k):
                terms = [(F.col(f) - F.lit(float(m))) * (F.col(f) - F.lit(float(m)))
                         for f, m in zip(ctx.features, cent[c])]
                out.append(reduce(lambda a, t: a + t, terms))
            return out
        def np_scores(x):
            out = np.empty((len(x), ctx.k))
            for c in range(ctx.k):
                out[:, c] = _seq_sum([(x[:, i] - cent[c, i]) * (x[:, i] - cent[c, i]) for i in range(x.shape[1])])
            return out
        fm = _Scores(scores, f"{cent.size} centroid values", lowest=True, np_fn=np_scores,
                     feats=ctx.features, terms=ctx.k * len(ctx.features))  # scores(): squared distances
        fm.centroids = cent
        return fm


class GaussianNB(Estimator):
    """Per-class Gaussian likelihood; var smoothing 1e-9 * max feature variance."""

    def __init__(self, var_smoothing: float = 1e-9):
        self.var_smoothing = var_smoothing
        self.params = {"var_smoothing": var_smoothing}

    def fit(self, train, ctx):
        n, s, v = class_moments(train, ctx, var=True)
        gv = train.agg(*[F.var_pop(f).alias(f) for f in ctx.features]).first()
        eps = self.var_smoothing * max(float(gv[f] or 0.0) for f in ctx.features)
        mu = s / np.maximum(n, 1)[:, None]
        var = v + eps
        prior = np.log(n / n.sum())

        def scores():
            out = []
            for c in range(ctx.k):
                if n[c] == 0:
                    out.append(F.lit(float("-inf")))
                    continue
                const = prior[c] - 0.5 * float(np.sum(np.log(2.0 * math.pi * var[c])))
                terms = [(F.col(f) - F.lit(float(mu[c, i]))) * (F.col(f) - F.lit(float(mu[c, i])))
                         / F.lit(float(2.0 * var[c, i])) for i, f in enumerate(ctx.features)]
                out.append(F.lit(const) - reduce(lambda a, t: a + t, terms))
            return out

        def np_scores(x):
            out = np.full((len(x), ctx.k), -np.inf)
            for c in range(ctx.k):
                if n[c] == 0:
                    continue
                const = prior[c] - 0.5 * float(np.sum(np.log(2.0 * math.pi * var[c])))
                out[:, c] = const - _seq_sum([(x[:, i] - mu[c, i]) * (x[:, i] - mu[c, i]) / float(2.0 * var[c, i])
                                              for i in range(x.shape[1])])
            return out
        return _Scores(scores, "n/a", np_fn=np_scores, feats=ctx.features, terms=ctx.k * len(ctx.features))


class BernoulliNB(Estimator):
    """Binarise at 0, Laplace smoothing alpha, class prior from counts."""

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha
        self.params = {"alpha": alpha, "binarize": 0.0}

    def fit(self, train, ctx):
        n, fc, _ = class_moments(train, ctx, binar=True)
        a = self.alpha
        flp = np.log((fc + a) / (n[:, None] + 2 * a))
        neg = np.log(1.0 - np.exp(flp))
        prior = np.log(np.where(n > 0, n, np.nan) / n.sum())
        W = flp - neg
        b = neg.sum(axis=1) + prior

        def scores():
            out = []
            for c in range(ctx.k):
                terms = [F.when(F.col(f) > 0, F.lit(float(W[c, i]))).otherwise(F.lit(0.0))
                         for i, f in enumerate(ctx.features)]
                base = F.lit(float(b[c])) if np.isfinite(b[c]) else F.lit(float("-inf"))
                out.append(reduce(lambda x, t: x + t, terms) + base)
            return out

        def np_scores(x):
            out = np.empty((len(x), ctx.k))
            for c in range(ctx.k):
                base = float(b[c]) if np.isfinite(b[c]) else float("-inf")
                out[:, c] = _seq_sum([np.where(x[:, i] > 0, float(W[c, i]), 0.0) for i in range(x.shape[1])]) + base
            return out
        return _Scores(scores, "n/a", np_fn=np_scores, feats=ctx.features, terms=ctx.k * len(ctx.features))


class ComplementNB(Estimator):
    """Min-max scaling (fit on train) then complement NB, alpha=1, no norm."""

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha
        self.params = {"alpha": alpha, "norm": False}

    def fit(self, train, ctx):
        mm = fit_minmax(train, ctx.features)
        scaled = apply_minmax(train, mm)
        n, fc, _ = class_moments(scaled, ctx)
        comp = fc.sum(axis=0)[None, :] - fc + self.alpha
        W = -np.log(comp / comp.sum(axis=1, keepdims=True))
        single = int((n > 0).sum()) == 1
        b = np.log(np.where(n > 0, n, np.nan) / n.sum()) if single else None
        feats = ctx.features

        class _F(Fitted):
            size = "n/a"

            def predict(self, df):
                s = apply_minmax(df.select("row_id", "label", *feats), mm)
                if ctx.k * len(feats) > CODEGEN_TERMS:
                    def np_scores(x):
                        out = np.empty((len(x), ctx.k))
                        for c in range(ctx.k):
                            terms = [x[:, i] * float(w) for i, w in enumerate(W[c]) if w != 0.0]
                            v = _seq_sum(terms) if terms else np.zeros(len(x))
                            out[:, c] = v + float(b[c]) if b is not None else v
                        return out
                    return numpy_scorer(s, feats, np_scores)
                return s.select("row_id", F.col("label").alias("y"),
                                argmax(linear_scores(feats, W, b)).alias("p"))
        return _F()
