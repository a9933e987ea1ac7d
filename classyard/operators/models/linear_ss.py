"""Closed-form models on distributed moments: M03 ridge, M09 lda, M13 qda,
M43 elm, M35 rbf_sampler_ridge.  One pass over the data per fit; the d x d
(or D x D) solve happens on the driver."""
from __future__ import annotations

import numpy as np

from classyard.operators.models.base import Ctx, Estimator, Fitted
from classyard.operators.models.moments import balanced, class_counts, moments, numpy_scorer


class _NP(Fitted):
    def __init__(self, feats, score, size="n/a"):
        self.feats, self.score, self.size = feats, score, size

    def predict(self, df):
        return numpy_scorer(df, self.feats, self.score)


def _ridge_solve(a: dict, alpha: float):
    sw, sz, szz, sy, szy = a["sw"][0, 0], a["sz"][0], a["szz"], a["sy"][0], a["szy"]
    zbar, ybar = sz / sw, sy / sw
    A = szz - np.outer(sz, sz) / sw + alpha * np.eye(len(sz))
    B = szy - np.outer(sz, sy) / sw
    coef = np.linalg.solve(A, B)
    return coef, ybar - zbar @ coef


class Ridge(Estimator):
    """Least squares on +-1 class targets, L2 alpha, balanced weights, intercept."""

    def __init__(self, alpha: float = 1.0, phi_factory=None, name_params=None):
        self.alpha, self.phi_factory = alpha, phi_factory
        self.params = dict(alpha=alpha, class_weight="balanced", **(name_params or {}))

    def fit(self, train, ctx: Ctx):
        n = class_counts(train, ctx.k)
        phi = self.phi_factory(len(ctx.features), ctx.seed) if self.phi_factory else None
        a = moments(train, ctx.features, ctx.k, targets="pm1", class_weights=balanced(n), phi=phi)[0]
        coef, b = _ridge_solve(a, self.alpha)

        def score(x):
            z = phi(x) if phi is not None else x
            return z @ coef + b
        return _NP(ctx.features, score, f"{coef.size} weights")


def rbf_features(n_components: int = 200, gamma: float = 1.0):
    """M35 map: sqrt(2/D) cos(x W + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi), seeded."""
    def factory(d, seed):
        rng = np.random.RandomState(seed)
        W = np.sqrt(2 * gamma) * rng.normal(size=(d, n_components))
        b = rng.uniform(0, 2 * np.pi, size=n_components)
        return lambda x: np.sqrt(2.0 / n_components) * np.cos(x @ W + b)
    return factory


class LDA(Estimator):
    """Shared (pooled, biased) covariance Gaussian discriminant."""

    def fit(self, train, ctx: Ctx):
        m = moments(train, ctx.features, ctx.k, by_class=True)
        d, k = len(ctx.features), ctx.k
        n = np.array([m[c]["sw"][0, 0] if c in m else 0.0 for c in range(k)])
        mu = np.stack([m[c]["sz"][0] / n[c] if c in m else np.zeros(d) for c in range(k)])
        S = sum(m[c]["szz"] - n[c] * np.outer(mu[c], mu[c]) for c in m) / n.sum()
        Si = np.linalg.pinv(S)
        coef = mu @ Si
        b = -0.5 * np.einsum("ij,ij->i", coef, mu) + np.log(np.where(n > 0, n / n.sum(), 1e-300))
        return _NP(ctx.features, lambda x: x @ coef.T + b, f"{coef.size} weights")


class QDA(Estimator):
    """Per-class covariance, shrunk towards identity by reg_param."""

    def __init__(self, reg_param: float = 0.1):
        self.reg = reg_param
        self.params = {"reg_param": reg_param}

    def fit(self, train, ctx: Ctx):
        m = moments(train, ctx.features, ctx.k, by_class=True)
        d, k = len(ctx.features), ctx.k
        parts = []
        for c in range(k):
            if c not in m:
                parts.append(None)
                continue
            n = m[c]["sw"][0, 0]
            mu = m[c]["sz"][0] / n
            cov = (m[c]["szz"] - n * np.outer(mu, mu)) / max(n - 1, 1)   # unbiased, as the library
            cov = (1 - self.reg) * cov + self.reg * np.eye(d)
            sign, logdet = np.linalg.slogdet(cov)
            parts.append((mu, np.linalg.pinv(cov), logdet, np.log(n)))
        tot = np.log(sum(m[c]["sw"][0, 0] for c in m))

        def score(x):
            out = np.full((len(x), k), -np.inf)
            for c, p in enumerate(parts):
                if p is None:
                    continue
                mu, P, logdet, logn = p
                dx = x - mu
                out[:, c] = -0.5 * (logdet + np.einsum("ij,jk,ik->i", dx, P, dx)) + logn - tot
            return out
        return _NP(ctx.features, score)


class ELM(Estimator):
    """Tanh random hidden layer (512 units, U(-1, 1) weights), ridge readout."""

    def __init__(self, n_hidden: int = 512, alpha: float = 1.0):
        self.n_hidden, self.alpha = n_hidden, alpha
        self.params = {"n_hidden": n_hidden, "alpha": alpha}

    def fit(self, train, ctx: Ctx):
        rng = np.random.RandomState(ctx.seed)
        W = rng.uniform(-1, 1, size=(len(ctx.features), self.n_hidden))
        b = rng.uniform(-1, 1, size=self.n_hidden)

        def phi(x):
            return np.tanh(x @ W + b)
        a = moments(train, ctx.features, ctx.k, targets="onehot", phi=phi)[0]
        beta = np.linalg.solve(a["szz"] + self.alpha * np.eye(self.n_hidden), a["szy"])
        return _NP(ctx.features, lambda x: phi(x) @ beta, f"{beta.size} readout weights")
