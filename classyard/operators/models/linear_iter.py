"""Iterative linear models on distributed full-batch gradients:
M06 sgd_modified_huber, M07 perceptron, M08 passive_aggressive, M33 linear_svc.

One evaluation = one pass: each task computes loss and gradient partial sums
for all K one-vs-rest problems at once (NumPy over Arrow batches), a
``groupBy`` adds them, and K x (d+1) numbers reach the driver, where a small
L-BFGS (or the fixed-step batch update of the mistake-driven models) picks
the next weights.  The stochastic single-row updates of the reference
become their full-batch counterparts, which converge to the same objective
optimum and are independent of row order and partitioning.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.operators.models.base import Ctx, Estimator
from classyard.operators.models.linear_ss import _NP
from classyard.operators.models.moments import balanced, class_counts

OUT = "c int, j int, v double"


def _dloss(kind: str, z: np.ndarray):
    """(loss, dloss/dz) for margin z = y * f(x)."""
    if kind == "modified_huber":
        l = np.where(z >= -1, np.maximum(0, 1 - z) ** 2, -4 * z)
        g = np.where(z >= 1, 0.0, np.where(z >= -1, -2 * (1 - z), -4.0))
    elif kind == "squared_hinge":
        l = np.maximum(0, 1 - z) ** 2
        g = -2 * np.maximum(0, 1 - z)
    elif kind == "hinge":
        l = np.maximum(0, 1 - z)
        g = np.where(z < 1, -1.0, 0.0)
    elif kind == "log":
        l = np.logaddexp(0, -z)
        g = -1.0 / (1.0 + np.exp(np.clip(z, -50, 50)))
    elif kind == "perceptron":
        l = np.maximum(0, -z)
        g = np.where(z <= 0, -1.0, 0.0)
    else:
        raise ValueError(kind)
    return l, g


def packed(df: DataFrame, feats: list[str]) -> DataFrame:
    """Labels and features of an Arrow batch as two binary values: a pass over stored
    rows then moves few values instead of converting every column again."""
    def run(it):
        for pdf in it:
            if not pdf.empty:
                yield pd.DataFrame({"y": [pdf["label"].to_numpy(np.int64).tobytes()],
                                    "x": [np.ascontiguousarray(pdf[feats].to_numpy(np.float64)).tobytes()]})
    return df.select("label", *feats).mapInPandas(run, "y binary, x binary")


def grad_pass(df: DataFrame, feats: list[str], K: int, W: np.ndarray, kind: str, cw: np.ndarray,
              phi=None, pairs: list[tuple[int, int]] | None = None):
    """Sum over rows (``packed``) of w_i * loss and its gradient for all tasks at once.

    Tasks are the K one-vs-rest problems, or -- with ``pairs`` -- one
    problem per class pair (a: +1, b: -1, other rows weight 0).  ``phi``
    maps features inside the task (random features / Nystroem)."""
    d = W.shape[1] - 1
    T = W.shape[0]

    def run(it):
        acc = np.zeros((T, d + 2))
        for x, y in ((x, y) for pdf in it for x, y in zip(pdf["x"], pdf["y"])):
            x, y = np.frombuffer(x).reshape(-1, len(feats)), np.frombuffer(y, np.int64)
            if phi is not None:
                x = phi(x)
            sw = cw[y]
            if pairs is None:
                Y = 2 * np.eye(K)[y] - 1                  # +-1 per class
            else:
                Y = np.stack([np.where(y == a, 1.0, np.where(y == b, -1.0, 0.0)) for a, b in pairs], axis=1)
            z = Y * (x @ W[:, :d].T + W[:, d])
            l, g = _dloss(kind, z)
            l = l * (Y != 0)
            gy = g * Y * sw[:, None]
            acc[:, :d] += gy.T @ x
            acc[:, d] += gy.sum(0)
            acc[:, d + 1] += (l * sw[:, None]).sum(0)
        c, j = np.nonzero(np.ones_like(acc, dtype=bool))
        yield pd.DataFrame({"c": c.astype("int32"), "j": j.astype("int32"), "v": acc[c, j]})

    red = (df.mapInPandas(run, OUT)
           .groupBy("c", "j").agg(F.sum("v").alias("v")).collect())
    acc = np.zeros((T, d + 2))
    for r in red:
        acc[r["c"], r["j"]] = r["v"]
    return acc[:, d + 1], acc[:, :d + 1]


def lbfgs(fg, x0: np.ndarray, max_iter: int = 100, m: int = 10, tol: float = 1e-6):
    """Minimise f with gradient g = fg(x) -> (f, g): two-loop L-BFGS, Armijo backtracking."""
    x = x0.copy()
    f, g = fg(x)
    S, Y = [], []
    for _ in range(max_iter):
        q = g.copy()
        al = []
        for s, y in reversed(list(zip(S, Y))):
            a = s.dot(q) / y.dot(s)
            al.append(a)
            q -= a * y
        if S:
            q *= S[-1].dot(Y[-1]) / Y[-1].dot(Y[-1])
        for (s, y), a in zip(zip(S, Y), reversed(al)):
            b = y.dot(q) / y.dot(s)
            q += s * (a - b)
        p = -q
        if p.dot(g) >= 0:
            p = -g
        t, f_new = 1.0, None
        for _ls in range(20):
            xn = x + t * p
            f_new, g_new = fg(xn)
            if f_new <= f + 1e-4 * t * g.dot(p):
                break
            t *= 0.5
        else:
            return x          # no step along p lowers the loss enough
        s, y = xn - x, g_new - g
        x, f_old, f, g = xn, f, f_new, g_new
        if y.dot(s) > 1e-12:
            S.append(s); Y.append(y)
            if len(S) > m:
                S.pop(0); Y.pop(0)
        if abs(f_old - f) <= tol * max(1.0, abs(f)) or np.linalg.norm(g) < tol:
            break
    return x


class SmoothOvR(Estimator):
    """Regularised one-vs-rest linear model with a smooth loss, L-BFGS.

    ``objective``: 'mean' -> (1/sum w) sum w_i L + alpha/2 ||W||^2 (SGD style);
    'sum' -> C sum w_i L + 1/2 ||W||^2 (liblinear style, bias penalised).
    """

    def __init__(self, loss: str, alpha: float = 1e-4, C: float = 1.0, objective: str = "mean", max_iter: int = 100,
                 phi_factory=None, ovo: bool = False, balanced_weights: bool = True, **extra):
        self.loss, self.alpha, self.C, self.objective, self.max_iter = loss, alpha, C, objective, max_iter
        self.phi_factory, self.ovo, self.bal = phi_factory, ovo, balanced_weights
        self.params = dict(loss=loss, alpha=alpha, C=C, class_weight="balanced" if balanced_weights else None,
                           max_iter=max_iter, multi_class="ovo" if ovo else "ovr", **extra)

    def fit(self, train, ctx: Ctx):
        K = ctx.k
        cnt = class_counts(train, K)
        cw = balanced(cnt) if self.bal else np.ones(K)
        df = packed(train, ctx.features).persist()
        wsum = float(np.sum(cw * cnt))
        phi = self.phi_factory(train, ctx) if self.phi_factory else None
        d = phi(np.zeros((1, len(ctx.features)))).shape[1] if phi is not None else len(ctx.features)
        pairs = [(a, b) for a in range(K) for b in range(a + 1, K)] if self.ovo else None
        T = len(pairs) if pairs else K

        def fg(v):
            W = v.reshape(T, d + 1)
            l, g = grad_pass(df, ctx.features, K, W, self.loss, cw, phi=phi, pairs=pairs)
            if self.objective == "mean":
                reg = W.copy(); reg[:, d] = 0
                return l.sum() / wsum + 0.5 * self.alpha * (reg ** 2).sum(), (g / wsum + self.alpha * reg).ravel()
            return self.C * l.sum() + 0.5 * (W ** 2).sum(), (self.C * g + W).ravel()
        v = lbfgs(fg, np.zeros(T * (d + 1)), self.max_iter)
        df.unpersist()
        W = v.reshape(T, d + 1)

        def score(x):
            z = phi(x) if phi is not None else x
            dec = z @ W[:, :d].T + W[:, d]
            if pairs is None:
                return dec
            votes = np.zeros((len(x), K))
            for t, (a, b) in enumerate(pairs):       # one-vs-one: each pair votes
                votes[:, a] += dec[:, t] > 0
                votes[:, b] += dec[:, t] <= 0
            return votes
        return _NP(ctx.features, score, f"{T * d} weights")


class BatchMistakeDriven(Estimator):
    """M07 perceptron / M08 passive-aggressive in full-batch form: each epoch
    adds the (weighted, averaged) correction of every mistaken or
    margin-violating row; stops when an epoch changes nothing."""

    def __init__(self, kind: str = "perceptron", C: float = 1.0, epochs: int = 20, eta: float = 1.0):
        self.kind, self.C, self.epochs, self.eta = kind, C, epochs, eta
        self.params = dict(kind=kind, C=C, max_iter=epochs, eta0=eta, class_weight="balanced")

    def fit(self, train, ctx: Ctx):
        K, d = ctx.k, len(ctx.features)
        cnt = class_counts(train, K)
        cw = balanced(cnt)
        df = packed(train, ctx.features).persist()
        W = np.zeros((K, d + 1))
        loss = "perceptron" if self.kind == "perceptron" else "hinge"
        n = float(np.sum(cw * cnt))
        for _ in range(self.epochs):
            l, g = grad_pass(df, ctx.features, K, W, loss, cw)
            if not np.any(g):
                break
            step = self.eta / n
            if self.kind == "passive_aggressive":
                # PA-I step: loss over squared gradient norm, capped by C
                gn = (g ** 2).sum(axis=1, keepdims=True) / n ** 2
                step = np.minimum(self.C, (l[:, None] / n) / np.maximum(gn, 1e-12)) / n
            W = W - step * g
        df.unpersist()
        return _NP(ctx.features, lambda x: x @ W[:, :d].T + W[:, d], f"{K * d} weights")
