"""Kernel models, re-aimed to scale: M30 svc_linear, M31 svc_rbf,
M32 svc_poly, M34 nystroem_sgd, M40 gaussian_process.

Exact dual kernel solvers are O(n^2)-O(n^3) on one machine; here the kernel
is approximated by an explicit feature map -- Nystroem on 200 landmarks
(a hashed, fixed-seed sample; only 200 x d numbers reach the driver) or
random Fourier features -- and a linear model is trained on the mapped
features with distributed gradients.  The map is applied inside each task.
"""
from __future__ import annotations

import numpy as np

from classyard.operators.models.linear_iter import SmoothOvR
from classyard.operators.prep import cap_rows


def _kernel(kind: str, gamma: float, degree: int = 3, coef0: float = 0.0):
    if kind == "rbf":
        def k(a, b):
            d2 = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * a @ b.T
            return np.exp(-gamma * np.maximum(d2, 0))
    elif kind == "poly":
        def k(a, b):
            return (gamma * a @ b.T + coef0) ** degree
    else:
        raise ValueError(kind)
    return k


def nystroem(kind: str = "rbf", n_components: int = 200, gamma: float | str | None = None, degree: int = 3,
             coef0: float = 0.0):
    """Factory: fit landmarks on train rows, return x -> k(x, L) K_LL^{-1/2}."""
    def factory(train, ctx):
        feats = ctx.features
        land = np.array(cap_rows(train.select("row_id", *feats), n_components, ctx.seed)
                        .orderBy("row_id").select(*feats).collect(), dtype=float)
        d = len(feats)
        if gamma == "scale":
            var = train.selectExpr(*[f"var_pop({f}) AS {f}" for f in feats]).first()
            g = 1.0 / (d * max(1e-12, float(np.mean([var[f] or 0.0 for f in feats]))))
        else:
            g = gamma if gamma is not None else 1.0 / d
        k = _kernel(kind, g, degree, coef0)
        s, U = np.linalg.eigh(k(land, land))
        s = np.maximum(s, 1e-12)
        norm = (U / np.sqrt(s)) @ U.T
        return lambda x: k(x, land) @ norm.T
    return factory


def fourier(n_components: int = 200, gamma: float = 0.5):
    def factory(train, ctx):
        rng = np.random.RandomState(ctx.seed)
        W = np.sqrt(2 * gamma) * rng.normal(size=(len(ctx.features), n_components))
        b = rng.uniform(0, 2 * np.pi, size=n_components)
        return lambda x: np.sqrt(2.0 / n_components) * np.cos(x @ W + b)
    return factory


def svc(kind: str):
    """One-vs-one squared-hinge SVM (C=1, balanced) on the kernel's feature map."""
    phi = None if kind == "linear" else nystroem(kind, 200, "scale", degree=3, coef0=0.0)
    return SmoothOvR("squared_hinge", C=1.0, objective="sum", max_iter=100, phi_factory=phi, ovo=True,
                     kernel=kind, approximation="nystroem-200" if phi else "primal")


def nystroem_sgd():
    return SmoothOvR("log", alpha=1e-4, objective="mean", max_iter=100, phi_factory=nystroem("rbf", 200, None),
                     n_components=200)


def gaussian_process():
    """RBF(length 1) GP classifier, one-vs-rest: MAP of a logistic GP in a
    200-dim random-feature space (the Gaussian prior is the L2 term)."""
    return SmoothOvR("log", C=1.0, objective="sum", max_iter=100, phi_factory=fourier(200, 0.5),
                     balanced_weights=False, kernel="rbf(1.0)", approximation="random-fourier-200")
