"""Uniform classifier contract.

``Estimator.fit(train, ctx) -> Fitted``; ``Fitted.predict(df)`` returns
``df(row_id, label, ...)`` -> ``(row_id, y, p)``.  Models whose decision is a
closed-form function of a few fitted numbers predict with plain column
expressions (no UDF, no join); the fitted numbers are bounded by the model
size (K x d), never by the data.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classyard.functions.hashing import SEED


@dataclass
class Ctx:
    features: list[str]
    k: int
    seed: int = SEED


class Fitted:
    size: str = "n/a"
    params: dict = {}

    def scores(self) -> list[Column] | None:  # per-class score columns, if closed form
        return None

    def shuffled_scorer(self, sc) -> Callable | None:
        """What ``predict`` says of rows with one value replaced, as a function of finite (features (n, d),
        values (n, d * R), R) -> classes (n, d * R): column j * R + r has feature j replaced.  None: by ``predict`` only."""
        return None

    def predict(self, df: DataFrame) -> DataFrame:
        sc = self.scores()
        if sc is None:
            raise NotImplementedError
        return df.select("row_id", F.col("label").alias("y"), argmax(sc).alias("p"))


class Estimator:
    params: dict = {}

    def fit(self, train: DataFrame, ctx: Ctx) -> Fitted:
        raise NotImplementedError


def argmax(scores: list[Column]) -> Column:
    """Index of the largest score; ties go to the lowest index."""
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("ni")) for i, s in enumerate(scores)]))
    return (-best["ni"]).cast("int")


def argmin(scores: list[Column]) -> Column:
    """Index of the smallest score; ties go to the lowest index."""
    best = F.array_min(F.array(*[F.struct(s.alias("s"), F.lit(i).alias("i")) for i, s in enumerate(scores)]))
    return best["i"].cast("int")


def linear_scores(features: list[str], W, b=None) -> list[Column]:
    """Per-class affine scores b_c + sum_i W[c][i] * x_i as column expressions."""
    out = []
    for c, row in enumerate(W):
        terms = [F.col(f) * F.lit(float(w)) for f, w in zip(features, row) if w != 0.0]
        s = reduce(lambda a, t: a + t, terms) if terms else F.lit(0.0)
        if b is not None:
            s = s + F.lit(float(b[c]))
        out.append(s)
    return out


@dataclass
class ModelSpec:
    key: str
    name: str
    family: str
    description: str
    build: Callable[[], Estimator]
    subsample_cap: int | None = None
    hyperparams: dict = field(default_factory=dict)
