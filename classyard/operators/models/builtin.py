"""Spark ML built-in estimators behind the uniform contract.

M01 logreg, M02 logreg_elasticnet, M04 sgd_log, M05 sgd_hinge (one-vs-rest),
and SAMME over weighted stumps, which M48 draws its samples for.  Class
balancing (F13) becomes ``weightCol``.

Regularisation: the reference's objective is C * sum_i w_i loss_i + ||W||^2/2,
Spark's is (1/sum w) * sum_i w_i loss_i + regParam * penalty, so
regParam = 1 / (C * sum w).  With balanced weights sum w = n_train.
"""
from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from classyard.operators.models.base import Ctx, Estimator, Fitted
from classyard.operators.prep import balanced_weights


def _assemble(df, feats):
    return VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="error").transform(df)


class _SparkFitted(Fitted):
    def __init__(self, model, feats, size="n/a"):
        self.model, self.feats, self.size = model, feats, size

    def predict(self, df):
        out = self.model.transform(_assemble(df.select("row_id", "label", *self.feats), self.feats))
        return out.select("row_id", F.col("label").alias("y"), F.col("prediction").cast("int").alias("p"))

    def proba(self, df):
        """(row_id, y, prob array<double>) from the model's probability vector."""
        from pyspark.ml.functions import vector_to_array
        out = self.model.transform(_assemble(df.select("row_id", "label", *self.feats), self.feats))
        return out.select("row_id", F.col("label").alias("y"), vector_to_array("probability").alias("prob"))


class SparkML(Estimator):
    def __init__(self, make, balanced: bool = True, reg_from_c: float | None = None, size_fn=None, **params):
        self.make, self.balanced, self.reg_from_c, self.size_fn = make, balanced, reg_from_c, size_fn
        self.params = dict(params, class_weight="balanced" if balanced else None)

    def fit(self, train, ctx: Ctx):
        df = train.select("row_id", "label", *ctx.features)
        if self.balanced:
            df = balanced_weights(df)
        n = df.count()
        est = self.make(n)
        if self.balanced and hasattr(est, "setWeightCol"):
            est = est.setWeightCol("weight")
        model = est.fit(_assemble(df, ctx.features))
        size = self.size_fn(model) if self.size_fn else "n/a"
        return _SparkFitted(model, ctx.features, size)


def _coef_size(m):
    try:
        return f"{m.coefficientMatrix.numRows * m.coefficientMatrix.numCols} weights"
    except Exception:
        return "n/a"


def logreg(C: float = 1.0, l1_ratio: float = 0.0, max_iter: int = 1000):
    return SparkML(lambda n: LogisticRegression(family="multinomial", regParam=1.0 / (C * n),
                                                elasticNetParam=l1_ratio, standardization=False,
                                                maxIter=max_iter, labelCol="label"),
                   size_fn=_coef_size, C=C, l1_ratio=l1_ratio, max_iter=max_iter)


def sgd_log(alpha: float = 1e-4):
    """One-vs-rest log loss with L2 alpha: the optimum the SGD run approaches."""
    return SparkML(lambda n: OneVsRest(classifier=LogisticRegression(regParam=alpha, standardization=False,
                                                                     maxIter=100, weightCol="weight"),
                                       labelCol="label", weightCol="weight", parallelism=8), alpha=alpha, loss="log_loss")


def sgd_hinge(alpha: float = 1e-4):
    return SparkML(lambda n: OneVsRest(classifier=LinearSVC(regParam=alpha, standardization=False, maxIter=100,
                                                            weightCol="weight"),
                                       labelCol="label", weightCol="weight", parallelism=8), alpha=alpha, loss="hinge")


class AdaBoostSAMME(Estimator):
    """Multiclass SAMME over depth-1 weighted trees.

    Each round is one weighted stump fit plus one projection that updates the
    row weights; the weights live in a column, and lineage is cut by a
    checkpoint every ``ckpt_every`` rounds.
    """

    def __init__(self, n_rounds: int = 200, lr: float = 1.0, ckpt_every: int = 10):
        self.n_rounds, self.lr, self.ckpt_every = n_rounds, lr, ckpt_every
        self.params = {"n_estimators": n_rounds, "learning_rate": lr, "algorithm": "SAMME"}

    def fit(self, train, ctx: Ctx):
        K = ctx.k
        df = _assemble(train.select("row_id", "label", *ctx.features), ctx.features)
        n = df.count()
        df = df.withColumn("w", F.lit(1.0 / n)).checkpoint(eager=True)
        stumps = []
        for r in range(self.n_rounds):
            fit_df = df
            if getattr(self, "resample", False):     # RUSBoost: fresh class-balanced under-sample per round
                from classyard.operators.samplers import undersample
                fit_df = undersample(df, 1, ctx.seed + r).drop("replicate")
            m = DecisionTreeClassifier(maxDepth=1, maxBins=255, labelCol="label", weightCol="w", seed=42).fit(fit_df)
            pr = m.transform(df).withColumn("miss", (F.col("prediction").cast("int") != F.col("label")).cast("double"))
            agg = pr.agg(F.sum(F.col("w") * F.col("miss")).alias("e"), F.sum("w").alias("s")).first()
            err = (agg["e"] or 0.0) / (agg["s"] or 1.0)
            if err >= 1.0 - 1.0 / K:          # no better than chance: stop
                break
            alpha = self.lr * (math.log((1 - err) / max(err, 1e-300)) + math.log(K - 1))
            stumps.append((m, alpha))
            if err <= 0:
                break
            # rescaled to sum 1, so that weights stay finite over any number of rounds
            total = agg["s"] + (math.exp(alpha) - 1) * agg["e"]
            new = pr.select("row_id", "label", "features",
                            (F.col("w") * F.exp(F.lit(alpha) * F.col("miss")) / F.lit(total)).alias("w"))
            new = new.checkpoint(eager=True) if (r + 1) % self.ckpt_every == 0 else new.persist()
            new.count()
            df.unpersist()
            df = new
        df.unpersist()
        feats = ctx.features

        class _F(Fitted):
            size = f"{len(stumps)} base estimators"

            def predict(self, d):
                x = _assemble(d.select("row_id", "label", *feats), feats)
                votes = [F.lit(0.0)] * K
                for i, (m, a) in enumerate(stumps):
                    x = m.setPredictionCol(f"p{i}").setRawPredictionCol(f"r{i}").setProbabilityCol(f"q{i}").transform(x)
                    votes = [v + F.when(F.col(f"p{i}").cast("int") == c, F.lit(a)).otherwise(0.0) for c, v in enumerate(votes)]
                from classyard.operators.models.base import argmax
                return x.select("row_id", F.col("label").alias("y"), argmax(votes).alias("p"))
        return _F()
