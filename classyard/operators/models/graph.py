"""M39 label_spreading on a sparse kNN graph (O(n k), not O(n^2)).

Edges come from the exact kNN join of the train set with itself (k=7, self
included, as a connectivity graph); S = D^-1/2 A D^-1/2 with in-degree D and
a zero diagonal.  An iteration is F <- alpha S F + (1 - alpha) Y.  A row's distribution is
one row of K numbers; edges are stored dealt by their source, labels and distributions
by their row, in the same number of parts, so an iteration moves nothing but one row of K
numbers per edge.  Lineage is cut with a checkpoint every few iterations, where convergence is
also tested: that job has the two last steps, and nothing is computed again.  Test rows
sum the distributions of their 7 nearest train rows.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from classyard.operators.models import knn
from classyard.operators.models.base import Ctx, Estimator, Fitted

PART_ROWS = 50_000       # rows of one part of the distributions


class LabelSpreading(Estimator):
    def __init__(self, k: int = 7, alpha: float = 0.2, max_iter: int = 30, tol: float = 1e-3, ckpt_every: int = 5):
        self.k, self.alpha, self.max_iter, self.tol, self.ckpt_every = k, alpha, max_iter, tol, ckpt_every
        self.params = {"kernel": "knn", "n_neighbors": k, "alpha": alpha, "max_iter": max_iter, "tol": tol}

    def fit(self, train, ctx: Ctx):
        k, a, K, feats = self.k, self.alpha, ctx.k, ctx.features
        tr = train.select("row_id", "label", *feats).persist()
        n = tr.count()
        nb = knn.neighbours(tr, tr, feats, k, n_train=n, n_test=n)
        # self edges count neither as edges nor in the degrees
        # stored: the search's second round would run once for each of its three readers
        A = nb.select(F.col("row_id").alias("i"), F.col("nb_row").alias("j")).where("i <> j").checkpoint(eager=True)
        deg = A.groupBy("j").agg(F.count(F.lit(1)).alias("dj"))
        degi = deg.select(F.col("j").alias("i"), F.col("dj").alias("di"))
        parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))
        # a row that is nobody's neighbour has degree 1
        S = (A.join(deg.hint("merge"), "j").join(degi.hint("merge"), "i", "left")
             .select("i", "j", (1.0 / F.sqrt(F.coalesce("di", F.lit(1)) * F.col("dj"))).alias("s"))
             .repartition(parts, "j").checkpoint(eager=True))
        ys, vs, ps, olds = ([f"{x}{c}" for c in range(K)] for x in ("y", "v", "p", "old"))
        Y = (tr.select(F.col("row_id").alias("i"), *[(F.col("label") == c).cast("double").alias(y) for c, y in enumerate(ys)])
             .repartition(parts, "i").checkpoint(eager=True))
        tr.unpersist()

        def spread(now):
            """(i, p0, p1 ...): S F of the rows with edges."""
            at = now.select(F.col("i").alias("j"), *vs)
            sent = S.join(at.hint("merge"), "j").select("i", *[(F.col("s") * F.col(v)).alias(v) for v in vs])
            return sent.repartition(parts, "i").groupBy("i").agg(*[F.sum(v).alias(p) for v, p in zip(vs, ps)])

        def step(p, y):
            return a * F.coalesce(p, F.lit(0.0)) + (1 - a) * F.col(y)
        before, now = None, Y.select("i", *[F.col(y).alias(v) for y, v in zip(ys, vs)])
        for it in range(self.max_iter):
            prop = spread(now)
            new = Y.join(prop.hint("merge"), "i", "left")
            if (it + 1) % self.ckpt_every == 0 or it + 1 == self.max_iter:
                # the step before, of the same rows
                if before is not None:
                    was = before.select(F.col("i").alias("at"), *[F.col(p).alias(o) for p, o in zip(ps, olds)])
                    new = new.join(was.hint("merge"), F.col("i") == F.col("at"), "left")
                    change = [F.abs(step(F.col(p), y) - step(F.col(o), y)) for p, o, y in zip(ps, olds, ys)]
                else:
                    change = [F.abs(step(F.col(p), y) - F.col(y)) for p, y in zip(ps, ys)]
                new = new.select("i", *[step(F.col(p), y).alias(v) for p, y, v in zip(ps, ys, vs)],
                                 reduce(lambda x, z: x + z, change).alias("change")).checkpoint(eager=True)
                delta = new.agg(F.sum("change")).first()[0]
                now, before = new.drop("change"), None
                if delta is not None and delta < self.tol:
                    break
            else:
                now, before = new.select("i", *[step(F.col(p), y).alias(v) for p, y, v in zip(ps, ys, vs)]), prop
        dist = now

        class _F(Fitted):
            size = "n/a"

            def predict(self, df):
                nbt = knn.neighbours(train.select("row_id", "label", *feats), df, feats, k)
                sc = (nbt.select("row_id", "y", F.col("nb_row").alias("i")).join(dist.hint("merge"), "i")
                      .groupBy("row_id", "y").agg(*[F.sum(v).alias(v) for v in vs]))
                best = F.array_max(F.array(*[F.struct(F.col(v).alias("score"), F.lit(-c).alias("less")) for c, v in enumerate(vs)]))
                w = Window.partitionBy("row_id").orderBy(F.col("best.score").desc(), F.col("best.less").desc())
                return (sc.select("row_id", "y", best.alias("best")).withColumn("r", F.row_number().over(w)).where("r = 1")
                        .select("row_id", "y", (-F.col("best.less")).cast("int").alias("p")))
        return _F()
