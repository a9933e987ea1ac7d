"""M44 som_classifier: batch self-organising map + unit labelling.

Training is the batch SOM: per epoch every task assigns its rows to the
best-matching unit of the codebook (NumPy) and sends one array of per-unit
sums; they are added up (units x d numbers) and the driver applies the
Gaussian grid neighbourhood.  Unit labels are a ``groupBy(unit, label)``
count with majority per unit (ties -> lowest label); unseen units fall back
to the global majority class.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from classyard.operators.models.base import Ctx, Estimator, Fitted
from classyard.operators.models.moments import batch_columns, summed
from classyard.operators.prep import cap_rows


def _bmu(x: np.ndarray, cb: np.ndarray) -> np.ndarray:
    d2 = (x ** 2).sum(1)[:, None] + (cb ** 2).sum(1)[None, :] - 2 * x @ cb.T
    return np.argmin(d2, axis=1)


class SOMClassifier(Estimator):
    def __init__(self, grid: int = 12, sigma: float = 1.5, epochs: int = 10):
        self.grid, self.sigma, self.epochs = grid, sigma, epochs
        self.params = {"grid_size": grid, "sigma": sigma, "epochs": epochs, "training": "batch"}

    def fit(self, train, ctx: Ctx):
        g, feats, K = self.grid, ctx.features, ctx.k
        units = g * g
        cb = np.array(cap_rows(train.select("row_id", *feats), units, ctx.seed).orderBy("row_id")
                      .select(*feats).collect(), dtype=float)
        if len(cb) < units:
            cb = np.resize(cb, (units, len(feats)))
        pos = np.array([(i // g, i % g) for i in range(units)], dtype=float)
        grid_d2 = ((pos[:, None, :] - pos[None, :, :]) ** 2).sum(-1)
        tr = train.select("label", *feats).persist()
        for ep in range(self.epochs):
            sig = max(0.5, self.sigma * (1 - ep / max(1, self.epochs)))
            cur = cb

            def fold(batches, cur=cur):
                v = np.zeros((units, len(feats) + 1))
                for b in batches:
                    if b.num_rows:
                        x = batch_columns(b, feats)
                        u = _bmu(x, cur)
                        v += np.stack([np.bincount(u, minlength=units), *[np.bincount(u, x[:, j], units) for j in range(len(feats))]], axis=1)
                return {0: v.ravel()}
            v = summed(tr, fold)[0].reshape(units, -1)
            C, S = v[:, 0], v[:, 1:]
            H = np.exp(-grid_d2 / (2 * sig ** 2))
            num, den = H @ S, H @ C
            cb = np.where(den[:, None] > 0, num / np.maximum(den, 1e-12)[:, None], cb)
        final = cb

        def bmus(df, final=final):
            def run(it):
                for pdf in it:
                    if pdf.empty:
                        continue
                    yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy(np.int64), "label": pdf["label"].to_numpy(np.int32),
                                        "unit": _bmu(pdf[feats].to_numpy(np.float64), final).astype("int32")})
            return df.select("row_id", "label", *feats).mapInPandas(run, "row_id long, label int, unit int")
        cnt = bmus(train).groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("unit").orderBy(F.col("n").desc(), F.col("label"))
        unit_label = {r["unit"]: r["label"] for r in cnt.withColumn("r", F.row_number().over(w)).where("r = 1").collect()}
        maj = train.groupBy("label").count().orderBy(F.col("count").desc(), F.col("label")).first()["label"]
        tr.unpersist()
        lut = F.create_map(*[x for kv in unit_label.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]) if unit_label else None

        class _F(Fitted):
            size = f"{g}x{g} map units"

            def predict(self, df):
                b = bmus(df)
                p = F.coalesce(lut[F.col("unit")], F.lit(maj)) if lut is not None else F.lit(maj)
                return b.select("row_id", F.col("label").alias("y"), p.cast("int").alias("p"))
        return _F()
