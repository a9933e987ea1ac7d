"""Distributed sufficient statistics for closed-form models.

``moments`` runs one pass: each task folds its Arrow batches into per-key sums
(sum w, sum w z, sum w z z^T, sum w y, sum w z y^T) with NumPy BLAS and sends one
packed vector per key (the symmetric matrix as its upper triangle).  Vectors are
added up by ``groupBy`` in two steps -- the square root of the number of tasks
first -- so the driver receives one vector of d^2/2 + d*T numbers per key, whatever
the row count.  ``phi`` optionally maps raw features to a derived space inside
the task (random features, hidden layers) without materialising it.
"""
from __future__ import annotations

from typing import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR = "key int, salt int, v binary"


def batch_columns(b: pa.RecordBatch, feats: list[str]) -> np.ndarray:
    return np.stack([b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in feats], axis=1).astype(np.float64)


def summed(df: DataFrame, fold: Callable[[Iterable], dict]) -> dict[int, np.ndarray]:
    """key -> sum over tasks of the vectors that ``fold`` (batches -> {key:
    vector}) returns for each task."""
    def task(batches):
        from pyspark import TaskContext
        salt = TaskContext.get().partitionId()
        for key, v in fold(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([salt], pa.int32()), pa.array([v.tobytes()], pa.binary())],
                                             ["key", "salt", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for x in table.sort_by("salt")["v"]:
            total = total + np.frombuffer(x.as_buffer())
        return pa.table({"key": table["key"][:1], "salt": table["salt"][:1], "v": pa.array([total.tobytes()], pa.binary())})
    parts = df.mapInArrow(task, VECTOR)
    groups = max(1, int(df.rdd.getNumPartitions() ** 0.5))
    if groups > 4:
        parts = parts.withColumn("salt", F.pmod("salt", F.lit(groups)).cast("int")).groupBy("key", "salt").applyInArrow(add, VECTOR)
    return {r["key"]: np.frombuffer(bytes(r["v"])) for r in parts.groupBy("key").applyInArrow(add, VECTOR).collect()}


def moments(df: DataFrame, feats: list[str], k: int, targets: str | None = None,
            by_class: bool = False, class_weights: np.ndarray | None = None,
            phi: Callable[[np.ndarray], np.ndarray] | None = None) -> dict:
    """Per-key moments.  ``targets``: None, 'onehot' or 'pm1' (+1/-1 per class)."""
    cw = None if class_weights is None else np.asarray(class_weights, float)

    def fold(batches):
        acc: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = batch_columns(b, feats)
            z = phi(x) if phi is not None else x
            y = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            w = cw[y] if cw is not None else np.ones(len(y))
            for key in np.unique(y) if by_class else [0]:
                m = y == key if by_class else slice(None)
                zz, ww = z[m], w[m]
                zw = zz * ww[:, None]
                new = [np.array([ww.sum()]), zw.sum(0), zw.T @ zz]
                if targets:
                    t = np.eye(k)[y[m]] if targets == "onehot" else 2 * np.eye(k)[y[m]] - 1
                    new += [(t * ww[:, None]).sum(0), zw.T @ t]
                old = acc.get(int(key))
                acc[int(key)] = new if old is None else [p + q for p, q in zip(old, new)]
        upper = lambda a: a[np.triu_indices(len(a))]
        # the first number is the dimension times the number of tasks, the second that number
        return {key: np.concatenate([[len(a[1]), 1.0], a[0], a[1], upper(a[2]), *[p.ravel() for p in a[3:]]]) for key, a in acc.items()}
    out: dict = {}
    for key, v in summed(df.select("label", *feats), fold).items():
        d = round(v[0] / v[1])
        cut = np.cumsum([2, 1, d, d * (d + 1) // 2] + ([k] if targets else []))
        p = np.split(v, cut)[1:]
        szz = np.zeros((d, d))
        szz[np.triu_indices(d)] = p[2]
        out[key] = {"sw": p[0][None, :], "sz": p[1][None, :], "szz": szz + np.triu(szz, 1).T}
        if targets:
            out[key] |= {"sy": p[3][None, :], "szy": p[4].reshape(d, k)}
    return out


def class_counts(df: DataFrame, k: int) -> np.ndarray:
    n = np.zeros(k)
    for r in df.groupBy("label").count().collect():
        n[r["label"]] = r["count"]
    return n


def balanced(n: np.ndarray) -> np.ndarray:
    """F13 weights n / (K * n_c) (classes absent from train get 0)."""
    k = int((n > 0).sum())
    return np.where(n > 0, n.sum() / (k * np.maximum(n, 1)), 0.0)


def numpy_scorer(df: DataFrame, feats: list[str], score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(row_id, y, p) with p = argmax of ``score(X)`` computed per Arrow batch."""
    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            s = score(pdf[feats].to_numpy(np.float64))
            yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy(np.int64),
                                "y": pdf["label"].to_numpy(np.int32),
                                "p": np.argmax(s, axis=1).astype(np.int32)})
    return df.select("row_id", "label", *feats).mapInPandas(run, "row_id long, y int, p int")
