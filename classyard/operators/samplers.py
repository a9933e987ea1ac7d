"""Class-balanced and bootstrap samplers P1-P4 as first-class operators.

Every draw is a pure function of (seed, replicate, row_id): retried tasks
and any partitioning give identical samples.  Replicates are a key column,
so R samples are one job, not R jobs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classyard.functions.hashing import SEED, hash_key, hash_poisson, hash_uniform
from classyard.operators.ranking import rank_cut


def _replicated(df: DataFrame, n_rep: int) -> DataFrame:
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))))


def bootstrap_uniform(seed: int, replicate, row_id) -> Column:
    """The draw of P1 for a row and a replicate; ``hash_poisson`` of it is the multiplicity."""
    return hash_uniform(hash_key(seed, "'boot'", replicate, row_id))


def bootstrap(df: DataFrame, n_rep: int, seed: int = SEED) -> DataFrame:
    """N draws with replacement per replicate ~ Poisson(1) multiplicity per row
    (column ``w``); rows drawn zero times are dropped."""
    r = _replicated(df, n_rep)
    r = r.withColumn("w", bootstrap_uniform(seed, "replicate", "row_id"))     # hashed once, in its own projection
    return r.withColumn("w", hash_poisson(F.col("w"), 1.0)).where(F.col("w") > 0)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))


def undersample(df: DataFrame, n_rep: int = 1, seed: int = SEED, label: str = "label") -> DataFrame:
    """Per replicate, every class cut to the minority count, without
    replacement, in md5(seed|replicate|row_id) order (exact; never ranks a
    whole class in one task)."""
    cnt = class_counts(df, label)
    m = cnt.agg(F.min("n_c").alias("m")).first()["m"]
    r = _replicated(df, n_rep).withColumn("__key", hash_key(seed, "replicate", "row_id"))
    quotas = (cnt.select(label).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))))
              .withColumn("quota", F.lit(m).cast("long")))
    return (rank_cut(r, ["replicate", label], "__key", "row_id", quotas, out="__keep")
            .where("__keep").drop("__key", "__keep"))


def balanced_bootstrap(df: DataFrame, n_rep: int, seed: int = SEED, label: str = "label") -> DataFrame:
    """Per replicate each class resampled with replacement to the minority
    count -- Poisson(n_min / n_c) multiplicities (expected size n_min per class)."""
    cnt = class_counts(df, label)
    m = cnt.agg(F.min("n_c").alias("m")).first()["m"]
    lam = cnt.select(label, (F.lit(float(m)) / F.col("n_c")).alias("lam"))
    r = _replicated(df, n_rep).join(F.broadcast(lam), label)          # K rows
    u = hash_uniform(hash_key(seed, "'bal'", "replicate", "row_id"))
    # inverse CDF of Poisson(lam) with lam <= 1, to where it is 1 in doubles (as P1)
    p = c = F.exp(-F.col("lam"))
    w = F.when(u < c, 0)
    for j in range(1, 18):
        p = p * F.col("lam") / j
        c = c + p
        w = w.when(u < c, j)
    w = w.otherwise(18)
    return r.withColumn("w", w).where(F.col("w") > 0).drop("lam")


def one_side_sample(df: DataFrame, grad_col: str, top: float = 0.2, other: float = 0.1,
                    seed: int = SEED, round_id: int = 0) -> DataFrame:
    """Keep the rows with the largest |gradient| (top share), sample
    ``other`` of the rest and up-weight them by (1 - top) / other."""
    q = df.select(F.abs(F.col(grad_col)).alias("a")).approxQuantile("a", [1 - top], 1e-3)[0]
    u = hash_uniform(hash_key(seed, "'goss'", F.lit(round_id), "row_id"))
    big = F.abs(F.col(grad_col)) >= F.lit(q)
    keep = big | (u < F.lit(other / (1 - top)))
    return df.where(keep).withColumn("w", F.when(big, 1.0).otherwise((1 - top) / other))
