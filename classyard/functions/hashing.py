"""Deterministic, partition-independent randomness.

All sampling in the engine is a pure function of (seed, row_id, ...), so a
retried task or a different partitioning produces identical rows.  The
``md5(concat(seed,'|',id))`` digest is computable by any SQL engine, which is
what lets the DuckDB oracle reproduce splits and samples exactly.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["hash_key", "hash_uniform", "hash_bucket", "hash_poisson", "hash_id", "SEED"]

SEED = 42


def _parts(parts) -> list[Column]:
    out = []
    for p in parts:
        if isinstance(p, Column):
            out.append(p.cast("string"))
        elif isinstance(p, str) and not p.startswith("'"):
            out.append(F.col(p).cast("string"))
        else:
            out.append(F.lit(str(p).strip("'")))
    return out


def hash_key(seed, *parts) -> Column:
    """md5 hex digest of 'seed|part1|part2...' (ordering key shared with SQL)."""
    cols = [F.lit(str(seed))]
    for p in _parts(parts):
        cols += [F.lit("|"), p]
    return F.md5(F.concat(*cols))


def hash_bucket(key: Column, hex_digits: int = 4) -> Column:
    """Leading hex digits of an md5 key as an int bucket (order-preserving)."""
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("int")


def hash_uniform(key: Column) -> Column:
    """Uniform [0,1) from the first 13 hex digits (52 bits) of an md5 key."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(1 << 52)


def hash_poisson(u: Column, lam: float = 1.0, kmax: int = 12) -> Column:
    """Poisson(lam) draw by inverse CDF of a uniform column (bootstrap weight)."""
    cdf, p, acc = [], math.exp(-lam), 0.0
    for k in range(kmax + 1):
        acc += p
        cdf.append(acc)
        p *= lam / (k + 1)
    expr = F.lit(kmax)
    for k in reversed(range(kmax)):
        expr = F.when(u < F.lit(cdf[k]), F.lit(k)).otherwise(expr)
    return expr.cast("int")


def hash_id(*cols: str) -> Column:
    """Stable 60-bit row id from a composite key (md5 of 'c1|c2|...'), for
    tables without a single-column key."""
    s = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")
