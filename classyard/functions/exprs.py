"""Scalar column expressions (all JVM-side, codegen-friendly).

Every helper returns a ``Column``; none of them is a Python UDF.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "hex_or_number_to_long", "equals_indicator", "hex_payload_bytes",
    "char_share", "LETTERS", "letter_share_columns", "safe_div",
]

# The alphabet of the letter-share features (26 ASCII letters,
# then the accented letters present in the four document languages).
LETTERS = list("abcdefghijklmnopqrstuvwxyz") + ["é", "ó", "è", "ñ", "ç", "ü", "ê", "ä", "ö", "í", "ß"]


def hex_or_number_to_long(c: str | Column) -> Column:
    """'0x..' parsed base 16, anything else truncated toward zero, junk -> 0.

    ``conv`` stops at the first bad digit, so the digits are tested before;
    ``try_*`` keeps ANSI mode from raising on unparsable input.
    """
    s = F.col(c) if isinstance(c, str) else c
    s = s.cast("string")
    parsed = F.when(
        s.startswith("0x"), F.when(s.rlike("^0x[0-9a-fA-F]+$"), F.conv(F.substring(s, 3, 1 << 20), 16, 10).try_cast("bigint"))
    ).otherwise(s.try_cast("double").try_cast("bigint"))
    return F.coalesce(parsed, F.lit(0).cast("bigint"))


def equals_indicator(c: str | Column, value: str) -> Column:
    """(c == value) as 0/1 with null -> 0."""
    s = F.col(c) if isinstance(c, str) else c
    return F.coalesce((s == F.lit(value)).cast("int"), F.lit(0))


def hex_payload_bytes(c: str | Column) -> Column:
    """byte length of a hex payload; null, '0' and 'nan' count as empty."""
    s = F.col(c) if isinstance(c, str) else c
    s = s.cast("string")
    return (
        F.when(s.isNull() | s.isin("0", "nan"), F.lit(0))
        .otherwise(F.floor(F.length(s) / 2))
        .cast("long")
    )


def safe_div(num: Column, den: Column) -> Column:
    """num / den, 0 when den == 0 (the zero-division convention of the metrics)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def char_share(text: Column, ch: str) -> Column:
    """Share of characters of ``text`` equal to ``ch`` (0 for empty text)."""
    n = F.length(text)
    hits = n - F.length(F.replace(text, F.lit(ch), F.lit("")))
    return F.when(n == 0, F.lit(0.0)).otherwise(hits / n)


def _letter_shares_udf():
    L = len(LETTERS)
    codes = np.array([ord(c) for c in LETTERS], dtype=np.int64)
    cache = {}

    def lut():
        if "lut" not in cache:   # code point -> letter index, L for others (built once per Python worker)
            t = np.full(0x110000, L, dtype=np.uint8)
            t[codes] = np.arange(L, dtype=np.uint8)
            cache["lut"] = t
        return cache["lut"]

    def chunk_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        low = [t.lower() for t in texts]
        lens = np.fromiter((len(t) for t in low), dtype=np.int64, count=len(low))
        idx = lut()[np.frombuffer("".join(low).encode("utf-32-le"), dtype=np.uint32)]
        cnt, at = np.empty((len(low), L)), 0
        for d, n in enumerate(lens.tolist()):
            cnt[d] = np.bincount(idx[at:at + n], minlength=L + 1)[:L]
            at += n
        return cnt, lens

    @F.pandas_udf("array<double>")
    def letter_shares(texts: pd.Series) -> pd.Series:
        # vectorised per chunk of ~0.5M characters: one encode, one gather, one bincount a text
        out = [None] * len(texts)
        vals = texts.tolist()
        i = 0
        while i < len(vals):
            j, size = i, 0
            while j < len(vals) and (j == i or size < 500_000):
                size += len(vals[j]) if vals[j] is not None else 0
                j += 1
            part = [v if v is not None else "" for v in vals[i:j]]
            cnt, lens = chunk_counts(part)
            share = np.divide(cnt, lens[:, None], out=np.zeros_like(cnt), where=lens[:, None] > 0)
            for k in range(j - i):
                out[i + k] = None if vals[i + k] is None else share[k]
            i = j
        return pd.Series(out)

    return letter_shares


_LS = None


def letter_share_columns(text_col: str = "text", prefix: str = "f") -> list[Column]:
    """One share column per letter of ``LETTERS`` over ``lower(text)``.

    Equivalent to ``char_share(lower(text), ch)`` for every letter, but counts
    all letters in one Arrow-batched pass: the JVM ``replace`` formulation
    rescans each text once per letter and measured ~200x slower.
    """
    global _LS
    if _LS is None:
        _LS = _letter_shares_udf()
    arr = _LS(F.col(text_col))
    return [arr[i].alias(f"{prefix}_{i:02d}") for i in range(len(LETTERS))]
