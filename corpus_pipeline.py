"""The corpus pipeline: five stages over ``documents``.

Each stage gets the rows that its predecessor kept and writes Parquet that the
next one reads; all but the last return the columns of ``documents``.
Nulls, empty or very long texts, ties, repeated rows, empty tables and further
columns are handled as the docstrings of the operators say.
"""
from __future__ import annotations

import public_tokenizers

from classyard.llm import fuse_dedup, mix_flow, pack_bfd, prob_minhash
from classyard.llm import toxicity as ordinal
from classyard.llm.common import read, stored


def toxicity(spark, docs, sf_dir):
    """Documents that the ordinal regression rejects go (operator 9)."""
    return ordinal.cleaned(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark, docs, sf_dir):
    """One row of each group of equal texts stays (operator 3)."""
    return fuse_dedup.deduplicated(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near duplicates stays (operator 5)."""
    return prob_minhash.deduplicated(docs)


def mixing(spark, docs, sf_dir):
    """Each document as often as the mix takes it (operator 4)."""
    return mix_flow.mixed(docs)


def packing(spark, docs, sf_dir):
    """Pieces of the documents, placed in sequences of 1024 ids (operator 6)."""
    return pack_bfd.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mixing", mixing), ("packing", packing)]

#: No stage but exact dedup can be expressed in SQL (models, tokenizers, minhash).
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
