import hashlib
import re
from collections import defaultdict

import numpy as np

from classyard.llm import fuse_dedup as D

from .util import DOC_SCHEMA, edge_docs, empty_docs


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 100, 1024, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        f = D.FuseFilter.build(keys)
        assert f.contains(keys).all()
        other = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
        assert f.contains(other).mean() < 0.012
        if n >= 1024:
            assert len(f.table) < 1.6 * n + 200


def brute(rows):
    groups = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d, k))
    out = []
    for text, g in groups.items():
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, keep[2], len(g), sha) for _, _, d, _ in g]
    return sorted(out, key=str), len(groups)


def test_against_brute_force(spark):
    df = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = D.dedup_digests(df).collect()
    want, n = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == n
    assert D.dedup_digests(empty_docs(spark)).count() == 0


def test_batches_and_tables_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = set()
    for batches in (1, 2, 5):
        rows = D._rows(docs.select("doc_id", "text"), batches)
        got = D.classes(rows, batches).select("doc_id", "keep_id", "group_size").collect()
        seen.add(tuple(sorted(map(tuple, got))))
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(seen) == 1 and sorted(seen.pop()) == sorted(w[:3] for w in want)


def test_equal_digests_of_unequal_texts_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 0, b"d", 3, ("a b",)), (2, 1, b"d", 1, ("c",)), (3, 2, b"d", 2, ("ab",)), (4, 3, b"d", 2, (" c",))],
                                 "doc_id long, row long, digest binary, n_cp long, doc struct<text string>")
    groups = spark.createDataFrame([(b"d", 0)], "digest binary, keep_row long")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in D._checked(rows, groups).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (4, 2), 4: (4, 2)}


def test_kept_rows_have_all_columns(spark):
    df = edge_docs(spark)
    out = D.deduplicated(df)
    assert out.columns == df.columns and out.schema == df.schema
    assert out.count() == brute([(r.doc_id, r.text) for r in df.collect()])[1]
    assert D.deduplicated(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
