import hashlib
import random
from collections import Counter

import numpy as np

from classyard.llm import suffix_dedup as S
from classyard.llm.textvec import Buffer

from .util import DOC_SCHEMA, edge_docs, empty_docs, words


def brute(texts, span=S.SPAN):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + span] for r in raw for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - span + 1):
            if seen[r[i:i + span]] > 1:
                gone[i:i + span] = True
        gone = gone[:-1]
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_every_string_has_one_anchor_by_content():
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(0, 300), 30) for _ in range(40)] + ["", "x" * 199, "x" * 200, "y" * 700, "ab" * 400]
    owner = {}
    buf = Buffer(texts)
    doc, a, first, last, h = S.anchors(buf)
    total = 0
    for d, p, lo, hi in zip(doc, a, first, last):
        assert buf.starts[d] <= lo <= p and hi + S.SPAN < buf.ends[d] and 0 <= p - hi <= p - lo < S.WIDTH
        for s in range(lo, hi + 1):
            text = buf.data[s:s + S.SPAN].tobytes()
            assert owner.setdefault(text, p - s) == p - s
            total += 1
    assert total == sum(max(0, len(t.encode()) - S.SPAN + 1) for t in texts)


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 20):
        runs = []
        for _ in range(k):
            rows = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(0, 60)))
            run = S.pack_run([(r, r[:3][::-1], 5, 2, 1) for r in rows])
            right, lcp, left, info = S.unpack_run(run)
            assert right == rows and left == [r[:3][::-1] for r in rows] and info.tolist() == [[5, 2, 1]] * len(rows)
            runs.append((right, lcp))
        who, index, known = S.merge_runs(runs)
        got = [runs[w][0][i] for w, i in zip(who, index)]
        assert got == sorted(s for r in runs for s in r[0])
        assert known[1:].tolist() == [S._first_difference(x, y, 0) for x, y in zip(got, got[1:])]


def check(spark, texts):
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOC_SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup_digests(df).collect()}
    want = brute(texts)
    assert [got[k] for k in range(len(texts))] == want
    return want


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    passages = [words(rng, 60, 10 ** 6) for _ in range(6)] + ["é" * 150, "z" * 260, "abc " * 90]
    texts = []
    for _ in range(70):
        parts = [words(rng, rng.randrange(0, 40), 10 ** 6)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            lo = rng.randrange(0, 60)
            parts += [p[lo:lo + rng.randrange(150, 420)], words(rng, rng.randrange(0, 12), 10 ** 6)]
        texts.append(" ".join(parts))
    exact = words(rng, 100, 10 ** 6)
    texts += [exact[:200], "q" + exact[:200], exact[:199] + "Q", "w" * 199, "w" * 199, "v" * 201, None, "", texts[0], texts[0]]
    assert sum(w[1] for w in check(spark, texts)) > 10_000


def test_edges(spark):
    rows = S.dedup_digests(edge_docs(spark)).collect()
    assert len(rows) == edge_docs(spark).count()
    again = [r for r in rows if r.doc_id == 1]
    assert len(again) == 3 and len({r.kept_sha256 for r in again}) == 1
    assert S.dedup_digests(empty_docs(spark)).count() == 0
