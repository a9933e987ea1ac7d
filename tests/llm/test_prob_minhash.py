import random
import re
from collections import Counter, defaultdict

import numpy as np

from classyard.llm import prob_minhash as N

from .util import DOC_SCHEMA, edge_docs, empty_docs, words


def multiset(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def slow_similarity(a, b):
    """The definition, over all shingles of both."""
    if not a or not b:
        return 0.0
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in set(a) & set(b))


def brute_classes(texts, limit=N.SIMILARITY):
    sets = [multiset(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by[g].append(k)
    for k, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j < k}:
            if slow_similarity(s, sets[j]) >= limit - 1e-9:
                root[find(k)] = find(j)
    return [find(k) for k in range(len(texts))]


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def test_similarity_and_signature():
    rng = random.Random(0)
    a = words(rng, 300, 50) + " " + "same line of six words here " * 9
    for share in (0.0, 0.01, 0.03, 0.1):
        b = edited(rng, a, share)
        doc, ids, count = N.shingles([a, None, "", b])
        x, y = (ids[doc == 0], count[doc == 0]), (ids[doc == 3], count[doc == 3])
        want = slow_similarity(multiset(a), multiset(b))
        assert abs(N.probability_jaccard(*x, *y) - want) < 1e-9
        sig = N.signatures(doc, ids, count, 4)
        assert abs((sig[0] == sig[3]).mean() - want) < 0.13 and not sig[1].any()
        alone = N.signatures(np.zeros(len(x[0]), int), *x, 1)     # independent of the batch
        assert (alone[0] == sig[0]).all()


def test_shingles_of_short_texts():
    doc, ids, count = N.shingles(["a b", "a b", "a b c", " ", "a b c d e a b c d e", "x"])
    assert np.bincount(doc, minlength=6).tolist() == [1, 1, 1, 0, 5, 1] and count.sum() == 10
    assert ids[0] == ids[1] != ids[2]


def test_classes_against_all_pairs(spark):
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(1, 200)) for _ in range(60)]
    texts += [edited(rng, texts[k % 9], 0.01 + 0.005 * (k % 8)) for k in range(150)]
    texts += texts[:10] + [None, "", " \n ", None]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOC_SCHEMA).repartition(4)
    got = {r.doc_id: r for r in N.near_classes(df).collect()}
    want = brute_classes(texts)
    smallest = {}
    for k, c in enumerate(want):
        smallest.setdefault(c, k)
    assert len(got) == len(texts)
    size = Counter(want)
    for k, c in enumerate(want):
        assert got[k].class_id == smallest[c], k
        assert got[k].class_size == size[c] and got[k].kept == (k == smallest[c])


def test_edges(spark):
    df = edge_docs(spark)
    rows = N.near_classes(df).collect()
    assert len(rows) == df.count() and sum(r.class_size == 1 for r in rows) < len(rows)
    kept = N.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in rows)
    assert N.near_classes(empty_docs(spark)).count() == 0


def test_unlinked_families_in_large_buckets(spark):
    """Documents around one long passage: all meet in large buckets, only twins are similar enough."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(204))
    tail = lambda n: " ".join(f"t{rng.randrange(10 ** 9)}" for _ in range(n))
    texts = [f"{passage} {tail(27)}" for _ in range(10)]
    for _ in range(16):
        both = tail(3)
        texts += [f"{passage} {both} {tail(24)}" for _ in range(2)]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOC_SCHEMA)
    want = brute_classes(texts)
    assert len(set(want)) == 26
    got = {r.doc_id: r.class_id for r in N.near_classes(df).collect()}
    smallest = {c: min(k for k, d in enumerate(want) if d == c) for c in want}
    assert got == {k: smallest[c] for k, c in enumerate(want)}


def family(rng, n):
    texts = [words(rng, 150, 60) + " again and again the same line" * (k % 3) for k in range(6)] + ["a b", "a b", "", "x"]
    return texts + [edited(rng, texts[k % 6], 0.01 + 0.004 * (k % 5)) for k in range(n)]


def joined(n, links, label):
    root = list(label)
    for a, b in links:
        root = [root[a] if r == root[b] else r for r in root]
    first = {}
    return [first.setdefault(r, k) for k, r in enumerate(root)]


def test_block_links_join_what_all_pairs_join():
    texts = family(random.Random(5), 40)
    n, sets = len(texts), [multiset(t) for t in texts]
    pairs = [(a, b) for b in range(n) for a in range(b) if slow_similarity(sets[a], sets[b]) >= N.SIMILARITY - 1e-9]
    side = np.arange(n) % 3
    for label in (list(range(n)), [k // 2 * 2 for k in range(n)]):
        got = N.block_links(*N.shingles(texts), label, None)
        assert got and set(got) <= set(pairs) and joined(n, got, label) == joined(n, pairs, label)
        cross = N.block_links(*N.shingles(texts), label, side)
        assert joined(n, cross, label) == joined(n, [(a, b) for a, b in pairs if side[a] != side[b]], label)


def test_blocks_and_wide_families_lose_nothing(spark, monkeypatch):
    texts = family(random.Random(9), 60)
    sets = [multiset(t) for t in texts]
    n = len(texts)
    pairs = [(a, b) for b in range(n) for a in range(b) if slow_similarity(sets[a], sets[b]) >= N.SIMILARITY - 1e-9]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    # bucket 1 holds all, bucket 2 the even ones; node 0 and 6 are linked already
    rows = [(1, k, 0 if k == 6 else k) for k in range(n)] + [(2, k, 0 if k == 6 else k) for k in range(0, n, 2)]
    members = spark.createDataFrame(rows, "key long, node long, label long")
    label = [0 if k == 6 else k for k in range(n)]
    want = joined(n, pairs, label)
    for block, bands in ((1024, 28), (16, 28), (16, 2)):      # one block; a grid of blocks; bucket by bucket
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "BANDS", bands)
        got = [(r.a, r.b) for r in N.family_links(frame, members, N.SIMILARITY).collect()]
        assert set(got) <= {p for p in pairs} and joined(n, got, label) == want
