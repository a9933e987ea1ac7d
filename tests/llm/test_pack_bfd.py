import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from classyard.llm import pack_bfd as P
from classyard.llm.tokens import ChunkEncoder

from .util import DOC_SCHEMA, edge_docs, empty_docs

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def slow_best_fit(lengths, size):
    rooms, out = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return sorted(rooms)


def test_tree_equals_plain_best_fit():
    rng = random.Random(5)
    for size in (1, 7, 64, 1000, 1024):
        lengths = sorted((rng.randint(1, size) for _ in range(400)), reverse=True)
        w, off = P.best_fit_decreasing(lengths, size)
        fill = defaultdict(int)
        for k, n in enumerate(lengths):
            assert off[k] == fill[w[k]]
            fill[w[k]] += n
        assert sorted(size - f for f in fill.values()) == slow_best_fit(lengths, size)
    assert P.best_fit_decreasing([], 10) == ([], [])


def test_pack_round_trip(spark):
    df = edge_docs(spark)
    packed = P.pack(df, BYTE).collect()
    tok = ChunkEncoder(BYTE, True).tok
    want = sorted(tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in df.collect())
    docs = defaultdict(list)
    seqs = defaultdict(list)
    for r in packed:
        ids = np.frombuffer(bytes(r.ids), np.uint16).tolist()
        assert len(ids) == r.length
        docs[r.doc_id].append((r.start, ids, r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= P.WINDOW
    joined = []
    for parts in docs.values():
        by_start = defaultdict(list)
        for start, ids, n in parts:
            by_start[start].append((ids, n))
        for k in range(len(by_start[0])):          # repeated rows have equal pieces
            joined.append(tuple(i for s in sorted(by_start) for i in by_start[s][k][0]))
    assert sorted(joined) == want
    assert len(seqs) <= 1.1 * sum(map(len, want)) / P.WINDOW + 2
    got = {(r.doc_id, r.start, r.ids_crc32) for r in P.packed_digests(df, BYTE).collect()}
    assert got == {(r.doc_id, r.start, zlib.crc32(np.frombuffer(bytes(r.ids), np.uint16).astype("<u4").tobytes())) for r in packed}
    s = P.sequences(P.pack(df, BYTE)).collect()
    assert len(s) == len(seqs) and all(len(r.ids) == 2 * P.WINDOW for r in s)
    assert P.pack(empty_docs(spark), BYTE).count() == 0


def test_full_windows_are_in_no_group(spark):
    """A group holds remainders only, however long the documents are."""
    texts = ["word " * 30_000, "word " * 50_000, "short one", None]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOC_SCHEMA)
    rows = P.pieces(df, BYTE, 0, P.WINDOW, 1).collect()
    full = [r for r in rows if r.length == P.WINDOW]
    assert len(full) > 50 and all(r.shard is None for r in full)
    assert len({r.sequence_id for r in full}) == len(full)
    assert len([r for r in rows if r.shard is not None]) <= len(texts)
    packed = P.pack(df, BYTE).collect()
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert len(packed) == len(rows) and max(fill.values()) <= P.WINDOW
