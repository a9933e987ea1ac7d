"""Each stage against a brute-force version on what its predecessor kept."""
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from classyard.llm import mix_flow, pack_bfd, toxicity
from classyard.llm.tokens import ChunkEncoder

from .test_prob_minhash import brute_classes
from .util import WIDE_SCHEMA, edge_docs

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def stages(spark, docs, sf_dir, tmp):
    out = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{tmp}/{k}")
        out.append(spark.read.parquet(f"{tmp}/{k}"))
    return out


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def check(spark, docs, sf_dir, tmp):
    raw, clean, exact, near, mixed, packed = stages(spark, docs, sf_dir, tmp)
    for d in (clean, exact, near, mixed):
        assert d.columns == raw.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.judge(raw, labels).collect() if r.toxic}
    rows = [r for r in raw.collect() if r.doc_id not in toxic]
    assert Counter(map(str, rows)) == Counter(map(str, clean.collect()))
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    assert Counter((min(g)[2], t) for t, g in groups.items()) == Counter((r.doc_id or 0, norm(r.text)) for r in exact.collect())
    rows = sorted(exact.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    first = {}
    for r, c in zip(rows, brute_classes([r.text for r in rows])):
        first.setdefault(c, r)
    assert Counter(map(str, first.values())) == Counter(map(str, near.collect()))
    taken = Counter()
    for r in mix_flow.mix_digests(near).collect():
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    assert Counter(r.doc_id for r in mixed.collect()) == +taken
    tok = ChunkEncoder(BYTE, True).tok
    want = Counter(tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in mixed.collect())
    pieces, fill = defaultdict(list), Counter()
    for r in packed.collect():
        pieces[r.doc_id, r.start].append(np.frombuffer(bytes(r.ids), np.uint16))
        fill[r.sequence_id] += r.length
    got = Counter()
    for (d, start), parts in pieces.items():
        if start == 0:
            for k in range(len(parts)):
                at, ids = 0, []
                while (d, at) in pieces and k < len(pieces[d, at]):
                    ids += pieces[d, at][k].tolist()
                    at += pack_bfd.WINDOW
                got[tuple(ids)] += 1
    assert got == want and all(n <= pack_bfd.WINDOW for n in fill.values())


def test_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, tmp_path)


def test_edge_cases(spark, tmp_path):
    check(spark, edge_docs(spark, n=25), "/root/testdata/sf0.001", tmp_path)


@pytest.mark.parametrize("query", sorted(k for k in E.queries() if re.match(r"op\d+_|pipeline", k)))
def test_queries_on_empty_tables(spark, tmp_path, query):
    for t in ("documents", "labels", "pages", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert E.queries()[query](spark, str(tmp_path)).count() == 0


def test_all_queries_are_registered():
    names = [k for k in E.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert WIDE_SCHEMA
