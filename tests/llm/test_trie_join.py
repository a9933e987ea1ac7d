"""Jaccard links by tries against all pairs by the definition and against SQL."""
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from classyard.llm import trie_join as T
from tests.llm.util import edge_docs, empty_docs

SCHEMA = "doc_id long, text string, node long, n long, label long, part int, cell string, sub string"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x for x in (text or "").translate(UP).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ")
         .replace("\x0c", " ").split(" ") if x]
    return frozenset(tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def plain(rows):
    """{(doc_id, text): (size, component)} by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted((d if d is not None else -1, len(sets[k]), (least.get(find(k), -1) if sets[k] else d) or (0 if d == 0 or least.get(find(k)) == 0 else -1))
                  for k, (d, _) in enumerate(rows))


def family_docs(seed=3):
    """Families around the threshold at sizes on both sides of every bound."""
    rng = random.Random(seed)
    rows, k = [], 1
    passage = " ".join(f"lic{j}" for j in range(40))
    for size in (1, 2, 3, 9, 10, 11, 12, 30, 80, 95, 105, 115, 130, 300, 900):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for copy in range(9):
            w = list(base)
            for _ in range(rng.randrange(0, 2 + size // 40)):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([[], [f"e{rng.randrange(10 ** 6)}"], [w[at], f"i{rng.randrange(10 ** 6)}"]])
            text = " ".join(w)
            if copy % 4 == 3:
                text = passage + "\n" + text
            rows.append((k, text.title() if copy % 2 else text))
            k += 1
    rows += [(k + j, " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(60)) + " " + passage) for j in range(20)]
    rows += [(900, rows[40][1]), (901, rows[40][1]), (5, rows[4][1]), (None, rows[60][1]), (None, "only nulls here now"), (None, "only nulls here now"),
             (902, None), (903, ""), (904, " \t\n"), (905, "a\x0bb\x0cc\rd"), (906, "a b c d"), (907, "é É"), (908, "É é")]
    return rows


def result(spark, rows):
    df = spark.createDataFrame([r + (1, 2, 3, 4, "x", "y") for r in rows], SCHEMA).repartition(4)
    got = T.linked(df).toPandas().fillna(-1)[["doc_id", "n_shingles", "component_id"]].astype(int)
    return sorted(got.itertuples(index=False, name=None))


def test_equals_all_pairs_and_sql(spark):
    rows = family_docs()
    want = plain(rows)
    assert result(spark, rows) == want
    assert len({c for _, n, c in want if n}) > 40 and sum(c != d for d, n, c in want if n and d > 0) > 60
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    sql = con.execute(T.ORACLE_SQL).fetchdf().fillna(-1)[["doc_id", "n_shingles", "component_id"]].astype(int)
    assert sorted(sql.itertuples(index=False, name=None)) == want


def test_groups_beyond_one_task(spark, monkeypatch):
    """One family around a passage, and several that share rare shingles only,
    with bounds so low that blocks, centres and the grid of blocks are used."""
    monkeypatch.setattr(T, "GROUP_SHINGLES", 1500)
    monkeypatch.setattr(T, "CENTRES", 2)
    rng = random.Random(5)
    rows, shared = [], [f"s{j}" for j in range(60)]
    for fam in range(6):
        base = shared + [f"f{fam}x{j}" for j in range(8 + fam % 2)]
        for copy in range(14):
            w = list(base)
            if copy % 3:
                w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
            rows.append((100 * fam + copy, " ".join(w)))
    assert result(spark, rows) == plain(rows)


def test_sets_of_other_sizes_are_not_grouped(spark):
    """A short text that stands in long ones shares its rarest shingles with them, but no link."""
    short = [f"x{j}" for j in range(30)]
    passage = [f"p{j}" for j in range(60)]
    texts = [short, short[:-1] + ["y"], short + passage, short + passage[:-1] + ["z"], *[passage[:-1] + [f"e{k}"] for k in range(4)]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = T.document_sets(docs)
    live = T.live_sets(docs, T.screened(sets))
    label = {r["doc_id"]: r["label"] for r in T.grouped(T.prefixes(live)).join(live.select("node", "doc_id"), "node").collect()}
    assert label[0] == label[1] and label[2] == label[3] and label[0] != label[2]
    got = {r["doc_id"]: r["component_id"] for r in T.linked(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 4}


def test_walkers_meet_only_sets_with_a_rare_token_in_common(monkeypatch):
    """Sets that share a frequent part, each with rare tokens of one other set only."""
    seen = []
    count = np.count_nonzero
    rng = np.random.default_rng(4)
    common = np.arange(100, dtype=np.uint64)
    sets = []
    for pair in range(150):
        own = np.arange(40, dtype=np.uint64) + np.uint64(1000 * (pair + 1))
        sets += [np.concatenate([common, own]), np.concatenate([common, own[:-1]])]
    sets = [sets[k] for k in rng.permutation(len(sets))]
    monkeypatch.setattr(T.np, "count_nonzero", lambda x: seen.append(len(x)) or count(x))
    cumsum = np.cumsum
    monkeypatch.setattr(T.np, "cumsum", lambda x, *a, **k: seen.append(len(x)) or cumsum(x, *a, **k))
    label = T.join_sets(sets, [len(s) for s in sets])
    assert len(set(label.tolist())) == 150
    assert sum(seen) < 20 * sum(len(s) for s in sets)         # not every set against all tokens


def test_join_sets_equals_definition():
    rng = np.random.default_rng(2)
    for trial in range(30):
        base = rng.choice(10 ** 6, rng.integers(1, 80), replace=False)
        sets = []
        for _ in range(rng.integers(2, 25)):
            keep = base[rng.random(len(base)) < rng.choice([1.0, 0.97, 0.9])]
            new = rng.choice(10 ** 9, rng.integers(0, 3)) + 10 ** 7
            s = np.unique(np.concatenate([keep, new])).astype(np.uint64)
            if len(s):
                sets.append(s)
        label = T.join_sets(sets, [len(s) for s in sets])
        up = np.arange(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    up[up == up[a]] = up[b]
        assert len(set(zip(label.tolist(), up.tolist()))) == len(set(label.tolist())) == len(set(up.tolist()))


@pytest.mark.parametrize("low", [False, True])
def test_edges(spark, low):
    assert T.linked(empty_docs(spark)).count() == 0
    docs = edge_docs(spark, wide=not low)
    got = T.linked(docs).toPandas().fillna(-1)[["doc_id", "n_shingles", "component_id"]].astype(int)
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(got.itertuples(index=False, name=None)) == want
