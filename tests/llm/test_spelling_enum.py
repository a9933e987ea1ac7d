"""Spelling variants against all pairs in Python and against SQL."""
import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd

from classyard.llm import spelling_enum as S
from tests.llm.util import edge_docs, empty_docs

SCHEMA = "doc_id long, text string, word string, n long, size int, key long, root string"


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(docs, slip=31):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % slip == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in close.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), n[w], len(close[w]), n[form[w]] if form[w] else 0) for w in n)


def documents():
    rng = random.Random(7)
    letters = "abcdÀéÿ÷n"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 15))) for _ in range(25)] + ["aaaaaaa", "abababab", "ÀÀÀÀÀÀÀé"]
    words = list(stems)
    for s in stems:                                             # one and two edits, swaps and anagrams
        for _ in range(14):
            w = list(s)
            for _ in range(rng.choice([1, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], [rng.choice(letters)], [w[k], rng.choice(letters)], [w[k], w[k]]])
            words.append("".join(w))
        words.append(s[::-1])
        words.append(s[1] + s[0] + s[2:])
    docs = [(k, " ".join(rng.choices(words, [1 + 4000 / (1 + j) ** 2 for j in range(len(words))], k=300)).title() + ", x1y") for k in range(60)]
    chain = ["chained", "chainedd", "chaineddd"]
    docs += [(100 + 10 * k + j, " ".join([chain[k]] * 3 * 20 ** k)) for k in range(3) for j in range(5)]
    return docs + [(None, "Chained-chained"), (200, None), (201, ""), (202, " \n"), docs[0], (203, "lengthy " * 20000)]


def test_equals_all_pairs_and_sql(spark):
    docs = documents()
    df = spark.createDataFrame([d + ("w", 1, 2, 3, "r") for d in docs], SCHEMA).repartition(4)
    got = S.corpus_variants(df).toPandas().fillna({"form": "", "form_n": 0})[["word", "form", "root", "n", "n_near", "form_n"]]
    want = plain(docs)
    assert sorted(got.astype({"form_n": int}).itertuples(index=False, name=None)) == want
    assert sum(w[4] > 1 for w in want) > 100 and sum(bool(w[1]) for w in want) > 50
    assert any(w[2] != w[1] for w in want if w[1])             # a form that has a form
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    sql = con.execute(S.ORACLE_SQL).fetchdf().fillna({"form": "", "form_n": 0})[["word", "form", "root", "n", "n_near", "form_n"]]
    assert sorted(sql.astype({"form_n": int}).itertuples(index=False, name=None)) == want


def test_each_pair_comes_once(spark):
    words = sorted({w for w, *_ in plain(documents())})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = [tuple(sorted((r.a, r.b))) for r in S.near_pairs(df).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_words_are_not_broadcast(spark, monkeypatch):
    """Signatures of a small file are many rows: no join may send one side to all."""
    plans, stored = [], S.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)
    monkeypatch.setattr(S, "stored", seen)
    docs = [(k, "letters lettersx letterss " * 4) for k in range(40)]
    out = S.corpus_variants(spark.createDataFrame(docs, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 10 ** 6
    assert sum("SortMergeJoin" in p for p in plans) > 2 and not any("Broadcast" in p for p in plans)


def test_edges(spark):
    assert S.corpus_variants(empty_docs(spark)).count() == 0
    docs = edge_docs(spark)
    got = S.corpus_variants(docs).toPandas().fillna({"form": "", "form_n": 0})[["word", "form", "root", "n", "n_near", "form_n"]]
    assert sorted(got.itertuples(index=False, name=None)) == plain([(r.doc_id, r.text) for r in docs.collect()])
