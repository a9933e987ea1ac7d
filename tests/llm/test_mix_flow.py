import itertools
import re
from collections import Counter, defaultdict

import pytest

from classyard.llm import mix_flow as M

from .util import DOC_SCHEMA, edge_docs, empty_docs


def test_targets_share_and_reshare():
    assert M.targets([100, 100, 100], [1, 2, 3], 300) == [50.0, 100.0, 150.0]
    t = M.targets([10, 1000, 1000], [3, 1, 1], 2010)
    assert t[0] == 30.0 and t[1] == t[2] == 990.0
    assert M.targets([0, 5], [1, 1], 5) == [0.0, 5.0] and M.targets([], [], 0) == []


def cost(flow, capacity):
    used = Counter()
    for (p, _), f in flow.items():
        used[p] += f
    return sum(sum(max(0, f - k * capacity[p]) for k in range(1, 3)) for p, f in used.items())


def test_flow_is_maximal_and_cheapest():
    capacity = {"a": 3, "ab": 4, "b": 2}
    members = {"a": ["A"], "ab": ["A", "B"], "b": ["B"]}
    for qa, qb in itertools.product(range(0, 28, 3), repeat=2):
        flow = M.min_cost_flow(capacity, members, {"A": qa, "B": qb})
        got = {s: sum(f for (_, m), f in flow.items() if m == s) for s in "AB"}
        best = None
        for x, y, z in itertools.product(range(10), range(13), range(7)):     # a->A, ab->A and ab->B, b->B
            if x <= qa and z <= qb:
                f = {("a", "A"): x, ("ab", "A"): min(y, qa - x), ("b", "B"): z}
                for w in range(0, 13 - f["ab", "A"]):
                    if z + w <= qb:
                        f["ab", "B"] = w
                        key = (-sum(f.values()), cost(f, capacity))
                        best = key if best is None or key < best else best
        assert (-sum(flow.values()), cost(flow, capacity)) == best
        assert got["A"] <= qa and got["B"] <= qb


def check(rows, docs):
    size = {}
    by = defaultdict(list)
    for d, t, s in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        by[s].append(n)
        size.setdefault(d, Counter())[n] += 1
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    goal = M.targets([sum(by[s]) for s in names], [1 + k % 3 for k in range(len(names))], sum(map(sum, by.values())))
    assert len(rows) == len(docs)
    taken = defaultdict(int)
    for r in rows:
        assert size[r.doc_id][r.size] and r.taken in {k * r.size for k in range(M.REPEATS + 1)}
        taken[r.source_size, r.target] += r.taken
    want = defaultdict(float)
    for s, g in zip(names, goal):
        want[sum(by[s]), g] += g
    for (total, g), t in taken.items():
        assert abs(t - want[total, g]) <= max(max(x) for x in by.values())


def test_mix_of_edge_cases(spark):
    df = edge_docs(spark)
    rows = M.mix_digests(df).collect()
    check(rows, [(r.doc_id, r.text, r.source) for r in df.collect()])
    assert sorted(map(str, rows)) == sorted(map(str, M.mix_digests(df.repartition(7)).collect()))
    assert M.mix_digests(empty_docs(spark)).count() == 0
    mixed = M.mixed(df)
    assert mixed.columns == df.columns
    times = Counter()
    for r in rows:
        times[r.doc_id] += r.taken // r.size if r.size else 0
    assert Counter(r.doc_id for r in mixed.collect()) == +times


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_of_documents(spark, seed):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix(M._rows(docs, seed, False)).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.source, r.target] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(t - g) <= largest for (_, g), t in by.items())


def test_sql_counts_words_between_all_white_bytes(spark):
    import duckdb
    import pandas as pd
    docs = edge_docs(spark, wide=False).unionByName(spark.createDataFrame(
        [(900, "a\rb\x0bc d\x0ce\tf\ng", "en", "src0", 1), (901, "\x1c  x", "en", "src1", 1)], DOC_SCHEMA))
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(M.ORACLE_SQL).fetchdf()
    got = M.mix_digests(docs).toPandas()[list(want.columns)]
    order = ["doc_id", "size", "taken"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)
    assert got[got.doc_id == 900]["size"].tolist() == [7]
