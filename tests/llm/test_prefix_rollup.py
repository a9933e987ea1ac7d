"""Prefix trie against a plain trie in Python and against SQL, on a fixture with
nulls, ties, long and turnless conversations."""
import hashlib
import random
import zlib

import duckdb
import pandas as pd

from classyard.llm import prefix_rollup as P

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k1 string, pos int"


def fixture():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 60), 100, 101, 150, 207, 233, 1007, 1201]:
        for t in range(rng.choice([1, 2, 3, 4, 6, 9, 17, 26])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "long " * 50])))
    rows += [(300 + k, t, "user", f"same {t}") for k in range(20) for t in range(19)]          # equal conversations
    rows += [(3, None, None, None), (3, None, "user", "x"), (7, 1, None, "tie"), (7, 1, "user", None), (7, 1, "user", None),
             (None, 0, "user", "nobody"), (400, 0, "ü", "\U0001F600é")]
    return rows


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_equals_plain_trie_and_sql(spark):
    rows = fixture()
    df = spark.createDataFrame([r + (9, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = P.node_digests(df).toPandas()[COLS]
    got["parent_conv_id"] = got["parent_conv_id"].fillna(-1)
    assert sorted(got.astype({"parent_conv_id": int}).itertuples(index=False, name=None)) == plain(rows)
    assert got.depth.max() > 2 * P.BLOCK                       # three blocks of columns
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(P.ORACLE_SQL).fetchdf()[COLS]
    want["parent_conv_id"] = want["parent_conv_id"].fillna(-1)
    assert sorted(want.astype({"parent_conv_id": int}).itertuples(index=False, name=None)) == plain(rows)


def test_empty_table_and_one_turnless_conversation(spark):
    assert P.node_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    bare = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = P.node_digests(spark.createDataFrame([(bare, 0, "user", "x", 0, "", 0)], SCHEMA)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in rows] == [(bare, 0, 1, 0, 1, 0)]
    assert rows[0].ends_sha256 == hashlib.sha256(str(bare).encode()).hexdigest()
