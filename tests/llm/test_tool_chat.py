import json

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from classyard.llm import tool_chat as T


def run(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, tool string, arguments string, level int, errors string")
    r = spark.createDataFrame(results, "call_id string, content string, conv_id long, status string")
    return T.linked(c.repartition(3), r.repartition(3)).collect()


def test_statuses_levels_and_json(spark):
    good = '{"query" : "x",\n "limit":3}'
    rows = run(spark, [
        (1, "a", None, "search", good, 9, "e"), (1, "b", "a", "search", good, 9, "e"), (1, "c", "b", "search", '{"query":"","limit":99}', 9, "e"),
        (1, "d", "gone", "search", good, 9, "e"), (2, "x", "y", "search", good, 9, "e"), (2, "y", "x", "search", good, 9, "e"),
        (2, "z", "x", "search", good, 9, "e"), (3, "s", "s", "search", good, 9, "e"), (None, None, "a", "search", good, 9, "e"),
        (4, "dup", None, "search", good, 9, "e"), (4, "dup", None, "search", good, 9, "e"), (4, "n", None, None, None, 9, "e"),
        (4, "arr", None, "search", "[1]", 9, "e"), (4, "t", None, "nope", "{}", 9, "e"), (4, "u", None, "search", '{"query":5,"limit":"3","z":1}', 9, "e"),
        (4, "broken", None, "search", "{", 9, "e")],
        [("a", 'r "1"\n', 0, "q"), ("b", None, 0, "q"), ("c", "x", 0, "q"), ("x", "x", 0, "q"), ("zz", "lost", 0, "q"), (None, "none", 0, "q"),
         ("dup", "b", 0, "q"), ("dup", "a", 0, "q"), ("n", "x", 0, "q"), ("arr", "x", 0, "q"), ("t", "x", 0, "q"), ("u", "x", 0, "q"), ("broken", "x", 0, "q")])
    by = {r.call_id: r for r in rows if r.call_id}
    assert {k: (r.status, r.level) for k, r in by.items()} == {
        "a": ("ok", 0), "b": ("ok", 1), "c": ("invalid", 2), "d": ("unanswered", 0), "x": ("cycle", None), "y": ("cycle", None),
        "z": ("cycle", None), "s": ("cycle", None), "dup": ("ok", 0), "n": ("invalid", 0), "arr": ("invalid", 0), "t": ("invalid", 0),
        "u": ("invalid", 0), "broken": ("invalid", 0), "zz": ("orphan", None)}
    assert [r.status for r in rows if r.call_id is None] == ["unidentified"] * 2
    assert by["a"].json == '{"arguments":{"limit":3,"query":"x"},"call_id":"a","level":0,"parent_id":null,"result":"r \\"1\\"\\n","tool":"search"}'
    for r in rows:
        assert json.loads(r.json) is not None and json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert json.loads(by["dup"].json)["result"] == "a"
    assert by["u"].errors == "unknown argument; limit is no integer; query is no string"
    assert by["c"].errors == "limit is out of bounds; query is out of bounds"
    assert by["t"].errors == "unknown tool" and by["n"].errors == by["arr"].errors == by["broken"].errors == "arguments are no object"


def test_long_chain_and_many_children(spark):
    n = 300
    calls = [(1, f"k{i}", f"k{i - 1}" if i else None, "search", "{}", 0, "") for i in range(n)]
    calls += [(1, f"m{i}", "k7", "search", "{}", 0, "") for i in range(200)]
    level = {r.call_id: r.level for r in run(spark, calls, [("k0", "x", 1, "")])}
    assert all(level[f"k{i}"] == i for i in range(n)) and all(level[f"m{i}"] == 8 for i in range(200))


def test_empty_and_conversations_with_nulls(spark):
    assert run(spark, [], []) == []
    m = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", None), (None, 2, "user", "a"), (1, None, "assistant", "b"),
                               (2, 0, None, "c"), (1, 0, "user", None), (3, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    got = sorted((r.call_id or "", r.status) for r in T.chat_links(m).collect())
    assert got == [("", "unidentified"), ("", "unidentified"), ("1:0", "invalid")]


def against_sql(frame, messages):
    con = duckdb.connect()
    con.register("conversations", messages)
    want = con.execute(T.ORACLE_SQL).fetchdf()
    got = T.chat_rows(frame).toPandas()[list(want.columns)]
    assert got.n_calls.sum() + got.n_results.sum() + (got.status == "message").sum() == frame.count()
    order = ["conv_id", "call_id", "status", "json"]
    pd.testing.assert_frame_equal(*[x.astype({"conv_id": "float", "level": "float"}).astype({"call_id": object, "parent_id": object, "tool": object})
                                    .fillna({"call_id": "", "parent_id": "", "tool": ""}).sort_values(order).reset_index(drop=True)
                                    for x in (got, want)], check_dtype=False)
    return got


def test_query_matches_sql(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    against_sql(frame, frame.toPandas())


def test_every_message_is_accounted_for(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a c"), (1, 1, "assistant", "y"), (1, 1, "assistant", "x"),
            (1, 2, "user", "é " * 20), (1, 2, "user", "zz"), (2, 1, "assistant", None), (None, 0, "user", "q"), (None, 1, "assistant", "r"),
            (3, None, "user", "s"), (4, 0, "system", 's "1"'), (4, 0, "system", 's "1"'), (4, None, None, None), (None, 3, "tool", "t"),
            (5, 0, "user", "long " * 30000), (5, 1, "assistant", "l" * 200000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    got = against_sql(frame.withColumns({c: F.lit(c) for c in ("call_id", "n_calls", "status", "k")}), table)
    assert got.status.value_counts().to_dict() == {"message": 4, "unidentified": 3, "ok": 2, "unanswered": 1, "orphan": 1}
    first = got[got.call_id == "1:0"].iloc[0]
    assert (first.n_calls, first.n_results) == (3, 2) and json.loads(first.json)["result"] == "x"
    assert got[got.call_id == "2:0"].conv_id.tolist() == [2]


def test_identifiers_of_one_conversation(spark):
    good = '{"query" : "x", "limit":3}'
    calls = spark.createDataFrame([(c, "call_0", None, "search", good) for c in (1, 2, None)] + [(2, "call_1", "call_0", "search", good), (1, "call_2", "call_1", "search", good)],
                                  "conv_id long, call_id string, parent_id string, tool string, arguments string")
    results = spark.createDataFrame([(1, "call_0", "one"), (2, "call_0", "two"), (2, "call_0", "two"), (None, "call_0", "none"), (1, "call_1", "lost")],
                                    "conv_id long, call_id string, content string")
    got = {(r.conv_id, r.call_id): (r.status, r.level, json.loads(r.json)["result"], r.n_calls, r.n_results) for r in T.linked(calls, results, within=True).collect()}
    assert got == {(1, "call_0"): ("ok", 0, "one", 1, 1), (2, "call_0"): ("ok", 0, "two", 1, 2), (None, "call_0"): ("ok", 0, "none", 1, 1),
                   (2, "call_1"): ("unanswered", 1, None, 1, 0), (1, "call_2"): ("unanswered", 0, None, 1, 0), (1, "call_1"): ("orphan", None, "lost", 0, 1)}
