"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A node is a distinct sequence of first turns.  Conversations are laid out as rows
of ``BLOCK`` turn-id columns; a long one goes on in further rows, each keyed by
the node that its row before ends in.  One ``GROUP BY block, key, ROLLUP(t1 ... tB)``
then aggregates all prefixes of all blocks together, and ``grouping_id`` tells
the depth of each.  No round is made per turn or per block: a node's key is the
sum of position-salted digests of its turns (three numbers of 40 bits, added up
without overflow), so all blocks are keyed by one running sum.

A second ROLLUP gives the sums over subtrees.  What a node adds to its subtree is
charged to its smallest member; that conversation owns all nodes from there to
its end, so the sum over a subtree is the sum over its top's members of what
they own from the top's depth on (a running sum from the end).

Skew: ROLLUP aggregates before the shuffle, so a first turn that a third of all
conversations share costs one row per task.  Member ids of one node are hashed
as a sorted stream: one task holds a batch of them, never all.

Rows without conv_id are left out.  Null roles and texts are empty; a null turn
comes first, equal turns are ordered by role and text; repeated rows are turns of
their own.  An empty table has no nodes.  Texts of any length become digests in
the first pass and are not moved again.  Only the four named columns are read.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classyard.llm.common import stored

BLOCK = 8                       # positional columns
KEY = ["k1", "k2", "k3"]
NODE = ["depth", *KEY]


# --- turns ------------------------------------------------------------------

def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, chars): turns numbered from 1; ``turn_id`` is the
    MD5 of role and text, ``chars`` the code points of the text."""
    t = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return t.select("conv_id", F.row_number().over(w).cast("long").alias("pos"),
                    F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text")).alias("turn_id"),
                    F.char_length("text").cast("long").alias("chars"))


def shared_openings(turns: DataFrame, every: int = 100, longest: int = 6) -> DataFrame:
    """(conv_id, pos, turn_id, chars) of conversations that begin with the first h
    turns of conversation c - c % every and go on with their own behind the first
    h; h is the CRC-32 of the decimal c modulo ``longest``.  Conversations without
    any turn left are one row with a null pos."""
    c = F.col("conv_id")
    source = turns.where((c % every == 0) & (F.col("pos") < longest))
    heads = source.groupBy(c.alias("source")).agg(F.count(F.lit(1)).alias("have"))
    convs = (turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
             .select("conv_id", "own", (c - c % every).alias("source"),
                     (F.crc32(c.cast("string").cast("binary")) % longest).alias("h"))
             .join(heads, "source", "left")
             .select("conv_id", "own", "source", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("taken")))
    first = (convs.where("taken > 0").select("conv_id", "source", "taken")
             .join(source.select(c.alias("source"), "pos", "turn_id", "chars"), "source")
             .where("pos <= taken").select("conv_id", "pos", "turn_id", "chars"))
    rest = (turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h")
            .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id", "chars"))
    bare = convs.where("taken = 0 and own <= h").select("conv_id", F.lit(None).cast("long").alias("pos"),
                                                       F.lit(None).cast("string").alias("turn_id"), F.lit(0).cast("long").alias("chars"))
    return first.unionByName(rest).unionByName(bare)


# --- keys and blocks --------------------------------------------------------

def _limbs(pos: Column, turn_id: Column) -> list[Column]:
    """Three numbers of 40 bits from position and turn."""
    d = F.md5(F.concat_ws(":", pos.cast("string"), turn_id))
    return [F.conv(F.substring(d, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(3)]


def keyed(turns: DataFrame) -> DataFrame:
    """Adds the key of the node before (b1 ... b3) and after (k1 ... k3) each turn."""
    limbs = [F.when(F.col("turn_id").isNotNull(), x).otherwise(F.lit(0)) for x in _limbs(F.col("pos"), F.col("turn_id"))]
    t = turns.select("*", *[x.alias(f"l{i + 1}") for i, x in enumerate(limbs)])
    w = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("conv_id", "pos", "turn_id", "chars", "l1", "l2", "l3", *[F.sum(f"l{i}").over(w).alias(f"k{i}") for i in (1, 2, 3)])
    return t.select("conv_id", "pos", "turn_id", "chars", *KEY, *[(F.col(f"k{i}") - F.col(f"l{i}")).alias(f"b{i}") for i in (1, 2, 3)])


def blocks(turns: DataFrame, measures: list[str] = []) -> DataFrame:
    """One row per conversation and block: the key it goes on from and, by
    position, turn ids with the length of their text (and further measures)."""
    at = F.coalesce(F.col("pos") - 1, F.lit(0))
    t = turns.withColumn("block", F.floor(at / BLOCK)).withColumn("place", at % BLOCK)

    def put(col, i):
        return F.max(F.when(F.col("place") == i, col))
    cell = F.concat_ws(":", "turn_id", F.col("chars").cast("string"))
    cell = F.when(F.col("turn_id").isNotNull(), cell)
    return t.groupBy("conv_id", "block").agg(
        *[put(F.col(f"b{i}"), 0).alias(f"b{i}") for i in (1, 2, 3)],
        *[put(cell, i).alias(f"t{i + 1}") for i in range(BLOCK)],
        *[F.coalesce(put(F.col(m), i), F.lit(0)).alias(f"{m}{i + 1}") for m in measures for i in range(BLOCK)])


def rolled_up(rows: DataFrame, aggregates: dict[str, str]) -> DataFrame:
    """All prefixes of all blocks in one aggregate: (block, b1 ... b3, t1 ... tB,
    place, the aggregates); ``place`` is the number of turn columns that count.
    The empty prefix stays in the first block only, elsewhere it is the node that
    the block before ends in."""
    cols = ", ".join(f"t{i + 1}" for i in range(BLOCK))
    sums = "".join(f", {sql} AS {name}" for name, sql in aggregates.items())
    out = rows.sparkSession.sql(
        f"SELECT block, b1, b2, b3, {cols}, {BLOCK} - bit_count(grouping_id()) AS place{sums} "
        f"FROM {{rows}} GROUP BY block, b1, b2, b3, ROLLUP({cols})", rows=rows)
    last = F.array(*[F.col(f"t{i + 1}") for i in range(BLOCK)])[F.greatest(F.col("place") - 1, F.lit(0))]
    return (out.withColumn("last", last)
            .where((F.col("place") > 0) & F.col("last").isNotNull() | (F.col("place") == 0) & (F.col("block") == 0)))


def _node_keys(rolled: DataFrame) -> DataFrame:
    """Adds depth, the node's key and its parent's, from the columns of the prefix."""
    r = rolled.withColumn("depth", (F.col("block") * BLOCK + F.col("place")).cast("long"))
    cells = F.array(*[F.struct(*[x.alias(f"l{n + 1}") for n, x in enumerate(
        _limbs(F.col("block") * BLOCK + i + 1, F.substring_index(F.col(f"t{i + 1}"), ":", 1)))]) for i in range(BLOCK)])
    r = r.withColumn("limbs", cells)

    def total(n, upto):
        cut = F.slice("limbs", F.lit(1), F.greatest(upto, F.lit(0)))
        return F.aggregate(cut, F.col(f"b{n}"), lambda a, x: a + F.coalesce(x[f"l{n}"], F.lit(0)))
    return r.select(*[c for c in r.columns if c != "limbs"], *[total(n, F.col("place")).alias(f"k{n}") for n in (1, 2, 3)],
                    *[total(n, F.col("place") - 1).alias(f"parent_k{n}") for n in (1, 2, 3)]).withColumn(
        "chars", F.when(F.col("depth") > 0, F.substring_index("last", ":", -1).cast("long")).otherwise(0))


# --- ends -------------------------------------------------------------------

_ENDS = "depth long, k1 long, k2 long, k3 long, ends_sha256 string"


def _hash_stream(batches):
    """Rows sorted by node and conv_id: one running SHA-256, the node's digest when
    the next one begins."""
    now, running, done = None, None, []
    for batch in batches:
        node = [batch.column(i).to_pylist() for i in range(4)]
        ids = pc.cast(batch.column(4), pa.string()).to_pylist()
        for *key, c in zip(*node, ids):
            if key != now:
                if now is not None:
                    done.append((*now, running.hexdigest()))
                now, running = key, hashlib.sha256(c.encode())
            else:
                running.update(b"," + c.encode())
        if len(done) > 5000:
            yield _ends_batch(done)
            done = []
    if now is not None:
        done.append((*now, running.hexdigest()))
    yield _ends_batch(done)


def _ends_batch(rows):
    cols = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.string())],
                                      names=[*NODE, "ends_sha256"])


def end_digests(turns: DataFrame) -> DataFrame:
    """Per node in which conversations end: SHA-256 of their ascending ids."""
    end = F.max(F.struct(F.coalesce("pos", F.lit(0)).alias("depth"), *KEY))
    ends = turns.groupBy("conv_id").agg(end.alias("e")).select("e.*", "conv_id")
    return (ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_hash_stream, _ENDS))


# --- nodes ------------------------------------------------------------------

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """Trie of ``turns`` (conv_id, pos, turn_id, chars).  One row per node: conv_id
    (smallest member), depth, turn_id of its last turn, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = stored(keyed(turns), "trie-turns")
    flat = stored(blocks(turns), "trie-blocks")
    nodes = stored(_node_keys(rolled_up(flat, {"conv_id": "min(conv_id)", "n_convs": "count(*)"})).select(
        *NODE, *[f"parent_{k}" for k in KEY], "conv_id", "n_convs", "chars", F.substring_index("last", ":", 1).alias("turn_id")), "trie-nodes")
    above = [(F.col("depth") - 1).alias("depth"), *[F.col(f"parent_{k}").alias(k) for k in KEY]]
    children = nodes.where("depth > 0").select(*above).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    own = (nodes.join(children, NODE, "left")
           .select("conv_id", F.col("depth").alias("pos"), ((F.col("n_convs") - 1) * F.col("chars")).alias("add"),
                   F.col("n_children").isNull().cast("long").alias("leaf")))
    leaves = own.where("leaf = 1").groupBy("conv_id").agg(F.sum("leaf").alias("leaf"))
    tail = Window.partitionBy("conv_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    charged = (turns.join(own.select("conv_id", "pos", "add"), ["conv_id", "pos"], "left")
               .withColumn("w", F.sum(F.coalesce("add", F.lit(0))).over(tail)))
    sums = blocks(charged, ["w"]).join(leaves, "conv_id", "left")
    saved = f"sum(element_at(array({', '.join(f'w{i + 1}' for i in range(BLOCK))}), %s))"
    totals = _node_keys(rolled_up(sums, {"n_leaves": "sum(coalesce(leaf, 0))"} | {
        f"s{i + 1}": saved % (i + 1) for i in range(BLOCK)})).select(
        *NODE, "n_leaves", F.array(*[F.col(f"s{i + 1}") for i in range(BLOCK)])[F.greatest(F.col("place") - 1, F.lit(0))].alias("saved_tokens"))
    parents = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(totals, NODE).join(children, NODE, "left").join(end_digests(turns), NODE, "left")
            .select("conv_id", F.col("depth").alias("at"), "turn_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), *above)
            .join(parents, NODE, "left")
            .select("conv_id", F.col("at").alias("depth"), "turn_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", "ends_sha256"))


def node_digests(conversations: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations (see ``shared_openings``)."""
    return prefix_nodes(shared_openings(stored(turns_of(conversations), "trie-base"))).drop("turn_id")


_CRC = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({s}, ''), lambda ch: ascii(ch)::BIGINT)), "
        "lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")

ORACLE_SQL = f"""
WITH base AS (
  SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(turn ORDER BY pos) AS turns, {_CRC.format(s="c::VARCHAR")} % 6 AS h FROM base GROUP BY c),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns[1:a.h::BIGINT], a.turns[1:0]), a.turns[(a.h + 1)::BIGINT:]) AS turns
  FROM lists a LEFT JOIN lists b ON b.c = a.c - a.c % 100),
members AS (SELECT c, d, len(turns) AS n, turns[1:d] AS p FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM members GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN nodes.d = 0 THEN 0 ELSE (n_convs - 1) * length(nodes.p[nodes.d].t) END AS add
  FROM nodes LEFT JOIN kids ON kids.p = nodes.p AND kids.d = nodes.d),
subtrees AS (
  SELECT p[1:a] AS p, a AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(add) AS saved_tokens
  FROM full_nodes, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN subtrees s ON s.p = f.p AND s.d = f.d
LEFT JOIN nodes up ON up.p = f.p[1:f.d - 1] AND up.d = f.d - 1
"""
