"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to).  A small flow network routes word capacity from the patterns to the
quotas of the sources: each pattern has one arc per repetition, each as wide as
the pattern's words, at convex cost 0, 1, 2, so a second pass over a document is
bought only where first passes are used up.  The driver holds one number per
pattern and source, never rows.  Documents are then selected in a seeded order
within their pattern: whole documents, pass after pass, until the pattern's flow
is met (to half a document).

Cumulative sizes come from sums per (pattern, hash bucket), so no source is ever
sorted in one task.  Null sources are a source of their own, last; null or empty
texts have size 0 and are never taken; repeated rows count as often as they
occur; a negative or absent weight is not possible.  Empty tables give no rows.
"""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classyard.llm.common import WORD_CLASS, stored

REPEATS = 3          # passes over a document, and the bound of a target
BUCKETS = 2048       # hash buckets of the seeded order, per pattern
SEED = 42


def targets(sizes: list[int], weights: list[float], total: int, most: int = REPEATS) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what
    is cut off is shared again by weight among the rest."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def min_cost_flow(capacity: dict, members: dict, quota: dict, repeats: int = REPEATS) -> dict:
    """(pattern, source) -> words.  Successive shortest paths with potentials;
    maximum flow first, least repetition among maximum flows."""
    index, arcs, graph = {}, [], []

    def node(x):
        if x not in index:
            index[x] = len(graph)
            graph.append([])
        return index[x]

    def arc(a, b, cap, cost):
        graph[a].append(len(arcs))
        arcs.append([b, cap, cost])
        graph[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    s, t = node("from"), node("to")
    routes = {}
    for p in capacity:
        for r in range(repeats):
            arc(s, node(("pattern", p)), capacity[p], r)
        for m in members[p]:
            routes[p, m] = len(arcs)
            arc(node(("pattern", p)), node(("source", m)), repeats * capacity[p], 0)
    for m in quota:
        arc(node(("source", m)), t, quota[m], 0)
    potential = [0] * len(graph)
    while True:
        dist, via = [None] * len(graph), [-1] * len(graph)
        dist[s], heap = 0, [(0, s)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k in graph[a]:
                b, cap, cost = arcs[k]
                e = d + cost + potential[a] - potential[b]
                if cap > 0 and (dist[b] is None or e < dist[b]):
                    dist[b], via[b] = e, k
                    heapq.heappush(heap, (e, b))
        if dist[t] is None:
            break
        far = max(x for x in dist if x is not None)
        potential = [p + (far if d is None else d) for p, d in zip(potential, dist)]
        path, b = [], t
        while b != s:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    return {pm: arcs[k ^ 1][1] for pm, k in routes.items()}


def select(docs: DataFrame, pattern: str, size: str, order_hash: str, flow: dict, seed_cols: list[str]) -> DataFrame:
    """Add ``taken``: words taken of each document of a pattern, by ``flow``
    (pattern key -> words; a null pattern has the key None)."""
    spark = docs.sparkSession
    src = docs.withColumn("_b", F.shiftright(order_hash, 60 - (BUCKETS.bit_length() - 1)))
    sums = src.groupBy(pattern, "_b").agg(F.sum(size).alias("_n"))
    w = Window.partitionBy(pattern).orderBy("_b")
    before = (sums.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
              .withColumn("_cap", F.sum("_n").over(Window.partitionBy(pattern)))
              .select(F.col(pattern).alias("_p"), F.col("_b").alias("_b2"), "_before", "_cap"))
    flows = spark.createDataFrame([(p, int(f)) for p, f in flow.items()], "_q string, _flow long")
    before = stored(before.join(F.broadcast(flows), F.col("_p").eqNullSafe(F.col("_q")), "left").drop("_q"), "mix-before")
    j = src.join(before, F.col(pattern).eqNullSafe(F.col("_p")) & (F.col("_b") == F.col("_b2")))
    inner = Window.partitionBy("_p", "_b").orderBy(order_hash, *seed_cols).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_at", F.col("_before") + F.sum(size).over(inner) - F.col(size))
    passes = sum(((2 * (F.col("_at") + r * F.col("_cap")) + F.col(size) <= 2 * F.coalesce("_flow", F.lit(0)))
                  & (F.col(size) > 0)).cast("long") for r in range(REPEATS))
    return j.withColumn("taken", passes * F.col(size)).drop("_p", "_b2", "_b", "_before", "_cap", "_flow", "_at")


def order_key(doc_id, text, seed: int):
    """Seeded 60-bit order of documents: leading digits of an md5 (which any
    engine can compute).  The text is part of it, so rows of one (or no) doc_id
    spread as well."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def _rows(docs: DataFrame, seed: int, carry: bool) -> DataFrame:
    doc = [F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if carry else []
    return stored(docs.select(
        *doc, F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"),
        order_key(docs["doc_id"], docs["text"], seed).alias("h")), "mix-rows")


def mix(rows: DataFrame) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken of the rows of
    ``_rows``: each document belongs to the one source of its column."""
    rows = rows.select("row", "doc_id", "source", "size", "h")
    sums = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted(s for s in sums if s is not None) + [None] * (None in sums)
    weights = [1 + k % 3 for k in range(len(names))]
    goal = dict(zip(names, targets([sums[s] for s in names], weights, sum(sums.values()))))
    flow = min_cost_flow(sums, {s: [s] for s in names}, {s: int(goal[s] + 0.5) for s in names})
    taken = select(rows, "source", "size", "h", {p: f for (p, _), f in flow.items()}, ["doc_id", "row"])
    table = rows.sparkSession.createDataFrame([(s, sums[s], goal[s]) for s in names],
                                              "_s string, source_size long, target double")
    return (taken.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_s")))
            .select("row", "doc_id", "source", "size", "source_size", "target", "taken"))


def mix_digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return mix(_rows(docs, seed, False)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


# With one source per document the flow of a source is its target, and the
# reshared targets are one level per weight, found from the sorted capacities.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(concat_ws('|', '42', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * cap / w, source) AS k FROM s
), lam AS (
  SELECT *, (sum(cap) OVER () - coalesce(sum(3 * cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), l AS (
  SELECT coalesce((SELECT level FROM lam WHERE level * w <= 3 * cap ORDER BY k LIMIT 1), 0) AS level
), t AS (
  SELECT source, cap, least(lam.w * l.level, 3.0 * cap) AS target FROM lam, l
), o AS (
  SELECT d.doc_id, d.size, t.cap, t.target, least(floor(t.target + 0.5)::BIGINT, 3 * t.cap) AS flow,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, cap AS source_size, round(target, 6) AS target,
  CASE WHEN size = 0 THEN 0 ELSE size * ((2 * pos + size <= 2 * flow)::INT + (2 * (pos + cap) + size <= 2 * flow)::INT
    + (2 * (pos + 2 * cap) + size <= 2 * flow)::INT) END::BIGINT AS taken
FROM o
"""


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    rows = _rows(docs, seed, True)
    times = stored(mix(rows).where("taken > 0").select("row", (F.col("taken") / F.col("size")).cast("int").alias("times")), "mix-times")
    # a merge join at every size: the plan does not turn with the number of documents
    return (rows.select("row", "doc").join(times.hint("merge"), "row")
            .select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("doc.*"))
