"""N-gram Jaccard join of documents by prefix trees.

Two documents link when their sets of ``WORDS``-word shingles have a Jaccard
similarity of 0.9 or more; every document gets the smallest doc_id that links
lead to.

1. Sets.  Equal sets are one node from here on (64-bit digest of the set).
2. Screening.  A document linked with another misses at most a tenth of its
   shingles there.  If more of its shingles occur in no other set, it has no
   links.  That needs no more than a part of the shingles, chosen by their hash alike in
   all documents (``SAMPLE``); short or thinly sampled documents are judged by
   all of theirs (``channels`` tells why no pair is lost).  A task sends a shingle
   at most twice per slice of its texts, however frequent it is.
3. Groups.  Shingles that are left have a global order, rare ones first.  Linked
   nodes share one of the first floor(n / 10) + 1, in the smaller set even one of the first
   floor(n / 19) + 1, and their sizes are near, so nodes are grouped by connected components
   over those that are not alone.
4. Tries.  A group's sets, in one global order, are stored in a trie whose paths
   share tokens.  Each set walks the trie once: the overlap of a path is summed up
   once for all sets below it, and a subtree is left out when no set below shares one of
   the rarest tokens of the walker (``_Rare``), when the tokens that remain, on either side, cannot reach the overlap that the sizes ask for, or when
   all below is known to be in the walker's component.  Overlaps are exact.
5. Groups beyond ``GROUP_SHINGLES`` are never held by one task.  First they are
   dealt into blocks by hash, each with some centres of the whole group: families
   of near copies become one component in one linear pass.  What shares a shingle
   across components after that is grouped again, and what is still too large is
   joined block by block, all pairs of blocks.

Null or blank texts have no shingles and no links (n_shingles 0, their own
component); texts with fewer words than ``WORDS`` have one shingle; texts of any
length are read whole; repeated rows and equal sets share a component; the
smallest doc_id of rows without any is null; an empty table gives no rows.  Only
doc_id and text are read.
"""
from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.llm.common import stored
from classyard.llm.components import components
from classyard.llm.textvec import Buffer, mix64
from classyard.llm.tokens import text_slices

WORDS = 3
SAMPLE = 0.3                    # share of the shingles that long documents are screened by
FULL_BELOW = 112                # smaller sets are screened by all shingles as well
SAMPLED_FROM = 90               # sets from this size on are screened by the sample
LEAN = 0.22                     # so are sets with no larger share of sampled shingles
SLICE = 4_000_000               # bytes of text that send a shingle at most twice
GROUP_SHINGLES = 2_000_000      # of a group that one task joins
GROUP_NODES = 20_000
BAND = 1.12                     # sizes of a link differ by 10 / 9 at most: two bands next to each other
CENTRES = 32


# --- sets -------------------------------------------------------------------

def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle), ascending and distinct, of all texts."""
    buf = Buffer(texts, lower=True)
    start, end, doc = buf.words()
    n = len(start)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = buf.hash(start, end)
    h, alive = word.copy(), np.ones(n, bool)
    for k in range(1, WORDS):
        same = np.zeros(n, bool)
        same[:n - k] = doc[k:] == doc[:n - k]
        follow = np.zeros(n, np.uint64)
        follow[:n - k] = word[k:]
        h = np.where(same, mix64(h * np.uint64(0x9FB21C651E98DF25) + follow), h)
        alive &= same
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    has = np.zeros(len(buf.ends), bool)
    has[doc[alive]] = True
    use = alive | (first & ~has[doc])
    doc, h = doc[use], h[use]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new].astype(np.int64), h[new]


def channels(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, channel) of the shingles that stand for a text.

    Channel 0 holds sampled shingles of sets of ``SAMPLED_FROM`` or more, if they are
    more than a tenth of the set; channel 1 all shingles of sets below
    ``FULL_BELOW`` and of lean ones.  Both ends of a link meet in one of them: their
    sizes differ by a tenth at most, and if one has a tenth or less of its shingles in
    the sample, the other has at most 0.1 + 0.1 / 0.9 of its own there."""
    picked = (h >> np.uint64(32)) < np.uint64(int(SAMPLE * 2 ** 32))
    part = np.bincount(doc[picked], minlength=len(size))
    sampled = (size >= SAMPLED_FROM) & (10 * part > size)
    full = (size < FULL_BELOW) | (part <= LEAN * size)
    a, b = picked & sampled[doc], full[doc]
    return (np.concatenate([doc[a], doc[b]]), np.concatenate([h[a], mix64(h[b] + np.uint64(0x2545F4914F6CDD1D))]),
            np.concatenate([np.zeros(a.sum(), np.int8), np.ones(b.sum(), np.int8)]))


def set_digests(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, digest) of each text's set."""
    size = np.bincount(doc, minlength=n_docs)
    total = np.zeros(n_docs, np.uint64)
    if len(h):
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        total[doc[at]] = np.add.reduceat(mix64(h + np.uint64(0x9E3779B97F4A7C15)), at)
    return size, mix64(total + size.astype(np.uint64)).view(np.int64)


_SETS = ("doc_id long, text_key long, n long, node long, sent0 boolean, sent1 boolean, size0 int, size1 int, known0 int, known1 int, "
         "keys0 array<long>, keys1 array<long>")


def _ragged(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """List column from values with ascending owners."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _screen_slices(batches):
    """Sets of all texts.  In a slice, the first text of a node sends its keys; a
    key of several nodes is known to be shared, and two of them send it."""
    for batch in batches:
        ids = pa.array(batch.column(0)).cast(pa.int64())
        for lo, hi, texts in text_slices(batch.column(2), SLICE):
            n = hi - lo
            doc, h = shingle_sets(texts)
            size, node = set_digests(doc, h, n)
            _, first = np.unique(node, return_index=True)
            sends = np.zeros(n, bool)
            sends[first] = True
            sends &= size > 0
            doc, key, channel = channels(doc, h, size)
            cols = []
            for c in (0, 1):
                d, k = doc[channel == c], key[channel == c]
                there = np.bincount(d, minlength=n)
                d, k = d[sends[d]], k[sends[d]]
                order = np.argsort(k, kind="stable")
                sk = k[order]
                new = np.concatenate([[True], sk[1:] != sk[:-1]]) if len(sk) else np.zeros(0, bool)
                group = np.cumsum(new) - 1
                many = np.bincount(group)[group] > 1 if len(sk) else np.zeros(0, bool)
                place = np.arange(len(sk)) - np.flatnonzero(new)[group] if len(sk) else np.zeros(0, np.int64)
                known = np.bincount(d[order][many], minlength=n)
                go = place < 2
                # a key that is known to be shared counts here, not by what comes back
                out_d, out_k = d[order][go], np.where(many[go], sk[go] | np.uint64(1), sk[go] & ~np.uint64(1))
                back = np.argsort(out_d, kind="stable")
                cols.append((sends & (there > 0), there, known, _ragged(out_k[back], out_d[back], n)))
            yield pa.RecordBatch.from_arrays(
                [ids[lo:hi], batch.column(1)[lo:hi], pa.array(size.astype(np.int64)), pa.array(node),
                 *[pa.array(c[0]) for c in cols], *[pa.array(c[1].astype(np.int32)) for c in cols],
                 *[pa.array(c[2].astype(np.int32)) for c in cols], *[c[3] for c in cols]],
                names=[x.split()[0] for x in _SETS.split(", ")])


def document_sets(docs: DataFrame) -> DataFrame:
    """One row per document: size and digest of its set and the keys that it sends
    (lowest bit: another node of the slice has the key as well)."""
    return _plain(docs).mapInArrow(_screen_slices, _SETS)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def screened(sets: DataFrame) -> DataFrame:
    """(node, n, doc_id) of nodes that may have links; doc_id is the smallest."""
    sent = [sets.where(f"sent{c}").select("node", F.lit(c).alias("channel"), F.explode(f"keys{c}").alias("k")) for c in (0, 1)]
    rows = sent[0].unionByName(sent[1]).select("node", "channel", F.shiftrightunsigned("k", 1).alias("key"),
                                               F.col("k").bitwiseAND(1).alias("known"))
    other = F.expr("min(node) OVER (PARTITION BY channel, key) <> max(node) OVER (PARTITION BY channel, key)")
    back = (rows.withColumn("shared", other).where("known = 0 AND shared")
            .groupBy("node", "channel").agg(F.count(F.lit(1)).alias("found")))
    own = [sets.where(f"sent{c}").select("node", F.lit(c).alias("channel"), "n", F.col(f"size{c}").alias("size"), F.col(f"known{c}").alias("known"))
           for c in (0, 1)]
    # rows of one node in several slices all come to the same sum
    own = own[0].unionByName(own[1]).groupBy("node", "channel").agg(
        F.count(F.lit(1)).alias("slices"), F.max("n").alias("n"), F.max("size").alias("size"), F.sum("known").alias("known"))
    missing = F.col("size") - (F.col("known") + F.coalesce("found", F.lit(0))) / F.col("slices")
    live = (own.join(back, ["node", "channel"], "left").where(missing <= F.floor(F.col("n") / 10))
            .groupBy("node").agg(F.max("n").alias("n")))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    first = sets.where("n > 0").groupBy("node").agg(row.alias("row"))
    return live.join(first, "node").select("node", "n", "row.doc_id", "row.text_key")


# --- groups -----------------------------------------------------------------

_LIVE = "node long, n long, doc_id long, size0 int, size1 int, keys0 array<long>, keys1 array<long>, shingles array<long>"


def _live_slices(batches):
    for batch in batches:
        for lo, hi, texts in text_slices(batch.column(2), SLICE):
            n = hi - lo
            doc, h = shingle_sets(texts)
            size, node = set_digests(doc, h, n)
            d, key, channel = channels(doc, h, size)
            cols = []
            for c in (0, 1):
                dc, kc = d[channel == c], key[channel == c]
                back = np.argsort(dc, kind="stable")
                cols.append((np.bincount(dc, minlength=n).astype(np.int32), _ragged(kc[back], dc[back], n)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(size.astype(np.int64)), batch.column(0)[lo:hi], pa.array(cols[0][0]), pa.array(cols[1][0]),
                 cols[0][1], cols[1][1], _ragged(h, doc, n)], names=[x.split()[0] for x in _LIVE.split(", ")])


def live_sets(docs: DataFrame, live: DataFrame) -> DataFrame:
    """Whole sets of the nodes in ``live``, one row a node."""
    none = F.coalesce("doc_id", F.lit(-2 ** 63)).alias("at")
    rows = _plain(docs).select(none, "*").join(live.select(none, "text_key"), ["at", "text_key"], "left_semi")
    return rows.dropDuplicates(["at", "text_key"]).select("doc_id", "text_key", "text").mapInArrow(_live_slices, _LIVE)


def prefixes(sets: DataFrame) -> DataFrame:
    """(node, channel, key, band, indexed): of each node's keys in the global order, rare
    ones first, those among the first floor(n / 10) + 1 that another node has; ``indexed``
    ones are among the first floor(n / 19) + 1."""
    rows = sets.select("node", F.lit(0).alias("channel"), F.explode("keys0").alias("key")).unionByName(
        sets.select("node", F.lit(1).alias("channel"), F.explode("keys1").alias("key")))
    common = rows.groupBy("channel", "key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = (rows.join(common, ["channel", "key"]).groupBy("node", "channel")
             .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"))
             .join(sets.select("node", "n", "size0", "size1"), "node"))
    alone = F.when(F.col("channel") == 0, F.col("size0")).otherwise(F.col("size1")) - F.size("keys")
    take = (F.floor(F.col("n") / 10) + 1 - alone).cast("int")
    lists = lists.withColumn("alone", alone).withColumn("take", take).where("take > 0")
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int").alias("band")
    return (lists.select("node", "channel", "n", "alone", band, F.posexplode(F.slice("keys", F.lit(1), F.col("take"))).alias("at", "e"))
            .select("node", "channel", "e.key", "band", (F.col("at") + F.col("alone") <= F.floor(F.col("n") / 19)).alias("indexed")))


def grouped(prefix: DataFrame) -> DataFrame:
    """(node, label): connected components of nodes over shared keys.

    Of the keys of a linked pair the first one in the global order is an indexed one of the
    smaller set, which misses no more than a nineteenth of its shingles in the larger one.
    The larger set is of the same band of sizes or of the next one.  So all nodes of two
    bands that have a key are one with a node that has it indexed in the lower band."""
    hubs = prefix.where("indexed").groupBy("channel", "key", "band").agg(F.min("node").alias("hub"))
    near = hubs.select("channel", "key", "hub", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    edges = (prefix.select("node", "channel", "key", "band").join(near, ["channel", "key", "band"]).where("node <> hub")
             .select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    return components(edges)


# --- tries ------------------------------------------------------------------

class Trie:
    """Path-compressed trie of sorted token sets; a node's sets lie in one range of
    the sorted order.  Sets with equal tokens end at one node."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.rows = rows = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=rows.__getitem__)
        self.order, self.sets = order, [sets[k] for k in order]
        self.sizes = [sizes[k] for k in order]
        self.lo, self.hi, self.start, self.end, self.kids, self.ends = [0], [0], [0], [0], [[]], [[]]
        path = [0]                                           # nodes of the current set's path
        for k, tokens in enumerate(self.sets):
            shared = self._shared(k) if k else 0
            while self.end[path[-1]] > shared:
                top = path.pop()
                if self.end[path[-1]] < shared:               # the set leaves amid an edge: cut it
                    mid = self._node(self.lo[top], self.start[top], shared)
                    self.kids[path[-1]][-1] = mid
                    self.kids[mid].append(top)
                    self.start[top] = shared
                    path.append(mid)
            if len(tokens) > shared:
                new = self._node(k, shared, len(tokens))
                self.kids[path[-1]].append(new)
                path.append(new)
            self.ends[path[-1]].append(k)
        # ranges, and least and largest size and largest number of tokens below each node
        n = len(self.lo)
        self.least, self.most, self.longest = [0] * n, [0] * n, [0] * n
        for v in reversed(self._preorder()):
            below = [(self.sizes[k], self.sizes[k], len(self.sets[k]), k + 1) for k in self.ends[v]]
            below += [(self.least[c], self.most[c], self.longest[c], self.hi[c]) for c in self.kids[v]]
            self.least[v], self.most[v] = min(b[0] for b in below), max(b[1] for b in below)
            self.longest[v], self.hi[v] = max(b[2] for b in below), max(b[3] for b in below)
        edges = [self.sets[self.lo[v]][self.start[v]:self.end[v]] for v in range(n)]
        self.tokens = np.concatenate(edges)
        self.bounds = np.concatenate([[0], np.cumsum([len(e) for e in edges])])
        self.last = np.array([e[-1] if len(e) else -1 for e in edges], np.int64)

    def _shared(self, k: int) -> int:
        a, b = self.sets[k - 1], self.sets[k]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    def _node(self, lo: int, start: int, end: int) -> int:
        for column, value in ((self.lo, lo), (self.hi, 0), (self.start, start), (self.end, end), (self.kids, []), (self.ends, [])):
            column.append(value)
        return len(self.lo) - 1

    def _preorder(self) -> list[int]:
        out, stack = [], [0]
        while stack:
            v = stack.pop()
            out.append(v)
            stack.extend(self.kids[v])
        return out


class _Rare:
    """Which sets share one of each other's floor(n / 10) + 1 rarest tokens; linked sets do.
    Sets are numbered in the trie's order."""

    def __init__(self, rare: list[np.ndarray], width: int):
        self.rare = rare
        owner = np.repeat(np.arange(len(rare)), [len(r) for r in rare])
        token = np.concatenate(rare)
        order = np.argsort(token, kind="stable")                # ascending numbers under each token
        self.owner = owner[order]
        self.start = np.searchsorted(token[order], np.arange(width + 1))

    def after(self, q: int, most: int) -> np.ndarray | None:
        """Numbers beyond ``q`` that share one with it, ascending; None if that means to look at more than ``most``."""
        lo, hi = self.start[self.rare[q]], self.start[self.rare[q] + 1]
        if (hi - lo).sum() > most:
            return None
        found = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo.tolist(), hi.tolist())] or [self.owner[:0]]))
        return found[found > q]


def join_sets(sets: list[np.ndarray], sizes: list[int], parts: list[int] | None = None) -> np.ndarray:
    """Component number of each set (of all shingles) under Jaccard >= 0.9;
    ``parts``: numbers of components that are known already."""
    n = len(sets)
    tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -df))] = np.arange(len(tokens))    # frequent ones first: long common paths
    width = int((df > 1).sum())                                 # tokens of one set cannot overlap
    ranks = rank[inverse]
    cut = np.cumsum([0] + [len(s) for s in sets])
    short, rare = [], []
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        r = np.sort(ranks[a:b])
        shared = np.searchsorted(r, width)
        short.append(r[:shared])
        rare.append(r[max(0, len(r) - sizes[k] // 10 - 1):shared])
    trie = Trie(short, sizes)
    near = _Rare([rare[k] for k in trie.order], width)
    label = np.arange(n) if parts is None else np.unique(np.asarray(parts)[trie.order], return_inverse=True)[1]
    uniform = [False] * len(trie.lo)
    present = np.zeros(width + 1, np.uint8)
    run = np.zeros(len(trie.tokens) + 1, np.int32)
    bounds = trie.bounds.tolist()
    for q in range(n):
        mine, size = trie.sets[q], trie.sizes[q]
        if uniform[0] and label[0] == label[q]:
            continue
        met = near.after(q, len(trie.tokens) // 4)              # None: too many to name them
        if met is not None:
            met = met[label[met] != label[q]].tolist()
            if not met:
                continue
        present[mine] = 1
        # of the walker's tokens, those up to the last of each edge
        upto = np.concatenate([np.cumsum(present, dtype=np.int32), [0]])[trie.last].tolist() if met is None else None
        if met is None:
            np.cumsum(present[trie.tokens], out=run[1:])
            hits = np.diff(run[trie.bounds]).tolist()           # of each edge
        total = len(mine)
        stack = [(0, 0)]
        while stack:
            v, overlap = stack.pop()
            if trie.hi[v] <= q + 1:
                continue                                        # these have walked already
            lo, hi = trie.lo[v], trie.hi[v]
            if met is not None:
                first = bisect_left(met, lo)
                if first == len(met) or met[first] >= hi:
                    continue                                    # none below shares a rare token
            if not uniform[v]:
                uniform[v] = bool((label[lo:hi] == label[lo]).all())
            if uniform[v] and label[lo] == label[q]:
                continue
            if met is None:
                overlap += hits[v]
                passed = upto[v]
            else:
                overlap += int(np.count_nonzero(present[trie.tokens[bounds[v]:bounds[v + 1]]]))
                passed = int(np.searchsorted(mine, trie.last[v], side="right"))
            depth = trie.end[v]
            # what remains on either side, against the overlap that the sizes ask for
            if 19 * (overlap + min(total - passed, trie.longest[v] - depth)) < 9 * (size + trie.least[v]):
                continue
            if 10 * size < 9 * trie.least[v] + 19 * (passed - overlap) or 10 * trie.most[v] < 9 * size + 19 * (depth - overlap):
                continue
            for k in trie.ends[v]:
                if k > q and label[k] != label[q] and 19 * overlap >= 9 * (size + trie.sizes[k]):
                    label[label == label[k]] = label[q]
            stack.extend([(c, overlap) for c in trie.kids[v]])
        present[mine] = 0
    out = np.empty(n, np.int64)
    out[trie.order] = label
    return out


_LINKS = "node long, root long, doc_id long"


def _join_cell(table: pa.Table) -> pa.Table:
    """Groups of one cell: per node the root of its component there and the
    component's smallest doc_id."""
    table = table.sort_by([("sub", "ascending"), ("node", "ascending")]).combine_chunks()
    sub, node, doc, size, part = (table.column(c).to_pylist() for c in ("sub", "node", "doc_id", "n", "part"))
    lists = table.column("shingles").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    rows = []
    for _, group in groupby(range(len(sub)), key=sub.__getitem__):
        g = list(group)
        label = join_sets([flat[at[k]:at[k + 1]] for k in g], [size[k] for k in g], [part[k] for k in g])
        best = {}
        for k, c in zip(g, label.tolist()):
            key = (doc[k] is None, doc[k] or 0, k)
            best[c] = min(best.get(c, key), key)
        rows += [(node[k], node[best[c][2]], doc[best[c][2]]) for k, c in zip(g, label.tolist())]
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["node", "root", "doc_id"])


def _joined(sets: DataFrame, cells: DataFrame) -> DataFrame:
    """Links of all cells (node, part, cell, sub)."""
    return (sets.select("node", "n", "doc_id", "shingles").join(cells, "node").groupBy("cell").applyInArrow(_join_cell, _LINKS))


def _sized(groups: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Groups (node, label, part) in small ones with their cell, and large ones
    with weight and members; and the shingles of the small ones."""
    weight = (groups.join(sets.select("node", "n"), "node").groupBy("label")
              .agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("members")))
    weight = stored(weight, "trie-weights")
    fits = (F.col("weight") <= GROUP_SHINGLES) & (F.col("members") <= GROUP_NODES)
    total = weight.where(fits).agg(F.sum("weight")).first()[0] or 0
    cells = max(1, -(-total // GROUP_SHINGLES))
    small = (groups.join(weight.where(fits).select("label"), "label")
             .select("node", "part", F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(cells)).cast("string")).alias("cell"),
                     F.col("label").cast("string").alias("sub")))
    return small, groups.join(weight.where(~fits), "label"), total


def _blocks(weight, members):
    return F.greatest(F.ceil(2 * weight / GROUP_SHINGLES), F.ceil(2 * members / GROUP_NODES)).cast("int")


def _large(large: DataFrame, sets: DataFrame, prefix: DataFrame) -> DataFrame:
    """Links (node, root) within groups that no task holds."""
    large = stored(large.withColumn("blocks", _blocks(F.col("weight"), F.col("members"))), "trie-large")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    centre = F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("members") / CENTRES)) == 0
    where = F.when(centre, F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).otherwise(F.array(block))
    cells = large.select("node", "part", "label", F.explode(where).alias("block")).withColumn("cell", F.concat_ws("-", "label", "block"))
    first = stored(_joined(sets, cells.select("node", "part", "cell", F.col("cell").alias("sub"))), "trie-blocks")
    parts = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # keys that still stand in several components
    keys = prefix.join(large.select("node"), "node").join(parts.select("node", F.col("label").alias("known")), "node", "left").select(
        "node", "channel", "key", "band", "indexed", F.coalesce("known", "node").alias("part"))
    keys = stored(keys, "trie-open")
    still = keys.groupBy("channel", "key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most")
    keys = keys.join(still.select("channel", "key"), ["channel", "key"])
    again = grouped(keys).join(keys.select("node", "part").distinct(), "node")
    small, grid, _ = _sized(stored(again.select("node", "label", "part"), "trie-again"), sets)
    grid = grid.withColumn("blocks", _blocks(F.col("weight"), F.col("members"))).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))
    grid = grid.select("node", "part", "label", "block", other.alias("other")).withColumn(
        "cell", F.concat_ws("-", "label", F.least("block", "other"), F.greatest("block", "other")))
    second = _joined(sets, small.unionByName(grid.select("node", "part", "cell", F.col("cell").alias("sub"))))
    return first.select("node", "root").unionByName(second.select("node", "root"))


# --- results ----------------------------------------------------------------

def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all documents."""
    sets = stored(document_sets(docs), "trie-sets")
    live = stored(live_sets(docs, screened(sets)), "trie-live")
    prefix = stored(prefixes(live), "trie-prefix")
    groups = stored(grouped(prefix).withColumn("part", F.col("node")), "trie-groups")
    small, large, _ = _sized(groups, live)
    found = stored(_joined(live, small), "trie-links").select("node", F.col("doc_id").alias("linked"))
    if not large.isEmpty():
        links = stored(_large(large, live, prefix), "trie-large-links")
        whole = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(live.select("node", "doc_id"), "node")
        least = whole.groupBy("label").agg(F.min("doc_id").alias("linked"))
        found = found.unionByName(whole.join(least, "label").select("node", "linked"))
    own = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    names = stored(own.join(found, "node", "left").select("node", F.coalesce("linked", "least").alias("component_id")), "trie-names")
    return sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")).join(
        names, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(
            F.col("doc_id")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
           range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s
  FROM words),
nodes AS (SELECT min(doc_id) AS id, md5(array_to_string(s, chr(10))) AS node, len(any_value(s)) AS n, any_value(s) AS s
          FROM sets WHERE len(s) > 0 GROUP BY md5(array_to_string(s, chr(10)))),
tokens AS (SELECT node, n, unnest(s) AS t FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.node <> b.node AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT node, id AS label FROM nodes
  UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node JOIN nodes o ON o.node = l.b WHERE r.label < o.id),
least AS (SELECT node, min(label) AS label FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE l.label END AS component_id
FROM sets s LEFT JOIN least l ON l.node = md5(array_to_string(s.s, chr(10)))
"""
