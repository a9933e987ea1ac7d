"""Near-duplicate documents by ProbMinHash.

A document is the multiset of its shingles of five words; a shingle's weight is
its count.  Every shingle sends points of a Poisson process with its weight as
rate to random places of a signature, each place keeps its earliest point, and a
shingle stops as soon as its next point is later than the latest place: two
signatures agree at a place with the probability Jaccard similarity of the
documents.  Signatures are cut into bands; documents that agree in a band are
candidates, and candidates are verified with the exact probability Jaccard
similarity of their shingles (for sets this is the ordinary Jaccard
similarity).  Classes are the connected components of the verified links.

Documents with equal multisets are one node from the start (64-bit
fingerprints).  Every other node is first compared with one centre only: of the
centres of its buckets (the members that meet most others in all their buckets) the
one that meets most.  Buckets whose members are then of different components meet
inside tasks: buckets that share members are a family, a family is cut into blocks,
and each pair of blocks goes to one task, which counts common shingles along posting
lists.  A pair is never a row there; only links that join two components leave the
task, so rows grow with the members (the counting in a task with the square of its
bounded block).  Families of more than BANDS blocks are taken bucket by bucket, which
moves less than all their blocks would.

Texts with one to four words have one shingle of all of them; null or blank
texts have none and are classes of their own.  Repeated rows are members of
their class as often as they occur; the kept row of a class is that with the
smallest doc_id (null last).  An empty table gives no rows.  Further columns are
kept apart, so their names may clash.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.llm.common import stored
from classyard.llm.components import components
from classyard.llm.textvec import Buffer, mix64
from classyard.llm.tokens import text_slices

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 6            # finds a pair of similarity 0.8 with probability 0.9998
PLACES = BANDS * ROWS
BLOCK = 1024                   # nodes, and bytes of text, that a block of a family has on average
BLOCK_BYTES = 8 << 20

_ID_BITS = 44                  # of a shingle's hash


def shingles(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), ascending, of all texts."""
    buf = Buffer(texts)
    start, end, doc = buf.words()
    n = len(start)
    word = buf.hash(start, end)
    h = word.copy()
    alive = np.ones(n, bool)
    for k in range(1, WORDS):
        same = np.zeros(n, bool)
        same[:n - k] = doc[k:] == doc[:n - k] if n > k else False
        nxt = np.zeros(n, np.uint64)
        nxt[:max(0, n - k)] = word[k:]
        # a window that leaves its text keeps the words it has; such windows
        # only count where the text has no full one
        h = np.where(same, mix64(h * np.uint64(0x9FB21C651E98DF25) + nxt), h)
        alive &= same
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if n else np.zeros(0, bool)
    full = np.zeros(len(buf.ends), bool)
    full[doc[alive]] = True
    use = alive | (first & ~full[doc])
    key = (doc[use].astype(np.uint64) << np.uint64(_ID_BITS)) | (h[use] >> np.uint64(64 - _ID_BITS))
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(_ID_BITS)).astype(np.int64), key & np.uint64((1 << _ID_BITS) - 1), count


def signatures(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """Signature matrix (n_docs, PLACES) of shingle ids; rows without shingles
    are 0.  Points of a shingle depend on its id, weight and number only."""
    best = np.full(n_docs * PLACES, np.inf)
    sig = np.zeros(n_docs * PLACES, np.uint64)
    seed = mix64(ids + np.uint64(0x5851F42D4C957F2D))
    at, rate, own, name = np.zeros(len(ids)), weight.astype(float), doc, ids
    first, points = 0, 1
    while len(own):
        # the next `points` points of every shingle that may still matter
        k = np.arange(first, first + points, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        r = mix64(seed[:, None] + k[None, :])
        gap = -np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / rate[:, None]
        time = at[:, None] + np.cumsum(gap, axis=1)
        place = (mix64(r) >> np.uint64(32)) * np.uint64(PLACES) >> np.uint64(32)
        slot = (own[:, None] * PLACES + place.astype(np.int64)).ravel()
        flat = time.ravel()
        live = flat < best[slot]
        slot, flat, who = slot[live], flat[live], np.repeat(name, points)[live]
        np.minimum.at(best, slot, flat)
        won = flat == best[slot]
        sig[slot[won]] = who[won]
        latest = best.reshape(n_docs, PLACES).max(axis=1)
        at = time[:, -1]
        go = at < latest[own]
        at, rate, own, name, seed = at[go], rate[go], own[go], name[go], seed[go]
        first += points
        points = int(max(1, min(2 * points, 1 << 9, (1 << 19) // max(1, len(own)))))
    return sig.reshape(n_docs, PLACES)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """64-bit key of each band, the band's number included."""
    h = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
    cut = sig.reshape(len(sig), BANDS, ROWS)
    for r in range(ROWS):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + cut[:, :, r])
    return h


def probability_jaccard(ids_a, count_a, ids_b, count_b) -> float:
    """Exact, of two multisets with ascending ids:
    sum over common d of 1 / sum_e max(a_e / a_d, b_e / b_d)."""
    both, i, j = np.intersect1d(ids_a, ids_b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = count_a[i].astype(float), count_b[j].astype(float)
    ratio = a / b
    order = np.argsort(ratio)
    ratio, a, b = ratio[order], a[order], b[order]
    # of other shingles only one side counts: ratio 0 or infinity
    only_a, only_b = count_a.sum() - a.sum(), count_b.sum() - b.sum()
    sum_b = np.concatenate([[0.0], np.cumsum(b)])
    sum_a = np.concatenate([np.cumsum(a[::-1])[::-1], [0.0]])
    lower = np.searchsorted(ratio, ratio, side="left")
    return float(np.sum(1 / ((sum_a[lower] + only_a) / a + (sum_b[lower] + only_b) / b)))


# --- on Spark ---------------------------------------------------------------

def numbered(docs: DataFrame) -> DataFrame:
    """Stored: doc (all columns) and a row number."""
    return stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "near-rows")


def sketched(rows: DataFrame) -> DataFrame:
    """Stored: row, doc_id, node (null without shingles), bands."""
    def run(batches):
        for b in batches:
            for lo, hi, texts in text_slices(b.column(2), 1_000_000):
                doc, ids, count = shingles(texts)
                n = hi - lo
                bands = band_keys(signatures(doc, ids, count, n)).astype(np.int64)
                term = mix64(mix64(ids) + count.astype(np.uint64))
                node = np.zeros(n, np.uint64)
                np.add.at(node, doc, term)
                empty = np.bincount(doc, minlength=n) == 0
                keys = [None if e else r for e, r in zip(empty, bands)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(mix64(node).astype(np.int64), mask=empty), pa.array(keys, pa.list_(pa.int64()))],
                    ["row", "doc_id", "node", "bands"])
    return stored(rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
                  .mapInArrow(run, "row long, doc_id long, node long, bands array<long>"), "near-sketches")


def verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar enough, stored.
    ``texts``: (node, text) of one document of each node."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                text = {}
                for node, t in ((0, 2), (1, 3)):
                    names, where = np.unique(part.column(node).to_numpy(), return_index=True)
                    text.update(zip(names.tolist(), part.column(t).take(pa.array(where)).to_pylist()))
                order = {node: k for k, node in enumerate(text)}
                doc, ids, count = shingles(list(text.values()))
                cut = np.searchsorted(doc, np.arange(len(text) + 1))
                keep = []
                for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    i, j = (slice(cut[order[z]], cut[order[z] + 1]) for z in (x, y))
                    keep.append(probability_jaccard(ids[i], count[i], ids[j], count[j]) >= similarity - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    # texts always move by a merge join: a plan that turned with the size of
    # the pairs would behave differently on small and on large corpora
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return stored(joined.mapInArrow(run, "a long, b long"), "near-links")


def block_links(doc, ids, count, label, side, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of text numbers that are similar enough and join two components, of
    ``shingles`` (doc, ids, count) with a component each.  ``side``: None for all pairs,
    else a number for each text, and only texts of different numbers are compared.

    Where the common shingles of a pair have equal counts in both, with sum C, its
    probability Jaccard similarity is C / (A + B - C); any other pair whose common
    shingles hold enough of either weight (a term 1 / sum_e max(a_e / a_d, b_e / b_d) is
    at most a_d / sum_e a_e) is computed by the definition."""
    n, label, out = len(label), np.array(label), []
    _, slot, freq = np.unique(ids, return_inverse=True, return_counts=True)
    total = np.bincount(doc, count, n)
    every = np.searchsorted(doc, np.arange(n + 1))
    shared = freq[slot] > 1
    d, s, c = doc[shared], slot[shared], count[shared]
    order = np.argsort(s, kind="stable")
    lists, list_count = d[order], c[order]
    start = np.searchsorted(s[order], np.arange(len(freq)))
    cut = np.searchsorted(d, np.arange(n + 1))
    # members of the largest component are told apart from others only
    names, many = np.unique(label, return_counts=True)
    largest = label == names[many.argmax()] if n else np.zeros(0, bool)
    for i in np.flatnonzero(~largest).tolist() if n and many.max() > 1 else range(n):
        rest = (label != label[i]) & (largest & (many.max() > 1) | (np.arange(n) > i))
        if side is not None:
            rest &= side != side[i]
        mine = slice(cut[i], cut[i + 1])
        if cut[i] == cut[i + 1] or not rest.any():
            continue
        size = freq[s[mine]]
        at = np.arange(size.sum()) + np.repeat(start[s[mine]] - (np.cumsum(size) - size), size)
        other, theirs, own = lists[at], list_count[at], np.repeat(c[mine], size)
        com_a, com_b = np.bincount(other, own, n), np.bincount(other, theirs, n)
        unequal = np.bincount(other, own != theirs, n) > 0
        enough = similarity - 1e-9
        found = rest & np.where(unequal, (com_a >= enough * total[i]) & (com_b >= enough * total),
                                com_a >= enough * (total[i] + total - com_a))
        for j in np.flatnonzero(found).tolist():
            if label[j] == label[i]:
                continue
            x, y = (slice(every[k], every[k + 1]) for k in (i, j))
            if unequal[j] and probability_jaccard(ids[x], count[x], ids[y], count[y]) < enough:
                continue
            out.append((min(i, j), max(i, j)))
            label[label == label[j]] = label[i]
    return out


def family_links(texts: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), stored, between components of nodes that share a bucket.
    ``texts``: (node, text); ``members``: (key, node, label) of buckets, stored."""
    star = members.groupBy("key").agg(F.min("node").alias("least"))
    family = components(members.join(star, "key").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    node = stored(members.select("node", F.col("label").alias("component")).distinct().join(family, "node")
                  .join(texts.select("node", F.octet_length("text").alias("bytes")), "node"), "near-rest")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    sized = stored(node.join(node.groupBy("label").agg(blocks), "label"), "near-families")
    wide = stored(members.select("key", "node").join(sized.where(F.col("blocks") > BANDS).select("node", "component", "bytes"), "node"), "near-wide")
    wide = wide.join(wide.groupBy("key").agg(blocks), "key").select(F.lit(1).alias("kind"), F.col("key").alias("g"), "node", "component", "blocks")
    dealt = sized.where(F.col("blocks") <= BANDS).select(F.lit(0).alias("kind"), F.col("label").alias("g"), "node", "component", "blocks").unionByName(wide)
    dealt = (dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("kind", "g", "node", "component", "own", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi")))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        names = table["node"].to_numpy()
        one = table["lo"][0] == table["hi"][0]
        pairs = block_links(*shingles(table["text"].to_pylist()), table["component"].to_numpy(),
                            None if one else table["own"].to_numpy(), similarity)
        return pa.table({"a": pa.array([names[i] for i, _ in pairs], pa.int64()), "b": pa.array([names[j] for _, j in pairs], pa.int64())})
    return stored(dealt.join(texts.select("node", "text").hint("merge"), "node").groupBy("kind", "g", "lo", "hi")
                  .applyInArrow(run, "a long, b long"), "near-links")


def classes(rows: DataFrame, sketch: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label) of the nodes that are linked to another one."""
    members = sketch.where("node is not null").select("node", F.explode("bands").alias("key"))
    buckets = (members.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
               .where("least < most").select("key"))
    inside = stored(members.join(stored(buckets, "near-buckets"), "key").distinct(), "near-inside")
    size = stored(inside.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "near-sizes")
    # how many nodes a node meets: an original meets more than its edited copies
    hub = inside.join(size, "key").groupBy("node").agg(F.sum(F.col("n") - 1).alias("meets"))
    first = sketch.where("node is not null").groupBy("node").agg(F.min("row").alias("row")).join(hub, "node")
    texts = stored(rows.select("row", F.col("doc.text").cast("string").alias("text"))
                   .join(stored(first, "near-first").hint("merge"), "row").select("node", "meets", "text"), "near-texts")
    inside = stored(inside.join(size, "key").join(texts.select("node", "meets"), "node"), "near-members")
    centre = inside.groupBy("key").agg(F.max(F.struct("meets", "node")).alias("c"))
    best = inside.join(centre, "key").where("node <> c.node").groupBy("node").agg(F.max("c").alias("c"))
    pairs = stored(best.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct(), "near-pairs")
    links = verified(texts, pairs, similarity)
    label = components(links)
    # buckets whose members are not all of one component
    open_ = stored(inside.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "near-open")
    split = open_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rest = stored(open_.join(split, "key"), "near-rest")
    if rest.isEmpty():
        return label
    new = family_links(texts, rest, similarity)
    return label if new.isEmpty() else components(links.unionByName(new))


def near_duplicates(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row, doc_id, class_id (smallest doc_id of the class), class_size, kept."""
    sketch = sketched(rows)
    label = classes(rows, sketch, similarity)
    # rows without shingles are classes of their own, below all node labels
    named = stored(sketch.select("row", "doc_id", "node").join(label, "node", "left").select(
        "row", "doc_id", F.when(F.col("node").isNull(), F.struct(F.lit(0).alias("k"), F.col("row").alias("v")))
        .otherwise(F.struct(F.lit(1).alias("k"), F.coalesce("label", "node").alias("v"))).alias("c")), "near-named")
    last = F.lit((1 << 63) - 1)
    size = named.groupBy("c").agg(F.count(F.lit(1)).alias("class_size"),
                                  F.min(F.struct(F.coalesce("doc_id", last).alias("a"), "row", "doc_id")).alias("best"))
    many = stored(size.where("class_size > 1"), "near-classes")
    return named.join(many, "c", "left").select(
        "row", "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("best").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept."""
    return near_duplicates(numbered(docs.select("doc_id", "text"))).select("doc_id", "class_id", "class_size", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of ``docs``."""
    rows = numbered(docs)
    gone = stored(near_duplicates(rows).where("not kept").select("row"), "near-gone")
    return rows.join(gone, "row", "left_anti").select("doc.*")
