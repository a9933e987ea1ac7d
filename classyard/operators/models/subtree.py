"""Completion of Gini trees below nodes whose rows fit a task.

``grow`` finishes one subtree in NumPy, all open nodes of a level at once: rows are
kept in node order (radix sorts of small integers), class counts come from
``bincount`` for random thresholds and from running sums over (node, bin) order for
exhaustive splits.  Counts are whole numbers and class weights are applied to them,
so the result does not depend on the order of rows.  Random draws are keyed by
(tree, path from the root, feature): a tree is the same wherever it is cut.

``completed`` sends every row once per tree, packed by (tree, node), and yields
one packed subtree per group.  ``Forest`` scores: trees up to ``MODEL_BYTES`` are
stitched together and broadcast, larger forests stay a table, and test rows go to
their (tree, node) as train rows did.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUBTREE_ROWS = 500_000          # rows of a node that one task finishes
SHUFFLE_ROWS = 1 << 32          # (row, tree) pairs sent in one job
MODEL_BYTES = 1 << 24           # packed forests up to this size are broadcast
PACKED = "t int, node int, rows binary"
SUBTREES = "t int, node int, tree binary, gains array<double>"


def uniform(seed: int, *parts) -> np.ndarray:
    """Hashed uniforms in [0, 1) of integer arrays, the same on every retry."""
    h = np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for p in parts:
        h = h ^ np.asarray(p).astype(np.int64).astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(float) * 2.0 ** -53


def child_paths(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the left and the right child's path."""
    with np.errstate(over="ignore"):
        h = np.asarray(path, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ np.uint64(1)).astype(np.int64), (h ^ np.uint64(2)).astype(np.int64)


def gini_score(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of squared class weights over their sum; 0 of an empty node."""
    x = counts * weight
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num((x ** 2).sum(axis=-1) / x.sum(axis=-1))


def _stable(key: np.ndarray, top: int) -> np.ndarray:
    """Stable order of non-negative integers below ``top``: radix passes of 16 bits."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    shift = 16
    while top >> shift:
        order = order[np.argsort((key[order] >> shift).astype(np.uint16), kind="stable")]
        shift += 16
    return order


class Spec:
    """What a Gini tree is grown by."""

    def __init__(self, K, weight, seed, max_features, random_threshold, least, depth):
        self.K, self.weight, self.seed, self.least, self.depth = K, np.asarray(weight, float), seed, max(1, least), depth
        self.max_features, self.random_threshold = max_features, random_threshold


def _candidates(spec: Spec, t: int, path: np.ndarray, vary: np.ndarray) -> np.ndarray:
    """(nodes, q) features that a node may split by, ascending; d stands for none."""
    m, d = vary.shape
    if spec.max_features == "sqrt":
        q = max(1, int(math.sqrt(d)))
        u = uniform(spec.seed + 2, np.full((m, d), t), np.repeat(path[:, None], d, 1), np.repeat(np.arange(d)[None], m, 0))
        pick = np.argsort(np.where(vary, u, np.inf), axis=1, kind="stable")[:, :q]
    else:
        pick = np.repeat(np.arange(d)[None], m, 0)
    return np.sort(np.where(np.take_along_axis(vary, pick, 1), pick, d), axis=1)


def grow(B: np.ndarray, y: np.ndarray, times: np.ndarray, spec: Spec, t: int, path: int, depth: int) -> tuple:
    """(feature, threshold, left child, counts) of the subtree's nodes, level by
    level, and the gain of all splits by feature; the right child follows the
    left one, a leaf has feature -1."""
    K, d = spec.K, B.shape[1]
    gains = np.zeros(d)
    feats, thrs, lefts, counts = [], [], [], []
    rows, at = np.arange(len(y)), np.zeros(len(y), np.int64)
    paths, made = np.array([path], np.int64), 1
    while len(paths):
        m = len(paths)
        order = _stable(at, m)
        rows, at = rows[order], at[order]
        total = np.bincount(at * K + y[rows], times[rows], m * K).reshape(m, K)
        n = np.bincount(at, minlength=m)
        feat, thr, left = np.full(m, -1), np.zeros(m, np.int64), np.zeros(m, np.int64)
        feats.append(feat), thrs.append(thr), lefts.append(left), counts.append(total)
        open_ = ((total > 0).sum(axis=1) > 1) & (n >= 2 * spec.least)
        if spec.depth and depth >= spec.depth:
            open_[:] = False
        if not open_.any():
            break
        # rows of open nodes only
        number = np.cumsum(open_) - 1
        keep = open_[at]
        rows, at = rows[keep], number[at[keep]]
        which, total, n, paths = np.flatnonzero(open_), total[open_], n[open_], paths[open_]
        m = len(which)
        start = np.cumsum(n) - n
        Bs, ys, ts = B[rows], y[rows], times[rows]
        low, high = np.minimum.reduceat(Bs, start, axis=0).astype(np.int64), np.maximum.reduceat(Bs, start, axis=0).astype(np.int64)
        features = _candidates(spec, t, paths, high > low)
        base = gini_score(total, spec.weight)
        best, best_f, best_b = np.full(m, 1e-12), np.full(m, -1), np.zeros(m, np.int64)
        each = np.arange(m)
        for j in range(features.shape[1]):
            f = features[:, j]
            real = f < d
            if not real.any():
                break
            f = np.minimum(f, d - 1)
            col = Bs[np.arange(len(rows)), f[at]].astype(np.int64)
            if spec.random_threshold:
                u = uniform(spec.seed + 1, np.full(m, t), paths, f)
                b = low[each, f] + np.floor(u * (high - low)[each, f]).astype(np.int64)
                go = col <= b[at]
                part = np.bincount((at * K + ys)[go], ts[go], m * K).reshape(m, K)
                size = np.bincount(at[go], minlength=m)
                gain = gini_score(part, spec.weight) + gini_score(total - part, spec.weight) - base
                gain = np.where((size >= spec.least) & (n - size >= spec.least), np.round(gain, 12), -np.inf)
            else:
                s = _stable(col, int(high.max()) + 1)
                s = s[_stable(at[s], m)]
                one = np.zeros((len(rows), K))
                one[np.arange(len(rows)), ys[s]] = ts[s]
                run = np.cumsum(one, axis=0)
                part = run - np.concatenate([np.zeros((1, K)), run])[start][at]
                size = np.arange(len(rows)) - start[at] + 1
                cs = col[s]
                ends = np.zeros(len(rows), bool)
                ends[:-1] = (at[1:] == at[:-1]) & (cs[1:] != cs[:-1])
                spot = np.flatnonzero(ends & (size >= spec.least) & (n[at] - size >= spec.least))
                part = part[spot]
                all_ = np.full(len(rows), -np.inf)
                all_[spot] = np.round(gini_score(part, spec.weight) + gini_score(total[at[spot]] - part, spec.weight) - base[at[spot]], 12)
                gain = np.maximum.reduceat(all_, start)
                first = np.minimum.reduceat(np.where(all_ == gain[at], np.arange(len(rows)), len(rows)), start)
                b = cs[first]
            better = real & (gain > best)
            best[better], best_f[better], best_b[better] = gain[better], f[better], b[better]
        split = best_f >= 0
        k = int(split.sum())
        gains += np.bincount(best_f[split], best[split], d).astype(float)
        feat[which[split]], thr[which[split]] = best_f[split], best_b[split]
        left[which[split]] = made + 2 * np.arange(k)
        made += 2 * k
        rank = np.cumsum(split) - 1
        keep = split[at]
        rows, at, Bs = rows[keep], at[keep], Bs[keep]
        right = Bs[np.arange(len(rows)), best_f[at]] > best_b[at]
        at = 2 * rank[at] + right
        paths = np.stack(child_paths(paths[split]), axis=1).ravel()
        depth += 1
    return np.concatenate(feats), np.concatenate(thrs), np.concatenate(lefts), np.concatenate(counts), gains


# --- packing ----------------------------------------------------------------

def pack_tree(feat, thr, left, counts, weight) -> bytes:
    """Twelve bytes a node; leaves hold their class, mixed ones a row of shares."""
    leaf = feat < 0
    mixed = leaf & ((counts > 0).sum(axis=1) != 1)
    value = np.where(leaf, counts.argmax(axis=1), left)
    value[mixed] = -1 - np.arange(mixed.sum())
    x = counts[mixed] * weight
    share = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300)
    return (len(feat).to_bytes(4, "little") + int(mixed.sum()).to_bytes(4, "little") + feat.astype("<i4").tobytes()
            + thr.astype("<i4").tobytes() + value.astype("<i4").tobytes() + share.astype("<f8").tobytes())


def unpack_tree(blob: bytes, K: int) -> tuple:
    """((feature, threshold, left, right), shares of all nodes, 0 of inner ones)."""
    n, mixed = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    feat, thr, value = (np.frombuffer(blob, "<i4", n, 8 + 4 * n * i).astype(np.int64) for i in range(3))
    table = np.frombuffer(blob, "<f8", mixed * K, 8 + 12 * n).reshape(mixed, K)
    leaf = feat < 0
    share = np.zeros((n, K))
    pure = leaf & (value >= 0)
    share[pure, value[pure]] = 1.0
    share[leaf & (value < 0)] = table[-1 - value[leaf & (value < 0)]]
    left = np.where(leaf, 0, value)
    return (feat, thr, left, np.where(leaf, 0, left + 1)), share


def _packed_rows(B, y, times) -> bytes:
    return len(y).to_bytes(4, "little") + y.astype("<u2").tobytes() + times.astype("<u2").tobytes() + B.tobytes()


def _unpacked_rows(blobs, d, kind):
    ys, ts, Bs = [], [], []
    for b in blobs:
        n = int.from_bytes(b[:4], "little")
        ys.append(np.frombuffer(b, "<u2", n, 4))
        ts.append(np.frombuffer(b, "<u2", n, 4 + 2 * n))
        Bs.append(np.frombuffer(b, kind, n * d, 4 + 4 * n).reshape(n, d))
    return np.concatenate(Bs), np.concatenate(ys).astype(np.int64), np.concatenate(ts).astype(float)


def _sent(at: np.ndarray, slots: np.ndarray):
    """Per pending node its rows, from the leaf of each row."""
    slot = slots[at]
    rows = np.flatnonzero(slot >= 0)
    rows = rows[np.argsort(slot[rows], kind="stable")]
    edge = np.flatnonzero(np.diff(slot[rows], prepend=-1))
    for lo, hi in zip(edge, [*edge[1:], len(rows)]):
        yield int(at[rows[lo]]), rows[lo:hi]


# --- jobs -------------------------------------------------------------------

def completed(state: DataFrame, trees: list, pending: dict[int, list[int]], spec: Spec, read, times_of, route, n_rows: int, max_bins: int) -> DataFrame:
    """(t, node, tree): the finished subtrees of all pending nodes.  ``read`` makes
    arrays of a batch, ``times_of(data, t)`` gives how often tree t drew each row."""
    kind = np.uint8 if max_bins <= 255 else np.uint16
    per_job = max(1, SHUFFLE_ROWS // max(1, n_rows))
    out, todo = None, sorted(pending)
    for lo in range(0, len(todo), per_job):
        part = todo[lo:lo + per_job]
        shipped = state.sparkSession.sparkContext.broadcast(
            {t: (trees[t].arrays(), pending[t], {v: (trees[t].path[v], trees[t].depth[v]) for v in pending[t]}) for t in part})

        def send(batches):
            slots = {}
            for t, (arrays, nodes, _) in shipped.value.items():
                slots[t] = np.full(len(arrays[0]), -1)
                slots[t][nodes] = np.arange(len(nodes))
            for b in batches:
                if not b.num_rows:
                    continue
                data = read(b)
                small = data["B"].astype(kind)
                for t, (arrays, _, _) in shipped.value.items():
                    times = times_of(data, t)
                    drawn = np.flatnonzero(times > 0)
                    at = route(data["B"][drawn], arrays)
                    found = [(node, _packed_rows(small[drawn[r]], data["y"][drawn[r]], times[drawn[r]])) for node, r in _sent(at, slots[t])]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([t] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int32()),
                                                          pa.array([f[1] for f in found], pa.binary())], ["t", "node", "rows"])

        def finish(table: pa.Table) -> pa.Table:
            t, node = table["t"][0].as_py(), table["node"][0].as_py()
            arrays, _, where = shipped.value[t]
            path, depth = where[node]
            blobs = table["rows"].to_pylist()
            d = (len(blobs[0]) - 4) // int.from_bytes(blobs[0][:4], "little") - 4
            B, y, times = _unpacked_rows(blobs, d // np.dtype(kind).itemsize, kind)
            *nodes, gains = grow(B, y, times, spec, t, path, depth)
            return pa.table({"t": table["t"][:1], "node": table["node"][:1], "tree": pa.array([pack_tree(*nodes, spec.weight)], pa.binary()),
                             "gains": pa.array([gains.tolist()], pa.list_(pa.float64()))})
        done = (state.mapInArrow(send, PACKED).groupBy("t", "node").applyInArrow(finish, SUBTREES)).checkpoint(eager=True)
        shipped.destroy()
        out = done if out is None else out.unionByName(done)
    return out


def gain_shares(trees: list, subtrees: DataFrame, d: int) -> np.ndarray:
    """Importance of each feature: its share of the gains of a tree, averaged over
    the trees that have splits (d sums per tree come back)."""
    gains = np.stack([t.gains(d) for t in trees]).astype(float)
    sums = subtrees.select("t", F.posexplode("gains").alias("j", "gain")).groupBy("t", "j").agg(F.sum("gain").alias("gain"))
    for x in sums.collect():
        gains[x["t"], x["j"]] += x["gain"]
    total = gains.sum(axis=1, keepdims=True)
    share = (gains / np.where(total > 0, total, 1))[total[:, 0] > 0]
    return share.mean(axis=0) if len(share) else np.zeros(d)


def stitched(trees: list, subtrees: list, weight: np.ndarray, K: int) -> list:
    """Whole trees (arrays, shares) on the driver."""
    found = {(x["t"], x["node"]): bytes(x["tree"]) for x in subtrees}
    out = []
    for t, tree in enumerate(trees):
        arrays, share = list(tree.arrays()), top_shares(tree, weight, K)
        for node in range(len(tree.feat)):
            if (t, node) not in found:
                continue
            (feat, thr, left, right), own = unpack_tree(found[t, node], K)
            base = len(arrays[0]) - 1                          # the subtree's root takes the node's place
            move = lambda x: np.where(x > 0, x + base, 0)
            for a, x in zip(arrays, (feat, thr, move(left), move(right))):
                a[node] = x[0]
            arrays = [np.concatenate([a, x[1:]]) for a, x in zip(arrays, (feat, thr, move(left), move(right)))]
            share[node] = own[0]
            share = np.concatenate([share, own[1:]])
        out.append((tuple(arrays), share))
    return out


def top_shares(tree, weight, K: int) -> np.ndarray:
    x = np.array([s[:K] * weight if s is not None else np.zeros(K) for s in tree.stats]).reshape(-1, K)
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300)


def scored(binned: DataFrame, d: int, K: int, trees: list, pending: dict[int, list[int]], subtrees: DataFrame, weight, route) -> DataFrame:
    """(row_id, y, prob) of a forest whose subtrees stay a table: rows that end
    above a pending node add up their shares at once, others meet the subtree."""
    T = len(trees)
    tops = [(tree.arrays(), top_shares(tree, weight, K) / T) for tree in trees]
    shipped = binned.sparkSession.sparkContext.broadcast((tops, pending))
    names = [f"p{c}" for c in range(K)]
    schema = "row_id long, y int, " + ", ".join(f"{p} double" for p in names)

    def matrix(b):
        return np.stack([b.column(2 + j).to_numpy(zero_copy_only=False) for j in range(d)], axis=1).astype(np.int64)

    def out(ids, y, prob):
        return [pa.array(ids, pa.int64()), pa.array(y, pa.int32()), *[pa.array(prob[:, c]) for c in range(K)]]

    def above(batches):
        tops, waiting = shipped.value
        for b in batches:
            B = matrix(b)
            prob = np.zeros((len(B), K))
            for t, (arrays, share) in enumerate(tops):
                own = share.copy()
                own[waiting.get(t, [])] = 0
                prob += own[route(B, arrays)]
            yield pa.RecordBatch.from_arrays(out(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), prob), ["row_id", "y", *names])

    def send(batches):
        tops, waiting = shipped.value
        for b in batches:
            B = matrix(b)
            small, ids = B.astype("<i2"), np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            for t, nodes in waiting.items():
                arrays, _ = tops[t]
                slots = np.full(len(arrays[0]), -1)
                slots[nodes] = np.arange(len(nodes))
                found = [(v, len(r).to_bytes(4, "little") + ids[r].astype("<i8").tobytes() + small[r].tobytes()) for v, r in _sent(route(B, arrays), slots)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int32()),
                                                      pa.array([f[1] for f in found], pa.binary())], ["t", "node", "rows"])

    def finish(rows: pa.Table, tree: pa.Table) -> pa.Table:
        ids, ys, probs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, K))]
        if tree.num_rows:
            arrays, share = unpack_tree(tree["tree"][0].as_py(), K)
            for x in rows["rows"].to_pylist():
                n = int.from_bytes(x[:4], "little")
                who = np.frombuffer(x, "<i8", 2 * n, 4).reshape(n, 2)
                B = np.frombuffer(x, "<i2", n * d, 4 + 16 * n).reshape(n, d)
                ids.append(who[:, 0]), ys.append(who[:, 1]), probs.append(share[route(B, arrays)] / T)
        return pa.table(out(np.concatenate(ids), np.concatenate(ys), np.concatenate(probs)), names=["row_id", "y", *names])
    met = binned.mapInArrow(send, PACKED).groupBy("t", "node").cogroup(subtrees.groupBy("t", "node")).applyInArrow(finish, schema)
    total = binned.mapInArrow(above, schema).unionByName(met).groupBy("row_id", "y").agg(*[F.sum(p).alias(p) for p in names])
    return total.select("row_id", "y", F.array(*names).alias("prob"))
