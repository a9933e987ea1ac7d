"""Histogram trees: boosted (M21-M27 and variants) and Gini forests.

Features are quantile-binned once (edges from ``approxQuantile`` on train rows,
the built-in multi-column ``Bucketizer``); the persisted state holds ``(row_id,
label, w, b_0 ..., m_0 ...)`` with a row weight, the bins and the margins.

A step evaluates all open nodes of all trees in one job.  Each task folds its
rows into one dense array per open node -- sums per (feature, bin) of a few
channels -- and sends its filled cells once; arrays of a node are added up (in two
rounds where there are many tasks) and the best split is chosen there, so only
splits reach the driver.  Where the arrays of a job have a proven bound of
``DIRECT_BYTES``, the driver adds them up itself, which saves a shuffle.  Open nodes beyond ``MAX_CELLS`` of a task's memory go to further
jobs.  Trees travel as a broadcast variable that is destroyed after its job.

Channels: boosting has the gradient, the split and the leaf Hessian of the
tree's class; Gini trees have the weight of every class.

Growth: ``depthwise`` (every node with positive gain), ``leaves`` (best first
under a leaf budget; open leaves are evaluated ahead in batches and splits that
best-first order would not have made are taken back), ``oblivious`` (one split
per level for all nodes of a tree).
"""
from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.operators.models import subtree
from classyard.operators.models.base import Ctx, Estimator, Fitted
from classyard.operators.models.subtree import child_paths, gini_score
from classyard.operators.models.subtree import uniform as _uniform
from classyard.operators.prep import balanced_weights

MAX_CELLS = 1 << 22        # histogram cells (doubles) a task holds
DIRECT_BYTES = 1 << 26     # partial histograms of a job up to this bound are added up on the driver
TASK_ROWS = 2_000          # least rows of a task on average
WAVE_ROWS = 200_000        # rows that a task may have before there are more tasks than cores
ONE_ROUND_TASKS = 256      # more partial arrays of a node are added up in two rounds
PART = "t int, node int, salt int, hist binary"
SPLIT = "t int, node int, gain double, f int, bin int, left binary, right binary, total binary"


def bin_edges(train: DataFrame, feats: list[str], max_bins: int) -> list[list[float]]:
    probs = [i / max_bins for i in range(1, max_bins)]
    qs = train.approxQuantile(feats, probs, 1e-3)
    return [[-float("inf")] + sorted(set(q)) + [float("inf")] for q in qs]


SHUFFLED_ROWS = 256             # rows whose class shares with replaced values are held at once


def binned(df: DataFrame, feats: list[str], edges, *carry: str) -> DataFrame:
    outs = [f"b_{i}" for i in range(len(feats))]
    b = Bucketizer(splitsArray=edges, inputCols=feats, outputCols=outs, handleInvalid="keep")
    return b.transform(df).select("row_id", "label", *carry, *[F.col(o).cast("int").alias(o) for o in outs])


class Tree:
    """Nodes in order of creation; a leaf has feature -1."""

    def __init__(self):
        self.feat, self.thr, self.left, self.right = [-1], [0], [0], [0]
        self.depth, self.stats, self.path, self.gain = [0], [None], [1], [0.0]

    def split(self, node: int, gain: float, f: int, thr: int, left, right) -> tuple[int, int]:
        n = len(self.feat)
        self.gain[node] = gain
        self.feat[node], self.thr[node], self.left[node], self.right[node] = f, thr, n, n + 1
        for stats, path in zip((left, right), child_paths(self.path[node])):
            self.path.append(int(path))
            self.gain.append(0.0)
            self.feat.append(-1)
            self.thr.append(0)
            self.left.append(0)
            self.right.append(0)
            self.depth.append(self.depth[node] + 1)
            self.stats.append(stats)
        return n, n + 1

    def gains(self, d: int) -> np.ndarray:
        """Gain of all splits by feature."""
        feat = np.array(self.feat)
        return np.bincount(feat[feat >= 0], np.array(self.gain)[feat >= 0], d)

    def arrays(self):
        return tuple(np.array(x, np.int64) for x in (self.feat, self.thr, self.left, self.right))


def route(B: np.ndarray, arrays) -> np.ndarray:
    """Leaf of every row."""
    feat, thr, left, right = arrays
    node = np.zeros(len(B), np.int64)
    live = np.arange(len(B)) if feat[0] >= 0 else np.empty(0, np.int64)
    while len(live):
        at = node[live]
        go = B[live, feat[at]] > thr[at]
        node[live] = at = np.where(go, right[at], left[at])
        live = live[feat[at] >= 0]
    return node


def route_shuffled(B: np.ndarray, V: np.ndarray, R: int, arrays) -> tuple:
    """Leaf of every row, and (row, column of V, leaf) where it may differ with the column's value
    in the place of feature column // R: such a row leaves the row's path where their ways part."""
    feat, thr, left, right = arrays
    node, apart, out = np.zeros(len(B), np.int64), np.zeros(V.shape, bool), []
    live = np.arange(len(B)) if feat[0] >= 0 else np.empty(0, np.int64)
    while len(live):
        at = node[live]
        f, t = feat[at], thr[at]
        go = B[live, f] > t
        columns = f[:, None] * R + np.arange(R)
        i, r = np.nonzero(((V[live[:, None], columns] > t[:, None]) != go[:, None]) & ~apart[live[:, None], columns])
        apart[live[i], columns[i, r]] = True
        out.append((live[i], columns[i, r], np.where(go, left[at], right[at])[i]))
        node[live] = at = np.where(go, right[at], left[at])
        live = live[feat[at] >= 0]
    row, column, end = (np.concatenate([o[c] for o in out] or [np.zeros(0, np.int64)]) for c in range(3))
    live = np.flatnonzero(feat[end] >= 0)
    while len(live):
        at = end[live]
        f, i, c = feat[at], row[live], column[live]
        go = np.where(c // R == f, V[i, c], B[i, f]) > thr[at]
        end[live] = at = np.where(go, right[at], left[at])
        live = live[feat[at] >= 0]
    return node, row, column, end


def tasks_of(n_rows: int, partitions: int, cores: int) -> int:
    """Tasks of a pass: one for each core where rows pay for it, then one for every
    ``WAVE_ROWS`` rows, since each task sends its histograms of all open nodes."""
    return max(1, min(partitions, max(math.ceil(n_rows / WAVE_ROWS), min(cores, math.ceil(n_rows / TASK_ROWS)))))


def add_classes(hist: np.ndarray, at: np.ndarray, B: np.ndarray, y: np.ndarray, weight, live, features) -> None:
    """Adds the ``live`` rows (None: all) with a node ``at`` (-1: none) to hist (nodes, d, bins, K + 1):
    weights (None: 1) by class, then the number of rows.  Channels one by one give the same sums."""
    n, _, nb, C = hist.shape
    K = C - 1
    use = np.flatnonzero(at >= 0) if live is None else live[at[live] >= 0]
    where, label, w = at[use] * nb, y[use], None if weight is None else weight[use]
    for f in features:
        key = where + B[use, f]
        part = np.bincount(key * K + label, w, n * nb * K).reshape(n, nb, K)
        hist[:, f, :, :-1] += part
        hist[:, f, :, -1] += part.sum(axis=2) if w is None else np.bincount(key, minlength=n * nb).reshape(n, nb)


def softmax_gradients(m: np.ndarray, y: np.ndarray, second_order: bool, hess_scale: float):
    """Gradient, split Hessian and leaf Hessian of the log loss by class."""
    k = m.shape[1]
    p = np.exp(m - m.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    h = np.maximum(p * (1 - p), 1e-16)
    if second_order:
        return g, hess_scale * h, hess_scale * h
    return g, np.ones_like(p), h * (k / max(1, k - 1))


def best_split(hist: np.ndarray, gain_of, least: float, allowed: np.ndarray | None = None):
    """(gain, feature, bin, left, right, total) of one node; hist (d, bins, C)
    with the row count as last channel; None without an admissible split.
    ``allowed``: mask (d, bins) of thresholds."""
    total = hist[0].sum(axis=0)
    left = np.cumsum(hist, axis=1)[:, :-1]
    right = total - left
    gain, ok = gain_of(left, right, total)
    ok &= (left[..., -1] >= max(1, least)) & (right[..., -1] >= max(1, least))
    if allowed is not None:
        ok &= allowed[:, :-1]
    gain = np.where(ok, np.round(gain, 12), -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not gain[f, b] > 1e-12:
        return None, total
    return (float(gain[f, b]), int(f), int(b), left[f, b], right[f, b]), total


class HistGBM(Estimator):
    def __init__(self, n_rounds=200, lr=0.1, depth=6, max_bins=255, lam=1.0, min_child_weight=1.0,
                 min_child_samples=0, policy="depthwise", max_leaves=None, second_order=True,
                 hess_scale=2.0, goss=None, dart_rate=None, ckpt_every=10, cyclic=False,
                 balanced=False, prior=False, seed=42, **extra):
        self.n_rounds, self.lr, self.depth, self.max_bins = n_rounds, lr, depth, max_bins
        self.lam, self.mcw, self.mcs = lam, min_child_weight, min_child_samples
        self.policy, self.max_leaves, self.second_order = policy, max_leaves, second_order
        self.hess_scale, self.goss, self.dart_rate, self.ckpt_every = hess_scale, goss, dart_rate, ckpt_every
        self.cyclic, self.balanced, self.prior, self.seed = cyclic, balanced, prior, seed
        self.params = dict(n_estimators=n_rounds, learning_rate=lr, max_depth=depth, max_bins=max_bins,
                           reg_lambda=lam, grow_policy=policy, max_leaves=max_leaves, **extra)
        self.params |= {k: v for k, v in dict(goss=goss, rate_drop=dart_rate, class_weight="balanced" if balanced else None,
                                              cyclic_features=cyclic or None).items() if v is not None}

    # what differs from a Gini forest -----------------------------------
    def _channels(self, K: int) -> int:
        return 4

    def _stats(self, batch: dict, K: int):
        """Function (tree number) -> (rows, channels); the last channel counts rows."""
        m, y, w = batch["m"], batch["y"], batch["w"]
        if batch["dropped"] is not None:
            m = m - batch["dropped"]
        g, hs, hl = softmax_gradients(m, y, self.second_order, self.hess_scale)
        if self.goss:
            top, other, threshold, r = batch["goss"]
            big = np.abs(g).sum(axis=1) >= threshold
            keep = _uniform(self.seed + r, batch["row_id"]) < other / max(1e-12, 1 - top)
            w = w * np.where(big, 1.0, np.where(keep, (1 - top) / other, 0.0))
        live = (w > 0).astype(float)
        return lambda t: np.stack([g[:, t % K] * w, hs[:, t % K] * w, hl[:, t % K] * w, live], axis=1)

    def _gain(self):
        lam, mcw = self.lam, self.mcw

        def gain(left, right, total):
            with np.errstate(divide="ignore", invalid="ignore"):
                s = lambda x: np.nan_to_num(x[..., 0] ** 2 / (x[..., 1] + lam))
                return s(left) + s(right) - s(total), (left[..., 1] >= mcw) & (right[..., 1] >= mcw)
        return gain

    def _leaf(self, stats, K: int):
        den = stats[2] + self.lam
        return -stats[0] / den if den > 0 else 0.0

    def _allowed(self, r: int, t: int, path: int, hist: np.ndarray):
        if not self.cyclic:
            return None
        mask = np.zeros(hist.shape[:2], bool)
        mask[r % len(mask)] = True
        return mask

    def _classes(self, batch: dict, K: int):
        """Function (tree number) -> (weights of the rows, None: 1; numbers of the rows that count,
        None: all), where the channels of a row are its weight at its class and the row count; None where they are not."""
        return None

    def _folded(self, r: int) -> list[int]:
        """Features whose histograms round r needs; totals are those of feature 0."""
        return sorted({0, r % self._d}) if self.cyclic else list(range(self._d))

    # ------------------------------------------------------------- jobs
    def _read(self, batch: pa.RecordBatch, K: int, d: int) -> dict:
        col = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        return {"row_id": col["row_id"], "y": col["label"].astype(np.int64), "w": col["w"],
                "B": np.stack([col[f"b_{j}"] for j in range(d)]).astype(np.int64).T,      # a column is contiguous
                "m": np.stack([col[f"m_{c}"] for c in range(K)], axis=1), "dropped": None, "goss": None}

    def _evaluate(self, state: DataFrame, trees: list[Tree], open_: list[tuple[int, int]], r: int, job: dict) -> dict:
        """(tree, node) -> (split or None, totals) of the open nodes."""
        K, d, nb = self._k, self._d, self.max_bins + 2
        C = self._channels(K)
        per_job = max(1, MAX_CELLS // (d * nb * C))
        features, out = self._folded(r), {}
        spark = state.sparkSession
        for lo in range(0, len(open_), per_job):
            part = open_[lo:lo + per_job]
            path = {(t, node): trees[t].path[node] for t, node in part}
            by_tree: dict[int, list[int]] = {}
            for t, node in part:
                by_tree.setdefault(t, []).append(node)
            shipped = spark.sparkContext.broadcast({t: (trees[t].arrays(), nodes) for t, nodes in by_tree.items()})

            def fold(batches):
                from pyspark import TaskContext
                hist: dict = {}
                for b in batches:
                    if not b.num_rows:
                        continue
                    data = self._read(b, K, d)
                    self._prepare(data, job, K)
                    classes = self._classes(data, K)
                    stats = self._stats(data, K) if classes is None else None
                    for t, (arrays, nodes) in shipped.value.items():
                        slot = np.full(len(arrays[0]), -1)
                        slot[nodes] = np.arange(len(nodes))
                        at = slot[route(data["B"], arrays)]
                        if t not in hist:
                            hist[t] = np.zeros((len(nodes), d, nb, C))
                        if classes is not None:
                            add_classes(hist[t], at, data["B"], data["y"], *classes(t), features)
                            continue
                        s = stats(t)
                        use = np.flatnonzero((at >= 0) & (s[:, -1] > 0))
                        for f in features:
                            key = at[use] * nb + data["B"][use, f]
                            for c in range(C):
                                hist[t][:, f, :, c] += np.bincount(key, s[use, c], minlength=len(nodes) * nb).reshape(len(nodes), nb)
                salt = TaskContext.get().partitionId()
                for t, h in hist.items():
                    for node, one in zip(shipped.value[t][1], h):
                        if one[0, :, -1].any():
                            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([node], pa.int32()),
                                                              pa.array([salt], pa.int32()), pa.array([_filled(one)], pa.binary())],
                                                             ["t", "node", "salt", "hist"])

            def added(blobs) -> np.ndarray:
                total = np.zeros((d * nb, C))
                for x in blobs:
                    cell, value = _cells(x, C)
                    total[cell] += value
                return total.reshape(d, nb, C)

            def add(table: pa.Table) -> pa.Table:
                return pa.table({"t": table["t"][:1], "node": table["node"][:1], "salt": table["salt"][:1],
                                 "hist": pa.array([_filled(added(table["hist"].to_pylist()))], pa.binary())})
            parts = state.mapInArrow(fold, PART)
            gain, least = self._gain(), self.mcs
            # a row fills a cell of each feature of a tree; a task sends nb cells of each feature of a node
            bound = len(features) * (4 + 8 * C) * min(self._n * len(by_tree), self._tasks * len(part) * nb)
            if bound <= DIRECT_BYTES and self.policy != "oblivious":
                of: dict = {}
                for x in sorted(parts.collect(), key=lambda x: x["salt"]):
                    of.setdefault((x["t"], x["node"]), []).append(bytes(x["hist"]))
                for (t, node), blobs in of.items():
                    hist = added(blobs)
                    out[t, node] = best_split(hist, gain, least, self._allowed(r, t, path[t, node], hist))
                shipped.destroy()
                continue
            if self._tasks > ONE_ROUND_TASKS:
                parts = (parts.withColumn("salt", F.pmod("salt", F.lit(int(math.sqrt(self._tasks)))).cast("int"))
                         .groupBy("t", "node", "salt").applyInArrow(add, PART))

            def choose(table: pa.Table) -> pa.Table:
                t, node = table["t"][0].as_py(), table["node"][0].as_py()
                hist = added(table.sort_by("salt")["hist"].to_pylist())
                split, total = best_split(hist, gain, least, self._allowed(r, t, path[t, node], hist))
                return _split_rows([(t, node, split, total)])

            def choose_level(table: pa.Table) -> pa.Table:
                """Oblivious: the split with the largest sum of gains."""
                t = table["t"][0].as_py()
                of = table["node"].to_numpy()
                hists = {n: added(table.filter(pa.array(of == n)).sort_by("salt")["hist"].to_pylist()) for n in np.unique(of).tolist()}
                score = 0
                for h in hists.values():
                    left, total = np.cumsum(h, axis=1)[:, :-1], h[0].sum(axis=0)
                    s, ok = gain(left, total - left, total)
                    score = score + np.where(ok & (left[..., -1] >= max(1, least)) & ((total - left)[..., -1] >= max(1, least)), s, 0.0)
                score = np.round(score, 12)
                f, b = np.unravel_index(int(np.argmax(score)), score.shape)
                rows = []
                for n, h in hists.items():
                    left, total = h[f, :b + 1].sum(axis=0), h[0].sum(axis=0)
                    rows.append((t, n, (float(score[f, b]), int(f), int(b), left, total - left) if score[f, b] > 1e-12 else None, total))
                return _split_rows(rows)
            chosen = (parts.groupBy("t").applyInArrow(choose_level, SPLIT) if self.policy == "oblivious"
                      else parts.groupBy("t", "node").applyInArrow(choose, SPLIT))
            for x in chosen.collect():            # one row per open node
                total = np.frombuffer(bytes(x["total"]))
                split = None if x["f"] < 0 else (x["gain"], x["f"], x["bin"], np.frombuffer(bytes(x["left"])), np.frombuffer(bytes(x["right"])))
                out[x["t"], x["node"]] = (split, total)
            shipped.destroy()
        return out

    def _prepare(self, data: dict, job: dict, K: int) -> None:
        """Margins with the rounds that are not in the state yet; the dropped
        rounds' margins; the one-side sampling threshold."""
        if job.get("pending") is not None:
            data["m"] = data["m"] + _margins(data["B"], job["pending"].value, K)
        if job.get("drop") is not None:
            data["dropped"] = _margins(data["B"], job["drop"].value, K)
        data["goss"] = job.get("goss")

    # -------------------------------------------------------------- growth
    def _grow(self, state, trees: list[Tree], r: int, job: dict) -> None:
        if self.policy == "leaves":
            return self._grow_best_first(state, trees, r, job)
        open_ = [(t, 0) for t in range(len(trees))]
        while open_:
            found = self._evaluate(state, trees, open_, r, job)
            after = []
            for t, node in open_:
                split, total = found.get((t, node), (None, None))
                tree = trees[t]
                if tree.stats[node] is None:
                    tree.stats[node] = total
                if split is None or (self.depth and tree.depth[node] >= self.depth):
                    continue
                for child in tree.split(node, *split):
                    if not self.depth or tree.depth[child] < self.depth:
                        after.append((t, child))
            open_ = after

    def _grow_best_first(self, state, trees, r, job) -> None:
        known: list[dict] = [{} for _ in trees]
        open_ = [(t, 0) for t in range(len(trees))]
        while open_:
            for (t, node), (split, total) in self._evaluate(state, trees, open_, r, job).items():
                known[t][node] = split
                if trees[t].stats[node] is None:
                    trees[t].stats[node] = total
            open_ = []
            for t, tree in enumerate(trees):
                # split what best-first order would split on what is known so far
                for node in self._order(tree, known[t]):
                    if tree.feat[node] < 0:
                        open_ += [(t, c) for c in tree.split(node, *known[t][node])]
        for t, tree in enumerate(trees):
            made = set(self._order(tree, known[t]))
            for node in range(len(tree.feat)):
                if node not in made:
                    tree.feat[node] = -1

    def _order(self, tree: Tree, known: dict) -> list[int]:
        """Nodes that best-first growth splits; children that are not known
        yet are passed over."""
        heap, out = [], []

        def push(node):
            if known.get(node) is not None and (not self.depth or tree.depth[node] < self.depth):
                heapq.heappush(heap, (-known[node][0], node))
        push(0)
        while heap and len(out) < (self.max_leaves or 1 << 30) - 1:
            _, node = heapq.heappop(heap)
            out.append(node)
            if tree.feat[node] >= 0:
                push(tree.left[node])
                push(tree.right[node])
        return out

    # ----------------------------------------------------------------- fit
    def _state(self, train, ctx: Ctx):
        K, feats = ctx.k, ctx.features
        self._k, self._d = K, len(feats)
        self.edges = bin_edges(train, feats, self.max_bins)
        src = balanced_weights(train) if self.balanced else train.withColumn("weight", F.lit(1.0))
        start = np.zeros(K)
        if self.prior:
            n = {x["label"]: x["s"] for x in src.groupBy("label").agg(F.sum("weight").alias("s")).collect()}
            start = np.log(np.array([max(n.get(c, 0.0), 1e-12) for c in range(K)]) / sum(n.values()))
        state = (binned(src, feats, self.edges, F.col("weight").cast("double").alias("w"))
                 .select("*", *[F.lit(float(v)).alias(f"m_{c}") for c, v in enumerate(start)])
                 )
        # a model takes hundreds of jobs over this state: no more tasks than rows pay for
        self._n = train.count()
        self._tasks = tasks_of(self._n, state.rdd.getNumPartitions(), state.sparkSession.sparkContext.defaultParallelism)
        state = state.coalesce(self._tasks).persist(StorageLevel.MEMORY_AND_DISK)
        return state, start

    def fit(self, train, ctx: Ctx):
        K = ctx.k
        state, start = self._state(train, ctx)
        forest: list[list] = []          # per round: (arrays, leaf values) of the K trees, scaled
        gains = np.zeros(self._d)
        pending: list[list] = []         # rounds that the state's margins lack
        for r in range(self.n_rounds):
            job, dropped = {}, []
            if pending:
                job["pending"] = state.sparkSession.sparkContext.broadcast(pending)
            if self.dart_rate:
                dropped = [i for i in range(r) if _uniform(self.seed, [r], [i])[0] < self.dart_rate]
                if dropped:
                    job["drop"] = state.sparkSession.sparkContext.broadcast([forest[i] for i in dropped])
            if self.goss:
                job["goss"] = (*self.goss, self._goss_threshold(state, K, job), r)
            trees = [Tree() for _ in range(K)]
            self._grow(state, trees, r, job)
            rate = self.lr / (len(dropped) + 1)
            new = [(t.arrays(), rate * np.array([self._leaf(s, K) if s is not None else 0.0 for s in t.stats])) for t in trees]
            if all(len(a[0]) == 1 for a, _ in new) and not dropped and not self.cyclic:
                break                    # no tree found a split
            # dropped rounds keep k / (k + 1) of their weight
            keep = len(dropped) / (len(dropped) + 1)
            change = [[(a, (keep - 1) * v) for a, v in forest[i]] for i in dropped] + [new]
            for i in dropped:
                forest[i] = [(a, keep * v) for a, v in forest[i]]
            forest.append(new)
            gains += sum(t.gains(self._d) for t in trees)
            pending = pending + change
            if len(pending) >= self.ckpt_every * (2 if self.dart_rate else 1):
                state, pending = self._update(state, pending, K), []
            for name in {"drop", "pending"} & set(job):
                job[name].destroy()
        state.unpersist()
        fitted = _HGFitted(forest, start, self.edges, ctx.features, K)
        fitted.importances = gains / max(gains.sum(), 1e-300)
        return fitted

    def _goss_threshold(self, state, K, job) -> float:
        d, top = self._d, self.goss[0]

        def size(batches):
            for b in batches:
                x = self._read(b, K, d)
                self._prepare(x, job, K)
                g, _, _ = softmax_gradients(x["m"], x["y"], True, 1.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.abs(g).sum(axis=1))], ["a"])
        return state.mapInArrow(size, "a double").approxQuantile("a", [1 - top], 1e-3)[0]

    def _update(self, state, change, K):
        """The state with further rounds in its margins; cuts the lineage."""
        d = self._d
        shipped = state.sparkSession.sparkContext.broadcast(change)

        def run(batches):
            for b in batches:
                x = self._read(b, K, d)
                m = x["m"] + _margins(x["B"], shipped.value, K)
                n = b.num_columns - K
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(m[:, c]) for c in range(K)]], b.schema.names)
        new = state.mapInArrow(run, state.schema).checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
        new.count()
        state.unpersist()
        shipped.destroy()
        return new


def _filled(hist: np.ndarray) -> bytes:
    """The cells that hold rows: number, then their channels."""
    flat = hist.reshape(-1, hist.shape[-1])
    cell = np.flatnonzero(flat[:, -1])
    return len(cell).to_bytes(4, "little") + cell.astype("<i4").tobytes() + flat[cell].tobytes()


def _cells(blob: bytes, C: int) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    return np.frombuffer(blob, "<i4", n, 4), np.frombuffer(blob, np.float64, n * C, 4 + 4 * n).reshape(n, C)


def _split_rows(rows) -> pa.Table:
    none = (float("-inf"), -1, 0, np.zeros(0), np.zeros(0))
    full = [(t, node, split or none, total) for t, node, split, total in rows]
    return pa.table({
        "t": pa.array([x[0] for x in full], pa.int32()), "node": pa.array([x[1] for x in full], pa.int32()),
        "gain": pa.array([x[2][0] for x in full], pa.float64()), "f": pa.array([x[2][1] for x in full], pa.int32()),
        "bin": pa.array([x[2][2] for x in full], pa.int32()), "left": pa.array([x[2][3].tobytes() for x in full], pa.binary()),
        "right": pa.array([x[2][4].tobytes() for x in full], pa.binary()), "total": pa.array([x[3].tobytes() for x in full], pa.binary())})


def _margins(B: np.ndarray, rounds, K: int) -> np.ndarray:
    m = np.zeros((len(B), K))
    for trees in rounds:
        for t, (arrays, value) in enumerate(trees):
            m[:, t] += value[route(B, arrays)]
    return m


class GiniForest(HistGBM):
    """Multiclass Gini trees that average their leaves' class shares: single trees,
    extra trees (random thresholds), bootstrapped forests (``sample='bootstrap'``) and
    balanced ones (``'balanced'``: per tree a draw with replacement of as many
    rows of each class as the smallest has, P3 keyed by tree).

    Nodes beyond ``subtree.SUBTREE_ROWS`` are split by jobs over the whole table; a
    node below goes to one task with its rows and is finished there, so the number
    of jobs does not grow with the depth of the trees or the number of leaves."""

    def __init__(self, n_trees=200, depth=None, max_bins=255, max_features="sqrt", random_threshold=False,
                 sample=None, balanced=True, min_child_samples=1, seed=42, **extra):
        super().__init__(n_rounds=n_trees, depth=depth, max_bins=max_bins, min_child_samples=min_child_samples,
                         balanced=balanced, seed=seed, **extra)
        self.max_features, self.random_threshold, self.sample = max_features, random_threshold, sample
        self.params = dict(n_estimators=n_trees, max_depth=depth, max_features=max_features, sample=sample,
                           random_threshold=random_threshold, class_weight="balanced" if balanced else None, **extra)

    def _channels(self, K):
        return K + 1

    def _times(self, data: dict, t: int) -> np.ndarray:
        """How often tree t drew each row: Poisson by inverse CDF of a hashed uniform."""
        y, rate = data["y"], self._rate
        if rate is None:
            return np.ones(len(y))
        u, lam = _uniform(self.seed, np.full(len(y), t), data["row_id"]), rate[y]
        p = c = np.exp(-lam)
        times = (u >= c).astype(float)
        for j in range(1, 30):
            p = p * lam / j
            c = c + p
            times += u >= c
        return times

    def _classes(self, batch, K):
        def of(t):
            if self._rate is None:
                return None, None
            times = self._times(batch, t)
            return times, np.flatnonzero(times > 0)
        return of

    def _gain(self):
        score, weight = gini_score, self._weight          # counts are whole; classes are weighted here

        def gain(left, right, total):
            left, right, total = (x[..., :-1] for x in (left, right, total))
            return score(left, weight) + score(right, weight) - score(total, weight), np.ones(left.shape[:-1], bool)
        return gain

    def _allowed(self, r, t, path, hist):
        d, nb = hist.shape[:2]
        seen = hist[..., -1] > 0
        mask = np.ones((d, nb), bool)
        if self.random_threshold:         # one threshold per feature within the bins of the node
            lo, hi = seen.argmax(axis=1), nb - 1 - seen[:, ::-1].argmax(axis=1)
            u = _uniform(self.seed + 1, np.full(d, t), np.full(d, path), np.arange(d))
            mask = np.arange(nb)[None, :] == (lo + np.floor(u * (hi - lo)))[:, None]
        if self.max_features == "sqrt":   # among the features that vary in the node
            vary = np.flatnonzero(seen.sum(axis=1) > 1)
            u = _uniform(self.seed + 2, np.full(len(vary), t), np.full(len(vary), path), vary)
            mask[np.setdiff1d(np.arange(d), vary[np.argsort(u)][:max(1, int(math.sqrt(d)))])] = False
        return mask

    def _grow_top(self, state, trees) -> dict[int, list[int]]:
        """Splits nodes that no task holds; tree -> nodes that are left to tasks."""
        pending: dict[int, list[int]] = {t: [0] if self._n <= subtree.SUBTREE_ROWS else [] for t in range(len(trees))}
        open_ = [(t, 0) for t in pending if not pending[t]]
        while open_:
            found, after = self._evaluate(state, trees, open_, 0, {}), []
            for t, node in open_:
                split, total = found.get((t, node), (None, None))
                tree = trees[t]
                if tree.stats[node] is None:
                    tree.stats[node] = total
                if split is None or (self.depth and tree.depth[node] >= self.depth):
                    continue
                for child, rows in zip(tree.split(node, *split), (split[3][-1], split[4][-1])):
                    if rows <= subtree.SUBTREE_ROWS:
                        pending[t].append(child)
                    else:
                        after.append((t, child))
            open_ = after
        return {t: nodes for t, nodes in pending.items() if nodes}

    def fit(self, train, ctx: Ctx):
        K = ctx.k
        state, _ = self._state(train, ctx)
        classes = {x["label"]: x for x in state.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).collect()}
        self._weight = np.array([classes[c]["w"] if c in classes else 0.0 for c in range(K)])
        self._rate = None
        if self.sample == "bootstrap":
            self._rate = np.ones(K)
        elif self.sample == "balanced":
            least = min(x["n"] for x in classes.values())
            self._rate = np.array([least / classes[c]["n"] if c in classes else 0.0 for c in range(K)])
        trees = [Tree() for _ in range(self.n_rounds)]
        pending = self._grow_top(state, trees)
        d = self._d
        spec = subtree.Spec(K, self._weight, self.seed, self.max_features, self.random_threshold, self.mcs, self.depth)
        below = subtree.completed(state, trees, pending, spec, lambda b: self._read(b, K, d), self._times, route, self._n, self.max_bins)
        state.unpersist()
        size = below.agg(F.sum(F.length("tree"))).first()[0] or 0
        if size > subtree.MODEL_BYTES:
            fitted = _LargeForest(trees, pending, below, self._weight, self.edges, ctx.features, K)
        else:
            whole = subtree.stitched(trees, below.drop("gains").collect(), self._weight, K)
            fitted = _HGFitted(None, np.zeros(K), self.edges, ctx.features, K, [(a, s / len(trees)) for a, s in whole])
        fitted.importances = subtree.gain_shares(trees, below, d)
        return fitted


class _LargeForest(Fitted):
    """A forest whose subtrees are a table; see ``subtree.scored``."""

    def __init__(self, trees, pending, below, weight, edges, feats, K):
        self.trees, self.pending, self.below, self.weight, self.edges, self.feats, self.K = trees, pending, below, weight, edges, feats, K
        self.size = f"{len(trees)} trees"

    def proba(self, df):
        """(row_id, y, prob array<double>)."""
        b = binned(df.select("row_id", "label", *self.feats), self.feats, self.edges)
        return subtree.scored(b, len(self.feats), self.K, self.trees, self.pending, self.below, self.weight, route)

    def predict(self, df):
        # ties go to the lowest class; sums of shares come in any order, so they are rounded
        best = F.array_position("p", F.array_max("p")) - 1
        return (self.proba(df).select("row_id", "y", F.transform("prob", lambda x: F.round(x, 12)).alias("p"))
                .select("row_id", "y", best.cast("int").alias("p")))


class _HGFitted(Fitted):
    def __init__(self, forest, start, edges, feats, K, shares=None):
        self.forest, self.start, self.edges, self.feats, self.K, self.shares = forest, start, edges, feats, K, shares
        self.size = f"{len(shares) if shares is not None else len(forest) * K} trees"

    def proba(self, df):
        """(row_id, y, prob array<double>)."""
        return self._run(df, proba=True)

    def predict(self, df):
        return self._run(df, proba=False)

    def shuffled_scorer(self, sc):
        if self.shares is None:
            return None
        K, shipped = self.K, sc.broadcast((self.shares, [np.asarray(e, float)[1:-1] for e in self.edges]))

        def score(X, V, R):
            shares, inner = shipped.value
            out = np.empty(V.shape, np.int64)
            for s in range(0, len(X), SHUFFLED_ROWS):
                x, v = X[s:s + SHUFFLED_ROWS], V[s:s + SHUFFLED_ROWS]
                B = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(inner)], axis=1)
                W = np.stack([np.searchsorted(inner[c // R], v[:, c], side="right") for c in range(v.shape[1])], axis=1)
                prob = np.zeros((*W.shape, K))
                for arrays, value in shares:            # in the order of ``predict``: the same sums
                    node, row, column, end = route_shuffled(B, W, R, arrays)
                    share = np.repeat(value[node][:, None, :], W.shape[1], axis=1)
                    share[row, column] = value[end]
                    prob += share
                out[s:s + SHUFFLED_ROWS] = prob.argmax(axis=2)
            return out
        return score

    def _run(self, df, proba):
        K, start, d = self.K, self.start, len(self.feats)
        b = binned(df.select("row_id", "label", *self.feats), self.feats, self.edges)
        shipped = df.sparkSession.sparkContext.broadcast((self.forest, self.shares))

        def run(batches):
            forest, shares = shipped.value
            for x in batches:
                B = np.stack([x.column(2 + j).to_numpy(zero_copy_only=False) for j in range(d)], axis=1).astype(np.int64)
                if shares is not None:
                    prob = np.zeros((len(B), K))
                    for arrays, value in shares:
                        prob += value[route(B, arrays)]
                else:
                    m = start + _margins(B, forest, K)
                    prob = np.exp(m - m.max(axis=1, keepdims=True)) if len(m) else m
                    prob = prob / prob.sum(axis=1, keepdims=True)
                last = (pa.array(list(prob), pa.list_(pa.float64())) if proba else pa.array(np.argmax(prob, axis=1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([x.column(0).cast(pa.int64()), x.column(1).cast(pa.int32()), last],
                                                 ["row_id", "y", "prob" if proba else "p"])
        return b.mapInArrow(run, f"row_id long, y int, {'prob array<double>' if proba else 'p int'}")
