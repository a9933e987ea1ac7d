"""Exact k-nearest-neighbour join by pruned cells: M36 (knn5), M37
(knn15_distance), and the neighbour table reused by bagging-kNN (M19) and label
spreading (M39).

Train rows belong to the cell of their nearest pivot; pivots are the train rows of
least hash, at most ``MAX_PIVOTS`` of them.  A cell's radius and the planes halfway
between pivots bound the distance of a test row to everything in a cell from
below (triangle inequality).  Two rounds:

1. A test row meets its own cell; its k-th distance there bounds the final one.
2. It visits the other cells whose lower bound does not exceed that distance.

Cells are laid out in buckets, near ones together (cells beyond ``BLOCK_ROWS`` in
parts); a bucket is a task, and a test row goes to a bucket once if it visits any cell
there.  So a train row is moved once a round and a test row once per bucket that it
needs: one where cells separate, at worst (many features without structure) all.
Buckets with much work are split by test rows; train rows are copied then.  Inside a
task one matrix product per cell bounds all distances from both sides; only pairs that
may be among the k best get the exact distance.  A window per test row takes the k best
of all buckets.

Distances are rounded to 10 decimals and ties are broken by the train row id, so
the neighbour set is a deterministic function of the data (and matches the SQL
formulation).  Pivots only decide what is looked at.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classyard.operators.models.base import Ctx, Estimator, Fitted

BLOCK_ROWS = 20_000      # train rows that need no cells; most rows of a part of a cell
BUCKET_BLOCKS = 4        # a bucket has this many times BLOCK_ROWS train rows
CELL_ROWS = 512          # train rows per cell
MAX_PIVOTS = 4096        # cells; their pivots and radii are the model that tasks receive
TASK_PAIRS = 4_000_000_000  # (train, test) pairs that a task should not exceed
LEAST_PAIRS = 20_000_000    # nor fall below without need
TASK_BLOCKS = 8          # nor this many times BLOCK_ROWS test rows: train rows are copied for each task of a bucket
TILE = 1_000_000         # distances held at once
NEAR_ROWS = 256          # near rows that share one choice of cells
SOME = 64                # cells that give a first bound of the distance to the nearest pivot
TRIED = 8                # blocks without a choice before the others are not tried
PART_SPACE = 4           # partitions per part of a bucket, for parts are dealt by hash
HELD = 2_000_000         # found pairs held before they are cut to the k best
ROUND = 10
EPS = float(np.finfo(np.float64).eps)


def _topk_idx(d2: np.ndarray, kk: int) -> np.ndarray:
    """Column indices of the kk smallest values per row, ties by column order.

    argpartition is O(n) per row; rows where the k-th value is tied with an
    unselected entry (duplicate points) are redone with a stable sort, so the
    result equals a full stable argsort.
    """
    if kk >= d2.shape[1]:
        return np.argsort(d2, axis=1, kind="stable")[:, :kk]
    idx = np.argpartition(d2, kk - 1, axis=1)[:, :kk]
    vals = np.take_along_axis(d2, idx, 1)
    kth = vals.max(axis=1, keepdims=True)
    bad = (d2 == kth).sum(axis=1) != (vals == kth).sum(axis=1)
    if bad.any():
        idx[bad] = np.argsort(d2[bad], axis=1, kind="stable")[:, :kk]
    return idx


def _squares(X: np.ndarray, P: np.ndarray) -> np.ndarray:
    """Squared distances, summed over features from left to right as in SQL."""
    d2 = np.zeros((len(X), len(P)))
    for j in range(X.shape[1]):
        diff = X[:, j:j + 1] - P[None, :, j]
        d2 += diff * diff
    return d2


def _matrix(batch, columns: list[str]) -> np.ndarray:
    cols = [batch.column(c) for c in columns]
    return np.stack([np.asarray(c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy(), np.float64) for c in cols], axis=1)


def _pair_squares(X: np.ndarray, P: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``_squares(X, P)[i, j]``, to the last bit."""
    d2 = np.zeros(len(i))
    for f in range(X.shape[1]):
        diff = X[i, f] - P[j, f]
        d2 += diff * diff
    return d2


class Screen:
    """Squared distances to fixed rows by one matrix product, with a bound of the error."""

    def __init__(self, P: np.ndarray):
        self.centre = P.mean(axis=0)
        A = P - self.centre
        square = (A * A).sum(axis=1)
        self.ok = bool(np.isfinite(square).all())
        self.far = math.sqrt(square.max(initial=0.0)) if self.ok else math.nan
        self.M = np.vstack([-2 * A.T, square])

    def __call__(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(less, own, err): the squared distance is ``less + own`` to within ``err`` (rows)."""
        B = X - self.centre
        own = (B * B).sum(axis=1)
        err = 8 * (X.shape[1] + 4) * EPS * (np.sqrt(own) + self.far) ** 2
        return np.column_stack([B, np.ones(len(B))]) @ self.M, own, err


def _near_order(P: np.ndarray) -> np.ndarray:
    """An order of rows in which near ones are close: halved along the widest feature."""
    out, todo = [], [np.arange(len(P))]
    while todo:
        at = todo.pop()
        if len(at) <= 2:
            out.append(at)
            continue
        at = at[np.argsort(P[at, np.ptp(P[at], axis=0).argmax()], kind="stable")]
        todo += [at[len(at) // 2:], at[:len(at) // 2]]
    return np.concatenate(out)


def _near_blocks(X: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in blocks of at most ``most`` near ones, by the same halving."""
    out, todo = [], [np.arange(len(X))] if len(X) else []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        x, half = X[at], len(at) // 2
        at = at[np.argpartition(x[:, np.ptp(x, axis=0).argmax()], half)]
        todo += [at[half:], at[:half]]
    return out


class Cells:
    """Pivots, radii and the layout of cells in buckets."""

    def __init__(self, pivots: np.ndarray, n_train: int):
        pivots = pivots[np.isfinite(pivots).all(axis=1)]
        self.pivots = pivots[_near_order(pivots)] if len(pivots) else np.zeros((1, pivots.shape[1]))
        self.radius = self.rows = self.least = self.unit_cell = self.unit_bucket = None

    def measured(self, radius: np.ndarray, rows: np.ndarray, least: np.ndarray | None = None) -> None:
        """Radius and rows of each cell are known (of groups: the most, and the ``least``):
        lay out parts."""
        self.radius = np.where(np.isnan(radius), np.inf, radius)
        self.rows, self.least = rows, rows if least is None else least
        self.parts = np.maximum(1, -(-rows // BLOCK_ROWS)).astype(np.int64)
        self.first_unit = np.cumsum(self.parts) - self.parts
        self.unit_cell = np.repeat(np.arange(len(rows)), self.parts)
        self.unit_rows = (rows / self.parts)[self.unit_cell]
        before = np.cumsum(self.unit_rows) - self.unit_rows
        self.unit_bucket = (before // (BUCKET_BLOCKS * BLOCK_ROWS)).astype(np.int64)
        self.live = rows > 0

    def bucket(self, cell: np.ndarray, row_id: np.ndarray) -> np.ndarray:
        return self.unit_bucket[self.first_unit[cell] + (row_id & 0x7FFFFFFFFFFFFFFF) % self.parts[cell]]

    def nearest(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of each row."""
        cell, dist = np.zeros(len(X), np.int64), np.zeros(len(X))
        if len(self.pivots) == 1:
            return cell, np.sqrt(_squares(X, self.pivots))[:, 0]
        dist[:] = np.nan                              # rows that are not finite

        def near(low, high, rows, cells):
            some = cells[np.argpartition(high, SOME - 1)[:SOME]] if len(cells) > SOME else cells
            return ~(low > np.sqrt(_squares(X[rows], self.pivots[some]).min(axis=1).max()) * (1 + 1e-9))
        for rows, among in self._by_block(X, near):
            P = self.pivots if among is None else self.pivots[among]
            screen, step = Screen(P), max(1, TILE // len(P))
            for s in range(0, len(rows), step):
                at = rows[s:s + step]
                less, own, err = screen(X[at])
                i, j = np.nonzero(less <= (less.min(axis=1) + 2 * err)[:, None])
                d2 = _pair_squares(X[at], P, i, j)
                order = np.lexsort((j, d2, i))
                i, j, d2 = i[order], j[order], d2[order]
                head = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
                cell[at[i[head]]], dist[at[i[head]]] = j[head] if among is None else among[j[head]], np.sqrt(d2[head])
        return cell, dist

    def _by_block(self, X: np.ndarray, keeps):
        """(rows, cells) of blocks of near rows: the cells that ``keeps(low, high, rows, cells)``, by bounds
        of the distances of any row of the block to the pivots.  One pair at the end (cells: None,
        all of them) holds the rows of all blocks that keep more than half."""
        finite = np.isfinite(X).all(axis=1)
        rest, at, hits = [np.flatnonzero(~finite)], np.flatnonzero(finite), 0
        for n, rows in enumerate(_near_blocks(X[at], max(1, min(NEAR_ROWS, TILE // len(self.pivots))))):
            rows = at[rows]
            if n >= TRIED and not hits:          # features without structure
                rest.append(rows)
                continue
            x = X[rows]
            # a ball around the block first, its box for the cells that this leaves
            centre = x.mean(axis=0)
            ball = math.sqrt(((x - centre) ** 2).sum(axis=1).max())
            d = np.sqrt(_squares(centre[None, :], self.pivots))[0]
            all_ = np.arange(len(d))
            among = all_[keeps(np.maximum(d - ball, 0.0), d + ball, rows, all_)]
            if 2 * len(among) <= len(d) or 16 * X.shape[1] <= len(rows):
                lo, hi, low, high = x.min(axis=0), x.max(axis=0), np.zeros(len(among)), np.zeros(len(among))
                for f in range(X.shape[1]):
                    p = self.pivots[among, f]
                    low += np.maximum(np.maximum(lo[f] - p, p - hi[f]), 0.0) ** 2
                    high += np.maximum(p - lo[f], hi[f] - p) ** 2
                among = among[keeps(np.sqrt(low), np.sqrt(high), rows, among)]
            if 2 * len(among) <= len(d):
                hits += 1
                yield rows, among
            else:
                rest.append(rows)
        rest = np.concatenate(rest)
        if len(rest):
            yield rest, None

    def visited(self, X: np.ndarray, own: np.ndarray, kth: np.ndarray):
        """(rows, cells, needed) of blocks of rows: what ``needed`` says of the cells that are
        near enough to the block; cells left out are needed by none of its rows."""
        def near(low, high, rows, cells):
            gap = low - self.radius[cells] - 1e-9 * (1 + high)
            return ~((gap > 0) & (gap * gap > kth[rows].max() * (1 + 1e-9) + 1e-9)) & self.live[cells]
        for rows, among in self._by_block(X, near):
            step = len(rows) if among is not None else max(1, TILE // max(1, len(self.unit_cell)))
            for s in range(0, len(rows), step):
                r = rows[s:s + step]
                cells = np.arange(len(self.pivots)) if among is None else among
                if len(cells):
                    yield r, cells, self.needed(X[r], own[r], kth[r], cells)

    def reach(self, X: np.ndarray, k: int) -> np.ndarray:
        """Squared distances within which each row has k train rows, by the rows and
        radii of cells."""
        out = np.full(len(X), np.inf)
        for i, x in enumerate(X):
            far = np.sqrt(_squares(x[None, :], self.pivots))[0] + self.radius
            order = np.argsort(far, kind="stable")
            at = np.searchsorted(np.cumsum(self.least[order]), k)
            if at < len(order) and np.isfinite(far[order[at]]):
                out[i] = far[order[at]] ** 2 * (1 + 1e-9) + 1e-9
        return out

    def needed(self, X: np.ndarray, own: np.ndarray, kth: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """(rows, cells): may the cell hold a row at squared distance ``kth`` or less?"""
        among = np.arange(len(self.pivots)) if among is None else among
        screen, radius = Screen(self.pivots[among]), self.radius[among][None, :]
        less, square, err = screen(X)
        d2 = np.maximum(less + (square - err)[:, None], 0.0)
        d = np.sqrt(d2)
        mine = ((X - self.pivots[own]) ** 2).sum(axis=1) * (1 + 1e-12)
        at, which = np.unique(own, return_inverse=True)
        less, square, err = screen(self.pivots[at])
        between = np.sqrt(np.maximum(less + (square + err)[:, None], 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            # the second term: rounding where a row was given to the nearer of two pivots
            plane = (d2 - mine[:, None]) / (2 * between)[which] - (1e-14 * radius * radius / between)[which]
            low = np.maximum(d - radius, np.where(between[which] > 0, plane, 0.0))
            low = np.maximum(low, 0.0) - 1e-9 * (1 + d)
            far = (low > 0) & (low * low > (kth * (1 + 1e-9) + 1e-9)[:, None])
        return ~far & self.live[among][None, :]


def _found_schema(g: list[str], more: str = "") -> str:
    return "".join(f"{c} long, " for c in g) + "row_id long, y int, " + more + "nb_row array<long>, nb_label array<int>, d2 array<double>"


def _ragged(values: np.ndarray, owner: np.ndarray, n: int, kind) -> pa.ListArray:
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _k_best(rows, dist, ids, labels, k):
    """The k first pairs of each row in the order (distance, train row id)."""
    order = np.lexsort((ids, dist, rows))
    rows, dist, ids, labels = rows[order], dist[order], ids[order], labels[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], dist[keep], ids[keep], labels[keep]


def _candidates(x: np.ndarray, r: np.ndarray, screen: Screen, kth: np.ndarray, k: int):
    """(i, j, rounded squared distance) of pairs of test rows x and train rows r (ties in
    order) that may be among the k best of i, none of them beyond ``kth``."""
    kk = min(k, len(r))
    less = None
    if screen.ok and np.isfinite(x).all():
        less, own, err = screen(x)
        limit = kth * (1 + 4 * EPS) - own + err + 2e-10   # the rounding of distances included
        open_ = ~np.isfinite(limit)
        if open_.any() and kk < len(r):
            # the k-th of a part of the distances bounds the k-th of all
            some = less[open_][:, ::max(1, len(r) // max(1024, 4 * kk))]
            limit[open_] = np.partition(some, kk - 1, axis=1)[:, kk - 1] + 2 * err[open_] + 2e-10
        hit = less <= limit[:, None]
        if 4 * np.count_nonzero(hit) <= hit.size or kk == len(r):
            i, j = np.divmod(np.flatnonzero(hit), len(r))       # nonzero of two axes is slower
            d2 = np.round(_pair_squares(x, r, i, j), ROUND)
            near = ~(d2 > kth[i])
            return i[near], j[near], d2[near]
    d2 = np.round(_squares(x, r), ROUND)                  # many ties, or values that are not finite
    j = _topk_idx(d2, kk)
    return np.repeat(np.arange(len(x)), kk), j.ravel(), np.take_along_axis(d2, j, 1).ravel()


def _bucket_topk(k: int, features: list[str], g: list[str], laid, first: bool):
    """Task of one bucket: per test row the k best among the cells it visits here, its own
    in the ``first`` round."""
    def fn(test: pa.Table, train: pa.Table) -> pa.Table:
        train = train.sort_by([("cell", "ascending"), ("row_id", "ascending")])     # ties by row id
        xt, xr = _matrix(test, features), _matrix(train, features)
        rid, lab = train["row_id"].to_numpy(), train["label"].to_numpy()
        cell, own, kth = train["cell"].to_numpy(), test["cell"].to_numpy(), test["kth"].to_numpy().copy()
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(cell) else np.zeros(1, int)
        done = test["mine"].to_numpy() == test["bucket"].to_numpy()
        found, held, n = [], 0, test.num_rows

        def cut():
            rows, dist, ids, labels = _k_best(*(np.concatenate(c) for c in zip(*found)), k)
            full = np.flatnonzero(np.bincount(rows, minlength=n) >= k)
            kth[full] = np.fmin(kth[full], dist[np.searchsorted(rows, full, side="right") - 1])
            found[:] = [(rows, dist, ids, labels)]
            return len(rows)
        found.append((np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)))
        group = 1 if first else max(1, TILE // max(1, n))      # cells whose bounds are held at once
        for e in range(0, len(edge) - 1, group):
            spans = list(zip(edge[e:e + group], edge[e + 1:e + 1 + group]))
            if not first:
                need = np.concatenate([laid.value.needed(xt[s:s + BLOCK_ROWS], own[s:s + BLOCK_ROWS], kth[s:s + BLOCK_ROWS], cell[[lo for lo, _ in spans]])
                                       for s in range(0, n, BLOCK_ROWS)] or [np.zeros((0, len(spans)), bool)])
            for at, (lo, hi) in enumerate(spans):
                who = np.flatnonzero(own == cell[lo]) if first else np.flatnonzero(need[:, at] & ~((own == cell[lo]) & done))
                if not len(who):
                    continue
                screen, step = Screen(xr[lo:hi]), max(1, TILE // (hi - lo))
                for s in range(0, len(who), step):
                    w = who[s:s + step]
                    i, j, d2 = _candidates(xt[w], xr[lo:hi], screen, kth[w], k)
                    found.append((w[i], d2, rid[lo + j], lab[lo + j]))
                    held += len(i)
                    if held > HELD:
                        held = cut()
        cut()
        rows, dist, ids, labels = found[0]
        if not first:                        # rows without a find here are not sent on
            some, rows = np.unique(rows, return_inverse=True)
            test, n = test.take(pa.array(some)), len(some)
        out = {c: test[c] for c in g + ["row_id", "y"]}
        if first and laid is not None:
            out |= {c: test[c] for c in features + ["cell", "mine"]}
        out |= {"nb_row": _ragged(ids, rows, n, pa.int64()), "nb_label": _ragged(labels, rows, n, pa.int32()),
                "d2": _ragged(dist, rows, n, pa.float64())}
        return pa.table(out)
    return fn


def _meet(test: DataFrame, train: DataFrame, k: int, features: list[str], g: list[str], laid, first: bool) -> DataFrame:
    """Partial results of all (bucket, test row) pairs; buckets with much work are split
    by test rows."""
    at = g + ["bucket"]
    # stored: both sides are dealt by the same counts, one row per bucket
    visits = test.groupBy(*at).agg(F.count(F.lit(1)).alias("visits"), F.sum("work").alias("work")).checkpoint(eager=True)
    # no more than TASK_PAIRS a task, and less where that leaves cores without work
    fair = F.sum("work").over(Window.partitionBy()) / (4 * test.sparkSession.sparkContext.defaultParallelism)
    most = F.least(F.lit(float(TASK_PAIRS)), F.greatest(fair, F.lit(LEAST_PAIRS)))
    split = F.greatest(F.ceil(F.col("work") / most), F.ceil(F.col("visits") / (TASK_BLOCKS * BLOCK_ROWS)), F.lit(1)).cast("int")

    def dealt(df, salt):                 # fresh aliases: both sides join the same counts
        parts = visits.select(*[F.col(c).alias(f"at_{c}") for c in at], split.alias("split"))
        # one row per BUCKET_BLOCKS * BLOCK_ROWS train rows: rows move once, to their task
        df = df.join(F.broadcast(parts), [F.col(c) == F.col(f"at_{c}") for c in at])
        return df.select(*[F.col(c).alias(c) for c in df.columns if not c.startswith("at_") and c != "split"], salt.alias("salt"))
    te = dealt(test, F.pmod(F.xxhash64("row_id"), F.col("split")).cast("int")).drop("work")
    tr = dealt(train, F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    # by number: small parts are not put together by their bytes, which say little of their work
    n = PART_SPACE * (visits.select(split.alias("n")).agg(F.sum("n")).first()[0] or 1)
    te, tr = (df.repartition(n, *at, "salt") for df in (te, tr))
    more = "".join(f"{f} double, " for f in features) + "cell long, mine long, " if first and laid is not None else ""
    return (te.groupBy(*at, "salt").cogroup(tr.groupBy(*at, "salt"))
            .applyInArrow(_bucket_topk(k, features, g, laid, first), _found_schema(g, more)))


def neighbours(train: DataFrame, test: DataFrame, features: list[str], k: int,
               n_train: int | None = None, n_test: int | None = None,
               train_key: str = "label", extra_group: str | None = None) -> DataFrame:
    """(row_id, y, nb_row, nb_label, d2, rank) for the k nearest train rows.

    ``extra_group`` (e.g. a bootstrap replicate id present on both sides) runs
    independent kNN problems in the same job.  The first round and the visits of
    the second are run and checkpointed here, the second when the result is used.
    """
    n_train = n_train if n_train is not None else train.count()
    g = [extra_group] if extra_group else []
    # fresh aliases: train and test usually come from the same cached frame
    head = [F.col(c).cast("long").alias(c) for c in g] + [F.col("row_id").cast("long").alias("row_id")]
    xs = [F.col(f).cast("double").alias(f) for f in features]
    tr = train.select(*head, F.col(train_key).cast("int").alias("label"), *xs)
    te = test.select(*head, F.col("label").cast("int").alias("y"), *xs)
    if n_train <= BLOCK_ROWS:            # one cell
        zero = F.lit(0).cast("long")
        tr = tr.withColumn("cell", zero).withColumn("bucket", zero)
        te = te.select("*", zero.alias("cell"), zero.alias("mine"), zero.alias("bucket"), F.lit(float("inf")).alias("kth"),
                       F.lit(float(n_train)).alias("work"))
        found = _meet(te, tr, k, features, g, None, first=True)
    else:
        found = _two_rounds(tr, te, features, k, g, n_train)
    each = found.select(*g, "row_id", "y", F.inline(F.arrays_zip("nb_row", "nb_label", "d2")))
    w = Window.partitionBy(*g, "row_id").orderBy("d2", "nb_row")   # k x visited buckets rows per test row
    # as a difference: Spark would sort the lists before the shuffle too, to cut what is cut already
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") - k <= 0)


def _two_rounds(tr, te, features, k, g, n_train) -> DataFrame:
    n_pivots = min(MAX_PIVOTS, math.ceil(n_train / CELL_ROWS))
    picked = tr.dropDuplicates(["row_id"]) if g else tr
    picked = picked.select(F.xxhash64("row_id").alias("h"), *features).orderBy("h", *features).limit(n_pivots).toPandas()
    cells = Cells(np.unique(picked[features].to_numpy(np.float64), axis=0), n_train)
    spark = tr.sparkSession
    shipped = spark.sparkContext.broadcast(cells)

    def assign(batches):
        for b in batches:
            cell, dist = shipped.value.nearest(_matrix(b, features))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], [*b.schema.names, "cell", "r"])

    def schema(df, more):
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + more
    tr = tr.mapInArrow(assign, schema(tr, "cell long, r double")).persist(StorageLevel.MEMORY_AND_DISK)
    n, least, radius = np.zeros(len(cells.pivots), np.int64), np.zeros(len(cells.pivots), np.int64), np.zeros(len(cells.pivots))
    # one row per pivot: rows of one group, for independent problems of the most and the least
    each = tr.groupBy(*g, "cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"))
    groups = each.select(*g).distinct().count() if g else 1
    for x in each.groupBy("cell").agg(F.max("n").alias("n"), F.min("n").alias("least"), F.count(F.lit(1)).alias("groups"), F.max("r").alias("r")).collect():
        n[x["cell"]], radius[x["cell"]] = x["n"], x["r"] if x["r"] is not None else np.nan
        least[x["cell"]] = x["least"] if x["groups"] == groups else 0
    cells.measured(radius, n, least)
    laid = spark.sparkContext.broadcast(cells)

    def place(batches):
        for b in batches:
            c, at = laid.value, b.schema.names
            bucket = c.bucket(b.column(at.index("cell")).to_numpy(), b.column(at.index("row_id")).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket)], [*at, "bucket"])

    def home(batches):
        for b in batches:
            c = laid.value
            cell, _ = c.nearest(_matrix(b, features))
            bucket = c.bucket(cell, b.column(b.schema.names.index("row_id")).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x) for x in (cell, bucket, c.rows[cell] / c.parts[cell])]],
                                             [*b.schema.names, "cell", "bucket", "work"])
    tr_placed = tr.drop("r").mapInArrow(place, schema(tr.drop("r"), "bucket long"))
    own = te.mapInArrow(home, schema(te, "cell long, bucket long, work double"))
    own = own.select("*", F.col("bucket").alias("mine"), F.lit(float("inf")).alias("kth")).persist(StorageLevel.MEMORY_AND_DISK)
    own.count()                          # once, before the stages that read it side by side
    first = _meet(own, tr_placed, k, features, g, laid, first=True).checkpoint(eager=True)
    own.unpersist()

    def visit(batches):
        c = laid.value
        for b in batches:
            at = b.schema.names
            X, cell, mine = _matrix(b, features), b.column(at.index("cell")).to_numpy(), b.column(at.index("mine")).to_numpy()
            lists = b.column(at.index("d2"))
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)
            kth = np.full(len(X), np.inf)
            full = np.diff(off) >= k
            kth[full] = flat[off[1:][full] - 1]
            open_ = ~np.isfinite(kth)
            kth[open_] = c.reach(X[open_], k)
            held, n = [], 0

            def sent():
                row, bucket, work = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(row, kind="stable")
                some, owner = np.unique(row[order], return_inverse=True)      # a row's visits come at once
                take = pa.array(some)
                return pa.RecordBatch.from_arrays(
                    [*[b.column(at.index(x)).take(take) for x in g + ["row_id", "y"] + features + ["cell", "mine"]], pa.array(kth[some]),
                     _ragged(bucket[order], owner, len(some), pa.int64()), _ragged(work[order], owner, len(some), pa.float64())],
                    [*g, "row_id", "y", *features, "cell", "mine", "kth", "buckets", "works"])
            for rows, cells, need in c.visited(X, cell, kth):
                of = np.full(len(c.pivots), -1)
                of[cells] = np.arange(len(cells))
                units = np.flatnonzero(of[c.unit_cell] >= 0)
                row, unit = np.nonzero(need[:, of[c.unit_cell[units]]])
                row, unit = rows[row], units[unit]
                bucket = c.unit_bucket[unit]
                other = (c.unit_cell[unit] != cell[row]) | (bucket != mine[row])
                row, unit, bucket = row[other], unit[other], bucket[other]
                if not len(row):
                    continue
                # units are laid out by bucket: a (row, bucket) is a run
                head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
                held.append((row[head], bucket[head], np.add.reduceat(c.unit_rows[unit], head)))
                n += len(head)
                if n > BLOCK_ROWS:
                    yield sent()
                    held, n = [], 0
            if held:
                yield sent()
    base = first.select(*g, "row_id", "y", *features, "cell", "mine")
    # stored, a row once whatever it visits: read for the counts of buckets and for the rows
    visits = first.select(*base.columns, "d2").mapInArrow(visit, schema(base, "kth double, buckets array<long>, works array<double>")).checkpoint(eager=True)
    visits = visits.select(*base.columns, "kth", F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("works").alias("work"))))
    second = _meet(visits, tr_placed, k, features, g, laid, first=False)
    return first.select(*g, "row_id", "y", "nb_row", "nb_label", "d2").unionByName(second)


def vote(nb: DataFrame, weighted: bool = False, group: list[str] | None = None) -> DataFrame:
    """Majority (or 1/distance weighted) vote; ties -> lowest label.

    Weighted: if any neighbour sits at distance 0, only those neighbours vote.
    """
    g = (group or []) + ["row_id", "y"]
    if weighted:
        has0 = F.max((F.col("d2") == 0).cast("int")).over(Window.partitionBy(*g))
        w = F.when(has0 == 1, (F.col("d2") == 0).cast("double")).otherwise(1.0 / F.sqrt("d2"))
    else:
        w = F.lit(1.0)
    s = nb.withColumn("w", w).groupBy(*g, "nb_label").agg(F.sum("w").alias("score"))
    win = Window.partitionBy(*g).orderBy(F.col("score").desc(), F.col("nb_label"))
    return (s.withColumn("r", F.row_number().over(win)).where("r = 1")
            .select(*g, F.col("nb_label").cast("int").alias("p")))


def votes(nb: DataFrame, kinds: dict[str, tuple[int, bool]]) -> DataFrame:
    """(row_id, y, struct<p> per name, null without neighbours): the ``vote`` of each of
    ``kinds``, name -> (k, weighted), over the first k ranks of one neighbour table."""
    zero = F.col("d2") == 0
    sums = [F.max(zero).alias("has0")]            # of any rank: then of the first
    for name, (k, weighted) in kinds.items():
        known = F.col("rank") <= k
        if weighted:                              # summed for rows with and without a neighbour at 0
            sums += [F.sum(F.when(known, zero.cast("double"))).alias(f"{name}_0"),
                     F.sum(F.when(known, F.when(zero, 0.0).otherwise(1.0 / F.sqrt("d2")))).alias(name)]
        else:
            sums += [F.sum(F.when(known, 1.0)).alias(name)]
    s = nb.groupBy("row_id", "y", "nb_label").agg(*sums)

    def best(c):
        return F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("s"), (-F.col("nb_label")).alias("l")))).alias(c)
    s = s.groupBy("row_id", "y").agg(F.max("has0").alias("has0"), *[best(c) for c in s.columns if c not in ("row_id", "y", "nb_label", "has0")])

    def won(name, weighted):
        return F.when(F.col("has0"), F.col(f"{name}_0.l")).otherwise(F.col(f"{name}.l")) if weighted else F.col(f"{name}.l")
    return s.select("row_id", "y", *[F.when(F.col(name).isNotNull(), F.struct((-won(name, weighted)).cast("int").alias("p"))).alias(name)
                                     for name, (_, weighted) in kinds.items()])


def predictions(train: DataFrame, test: DataFrame, features: list[str], models: dict[str, "KNN"]) -> DataFrame:
    """(row_id, y, struct<p> per model): what each model predicts, from one neighbour table of
    the largest k; its first ranks are the neighbours of a smaller k."""
    nb = neighbours(train, test, features, max(m.k for m in models.values()))
    return votes(nb, {name: (m.k, m.weighted) for name, m in models.items()})


class KNN(Estimator):
    """Lazy learner: fit keeps the (already persisted) train frame."""

    def __init__(self, k: int = 5, weighted: bool = False):
        self.k, self.weighted = k, weighted
        self.params = {"n_neighbors": k, "weights": "distance" if weighted else "uniform", "metric": "euclidean"}

    def fit(self, train, ctx: Ctx):
        k, weighted, feats = self.k, self.weighted, ctx.features
        n_train = train.count()

        class _F(Fitted):
            size = "lazy (stores full training set)"

            def predict(self, df):
                nb = neighbours(train, df, feats, k, n_train=n_train)
                return vote(nb, weighted).select("row_id", "y", "p")
        return _F()
