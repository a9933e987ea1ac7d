"""Feature importance and selection: I1-I9.

Filter methods (I6 mutual information, I7 ANOVA F) unpivot the feature
columns into (feature, value) pairs inside the scan and aggregate per
(feature, bin/label): partial aggregation keeps the shuffle at
features x bins x 2 rows whatever the row count.  Permutation importance
(I1) scores every (feature, repeat) permutation of the evaluation sample in
one prediction job and one grouped metric aggregate.
"""
from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classyard.functions.hashing import SEED
from classyard.operators import evaluate as ev
from classyard.operators.ranking import dense_position

MI_BINS = 16
SHUFFLED = 2_000_000  # shuffled values of a block of rows
BLOCKS = 4            # blocks per core at least
PART_SPACE = 2        # partitions per block, for blocks are dealt by hash


def _long(df: DataFrame, feats: list[str], label: str = "label") -> DataFrame:
    """Unpivot to (label, feature index, value) without materialising a copy."""
    arr = F.array(*[F.struct(F.lit(i).alias("fi"), F.col(f).cast("double").alias("x")) for i, f in enumerate(feats)])
    return df.select(F.col(label).alias("y"), F.explode(arr).alias("kv")).select("y", "kv.fi", "kv.x")


def anova_f(df: DataFrame, feats: list[str], label: str = "label") -> DataFrame:
    """One-way ANOVA F per feature vs the label; NaN (zero within-variance) -> 0."""
    # one row per class with all sums; only those K rows are unpivoted
    wide = df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.sum(F.col(f).cast("double")).alias("s"), F.sum(F.col(f).cast("double") * F.col(f)).alias("ss")).alias(f"a{i}")
        for i, f in enumerate(feats)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("fi"), F.col(f"a{i}.s").alias("s"), F.col(f"a{i}.ss").alias("ss"))
                               for i in range(len(feats))]))
    g = wide.select("y", "n", each.alias("e")).select("y", "n", "e.fi", "e.s", "e.ss")
    t = g.groupBy("fi").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"), F.sum("ss").alias("ss_all"),
                            F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b_all"))
    ssb = F.col("b_all") - F.col("s_all") * F.col("s_all") / F.col("n_all")
    ssw = F.col("ss_all") - F.col("b_all")
    fstat = (ssb / (F.col("k") - 1)) / (ssw / (F.col("n_all") - F.col("k")))
    return t.select("fi", F.when(ssw > 0, fstat).otherwise(0.0).alias("score"))


def mutual_info_binned(df: DataFrame, feats: list[str], label: str = "label", bins: int = MI_BINS) -> DataFrame:
    """I6 (binned estimator): equal-width bins between the train min and max."""
    rng = df.agg(*[x for f in feats for x in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))]).first()
    lo = F.element_at(F.array(*[F.lit(float(rng[f"lo_{f}"])) for f in feats]), F.col("fi") + 1)
    hi = F.element_at(F.array(*[F.lit(float(rng[f"hi_{f}"])) for f in feats]), F.col("fi") + 1)
    b = F.when(hi == lo, 0).otherwise(F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins), F.lit(bins - 1)))
    c = _long(df, feats, label).withColumn("b", b).groupBy("fi", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    w_f = Window.partitionBy("fi")
    c = (c.withColumn("tot", F.sum("n").over(w_f))
         .withColumn("nb", F.sum("n").over(Window.partitionBy("fi", "b")))
         .withColumn("ny", F.sum("n").over(Window.partitionBy("fi", "y"))))
    term = (F.col("n") / F.col("tot")) * F.log((F.col("n").cast("double") * F.col("tot")) /
                                              (F.col("nb").cast("double") * F.col("ny")))
    return c.groupBy("fi").agg(F.sum(term).alias("score"))


def top_k(scores: DataFrame, feats: list[str], k: int = 15) -> DataFrame:
    """Normalise by the total over *all* features, then keep the k largest
    (ties: higher feature index first, as a reversed ascending order)."""
    total = F.sum("score").over(Window.partitionBy())
    norm = F.when(total > 0, F.col("score") / total).otherwise(F.col("score"))
    names = F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("fi") + 1)
    w = Window.orderBy(F.col("importance").desc(), F.col("fi").desc())
    return (scores.select("fi", names.alias("feature"), norm.alias("importance"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def filter_tables(scores: dict[str, DataFrame], feats: list[str], k: int = 10) -> DataFrame:
    """The top k features of several filter methods, one below the other."""
    out = None
    for method, s in scores.items():
        t = top_k(s, feats, k).select(F.lit(method).alias("method"), "feature", "importance", "rank")
        out = t if out is None else out.unionByName(t)
    return out


def additive_importance(fitted, df: DataFrame, feats: list[str]) -> DataFrame:
    """I4: mean over rows and classes of the absolute centred contribution of
    each feature's shape function, for boosters whose trees use one feature
    each.  Contributions depend on the feature's bin only, so the rows are
    reduced to counts per (feature, bin) first."""
    from classyard.operators.models.hist_tree import binned, route
    d, K = len(feats), fitted.K
    b = binned(df.select("row_id", "label", *feats), feats, fitted.edges)
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("fi"), F.col(f"b_{j}").alias("bin")) for j in range(d)]))
    counts = b.select(pairs.alias("p")).groupBy("p.fi", "p.bin").agg(F.count(F.lit(1)).alias("n")).collect()   # d x bins rows
    bins = max(len(e) for e in fitted.edges) + 1
    shape = np.zeros((d, bins, K))
    for trees in fitted.forest:
        for t, (arrays, value) in enumerate(trees):
            used = set(arrays[0][arrays[0] >= 0].tolist())
            if len(used) != 1:
                continue
            j = used.pop()
            grid = np.zeros((bins, d), np.int64)
            grid[:, j] = np.arange(bins)
            shape[j, :, t] += value[route(grid, arrays)]
    n = np.zeros((d, bins))
    for r in counts:
        n[r["fi"], r["bin"]] = r["n"]
    total = np.maximum(n.sum(axis=1), 1)[:, None]
    mean = np.einsum("jb,jbk->jk", n, shape) / total
    score = (np.einsum("jb,jbk->jk", n, np.abs(shape - mean[:, None, :])) / total).mean(axis=1)
    return df.sparkSession.createDataFrame([(j, float(s)) for j, s in enumerate(score)], "fi int, score double")


def overlap(a: DataFrame, b: DataFrame, k: int = 5) -> int:
    """Size of the intersection of two top-k feature sets (as a DataFrame count)."""
    return (a.where(F.col("rank") <= k).select("feature")
            .intersect(b.where(F.col("rank") <= k).select("feature")))


def _bijections(n: int, count: int, seed: int) -> list[tuple[int, int]]:
    """``count`` affine bijections x -> (a x + b) mod n of 0 ... n-1, by hash."""
    out = []
    for i in range(count):
        h = hashlib.md5(f"{seed}|{i}".encode()).digest()
        a, b = int.from_bytes(h[:8], "big") % n, int.from_bytes(h[8:], "big") % n
        while math.gcd(a, n) != 1:
            a = (a + 1) % n
        out.append((a, b))
    return out


def _times(a: int, x: np.ndarray, b: int, n: int) -> np.ndarray:
    """(a x + b) mod n for 0 <= a, x < n < 2^40, in parts that stay below 2^63."""
    high, low = divmod(a, 1 << 20)
    return ((((high * x) % n) << 20) + low * x + b % n) % n


def with_shuffled(s: DataFrame, feats: list[str], maps: list[tuple[int, int]], n_repeats: int, n: int) -> DataFrame:
    """Rows of ``s`` (numbered by ``pos``) with an array ``xs``: for each map (a, b) of a
    feature and repeat, that feature of the row at (a pos + b) mod n.

    Only values move: a task packs those for one block of positions into one row, and a
    block's task puts them beside its rows."""
    cores = s.sparkSession.sparkContext.defaultParallelism
    size = max(1, min(SHUFFLED // len(maps), -(-n // (BLOCKS * cores))))             # rows of a block
    back = [(pow(a, -1, n), b) for a, b in maps]

    def send(batches):
        for batch in batches:
            pos = batch.column(0).to_numpy()
            to = np.stack([_times(a, (pos - b) % n, 0, n) for a, b in back])      # (map, row) -> position
            cols = [batch.column(1 + jr // n_repeats) for jr in range(len(maps))]
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in cols]).ravel()
            null = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in cols]).ravel()
            block = (to // size).ravel()
            code = (to % size + np.arange(len(maps))[:, None] * size).ravel().astype(np.int32)
            order = np.argsort(block, kind="stable")
            block, head = np.unique(block[order], return_index=True)
            off = pa.array(np.append(head, len(order)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.ListArray.from_arrays(off, pa.array(code[order])),
                 pa.ListArray.from_arrays(off, pa.array(x[order].astype(np.float64), mask=null[order]))], ["block", "code", "x"])

    def put(rows: pa.Table, sent: pa.Table) -> pa.Table:
        code = pa.concat_arrays([c.flatten() for c in sent["code"].chunks]).to_numpy()
        x = pa.concat_arrays([c.flatten() for c in sent["x"].chunks])
        value, null = np.zeros((size, len(maps))), np.zeros((size, len(maps)), bool)
        value[code % size, code // size] = x.fill_null(0.0).to_numpy()
        null[code % size, code // size] = x.is_null().to_numpy(zero_copy_only=False)
        at = rows["pos"].to_numpy() % size
        off = pa.array((np.arange(len(at) + 1) * len(maps)).astype(np.int32))
        xs = pa.ListArray.from_arrays(off, pa.array(value[at].ravel(), mask=null[at].ravel()))
        return rows.drop_columns("block").append_column("xs", xs)
    sent = s.select("pos", *[F.col(f).cast("double") for f in feats]).mapInArrow(send, "block long, code array<int>, x array<double>")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema.fields) + ", xs array<double>"
    # by number: what follows multiplies the rows, so few blocks or parts put together would leave cores idle
    parts = PART_SPACE * -(-n // size)
    rows = s.withColumn("block", F.floor(F.col("pos") / size).cast("long")).repartition(parts, "block")
    return rows.groupBy("block").cogroup(sent.repartition(parts, "block").groupBy("block")).applyInArrow(put, schema)


def _scored_in_tasks(beside: DataFrame, feats: list[str], scorer, K: int, R: int) -> DataFrame:
    """(jr, y, p, n): counts of true and predicted class of each shuffle; shuffled rows
    exist in a task only."""
    m = len(feats) * R

    def score(batches):
        total = np.zeros((m, K, K), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            X = np.stack([b.column(1 + j).to_numpy(zero_copy_only=False) for j in range(len(feats))], axis=1).astype(np.float64)
            V = b.column(1 + len(feats)).flatten().to_numpy(zero_copy_only=False).reshape(len(X), m)
            y = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            p = scorer(X, V, R)
            total += np.bincount(((np.arange(m) * K + y[:, None]) * K + p).ravel(), minlength=m * K * K).reshape(m, K, K)
        jr, y, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in (jr, y, p)], pa.array(total[jr, y, p])], ["jr", "y", "p", "n"])
    found = beside.select("label", *[F.col(f).cast("double") for f in feats], "xs").mapInArrow(score, "jr int, y int, p int, n long")
    return found.groupBy("jr", "y", "p").agg(F.sum("n").alias("n"))


def permutation_importance(fitted, test: DataFrame, feats: list[str], k_classes: int,
                           n_repeats: int = 5, seed: int = SEED) -> DataFrame:
    """Drop in macro F1 when one feature is shuffled, averaged over repeats,
    clipped at 0, over all test rows.

    Rows are numbered once (``dense_position``).  The shuffled value of feature j
    in repeat r comes from the row at a hashed affine bijection of the position
    (``with_shuffled``: only values move, rows are copied after it).  All d x R
    shuffles are scored in tasks if the model can (``shuffled_scorer``) and all values are
    finite, else by one ``predict``; one grouped E2-E4 aggregate follows.
    """
    d, R = len(feats), n_repeats
    s = dense_position(test.select("row_id", "label", *feats), "row_id", "pos").persist()
    n = s.count()
    beside = with_shuffled(s, feats, _bijections(n, d * R, seed), R, n) if n else s.withColumn("xs", F.array().cast("array<double>"))
    basep = fitted.predict(s.drop("pos")).select(F.lit("perm").alias("dataset"), F.lit("base").alias("model"), "row_id", "y", "p")
    make = getattr(fitted, "shuffled_scorer", None)      # a model may have no more than ``predict``
    scorer = make(s.sparkSession.sparkContext) if make else None
    finite = [F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")) for f in feats]
    whole = reduce(lambda x, y: x & y, finite, F.col("label").isNotNull())
    if scorer is not None and s.where(~whole).isEmpty():
        p = _scored_in_tasks(beside, feats, scorer, k_classes, R).select(
            F.lit("perm").alias("dataset"), F.concat_ws(":", F.floor(F.col("jr") / R).cast("long"), F.col("jr") % R).alias("model"), "y", "p", "n")
        counts = p.unionByName(ev.confusion_counts(basep))
    else:
        perm = beside.select("pos", "label", *feats, F.posexplode("xs").alias("jr", "xv"))
        j = F.floor(F.col("jr") / R).cast("int")
        cols = [F.when(j == i, F.col("xv")).otherwise(F.col(f)).alias(f) for i, f in enumerate(feats)]
        # positions are dense, so the number of a (row, feature, repeat) fits a long
        perm = perm.select((F.col("pos") * (d * R) + F.col("jr")).alias("row_id"), "label", *cols)
        p = fitted.predict(perm).select(
            F.lit("perm").alias("dataset"),
            F.concat_ws(":", F.floor(F.col("row_id") / R).cast("long") % d, F.col("row_id") % R).alias("model"),
            "row_id", "y", "p")
        counts = ev.confusion_counts(p.unionByName(basep))
    counts = counts.checkpoint(eager=True)               # d x R x K x K rows
    classes = s.sparkSession.createDataFrame([("perm", i, str(i)) for i in range(k_classes)], "dataset string, label int, class string")
    e = ev.summary_metrics(ev.per_class(ev.confusion_long(None, classes, counts), classes)).select("model", "f1_macro")
    base_f1 = F.max(F.when(F.col("model") == "base", F.col("f1_macro"))).over(Window.partitionBy())
    drops = (e.withColumn("base_f1", base_f1).where(F.col("model") != "base")
             .select(F.split("model", ":")[0].cast("int").alias("fi"), (F.col("base_f1") - F.col("f1_macro")).alias("drop")))
    out = drops.groupBy("fi").agg(F.greatest(F.avg("drop"), F.lit(0.0)).alias("score")).checkpoint(eager=True)   # d rows
    s.unpersist()
    return out


def native_importance(model_fitted) -> np.ndarray | None:
    """Gain shares of trees, impurity importances or mean |coefficient| over
    classes."""
    if getattr(model_fitted, "importances", None) is not None:
        return np.asarray(model_fitted.importances)
    m = getattr(model_fitted, "model", None)
    if m is None:
        return None
    if hasattr(m, "featureImportances"):
        return np.asarray(m.featureImportances.toArray())
    if hasattr(m, "coefficientMatrix"):
        return np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
    return None


def family_panel(spark, prep, keys: list[str], n_repeats: int = 5) -> "DataFrame":
    """I8: for each representative model -- fit on all train rows, native
    importance (I2/I3) where the model has one, permutation importance (I1)
    -- as one long table (model, method, rank, feature, importance)."""
    from classyard.operators.models.base import Ctx
    from classyard.operators.models.registry import REGISTRY
    feats = prep.features
    out = None
    for key in keys:
        fm = REGISTRY[key].build().fit(prep.train(), Ctx(feats, prep.k))
        parts = []
        nat = native_importance(fm)
        if nat is not None:
            sc = spark.createDataFrame([(i, float(v)) for i, v in enumerate(nat)], "fi int, score double")
            parts.append(top_k(sc, feats).withColumn("method", F.lit("native")))
        perm = permutation_importance(fm, prep.test(), feats, prep.k, n_repeats)
        parts.append(top_k(perm, feats).withColumn("method", F.lit("permutation")))
        for p in parts:
            p = p.select(F.lit(key).alias("model"), "method", "rank", "feature", "importance")
            out = p if out is None else out.unionByName(p)
    return out
