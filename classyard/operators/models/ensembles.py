"""Meta and imbalance-aware ensembles: M45 voting_soft, M46 stacking,
M19 bagging_knn, M47 balanced_random_forest, M48 rusboost, M49 easy_ensemble,
M50 balanced_bagging.

Replicates are key columns produced by the samplers (P1-P3); combining
members is a join on row_id plus an array average / vote -- never a driver
loop over rows.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classyard.functions.hashing import SEED, hash_key, hash_poisson
from classyard.operators.models import builtin, hist_tree, knn
from classyard.operators.models.base import Ctx, Estimator, Fitted
from classyard.operators.samplers import bootstrap, bootstrap_uniform, undersample


def _argmax_array(col: str):
    """Index of the largest array element (ties -> lowest index)."""
    return (F.array_position(F.col(col), F.array_max(F.col(col))) - 1).cast("int")


def _eq(c: int):
    """One-argument predicate (a two-argument lambda would receive the index)."""
    return lambda v: v == F.lit(c)


def _eq_col(c):
    return lambda v: v == c


def _avg_probs(frames: list[DataFrame], k: int) -> DataFrame:
    """Element-wise mean of prob arrays across members (join on row_id)."""
    base = frames[0].select("row_id", "y", F.col("prob").alias("p0"))
    for i, f in enumerate(frames[1:], 1):
        base = base.join(f.select("row_id", F.col("prob").alias(f"p{i}")), "row_id")
    n = len(frames)
    avg = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                      lambda j: reduce(lambda a, b: a + b, [F.col(f"p{i}")[j] for i in range(n)]) / n)
    return base.select("row_id", "y", avg.alias("prob"))


def _forest(n_trees: int):
    """The registry's random forest with its own number of trees."""
    return hist_tree.GiniForest(n_trees, sample="bootstrap")


def _histgbm(n_rounds: int):
    """The registry's histogram boosting with its own number of rounds."""
    return hist_tree.HistGBM(n_rounds=n_rounds, lr=0.1, depth=None, policy="leaves", max_leaves=31, min_child_weight=1e-3,
                             min_child_samples=20, hess_scale=1.0, lam=0.0, prior=True)


class VotingSoft(Estimator):
    """Mean class probability of RF(150), histogram boosting(150), logreg."""

    def __init__(self, n_trees: int = 150, n_rounds: int = 150):
        self.members = [lambda: _forest(n_trees), lambda: _histgbm(n_rounds), lambda: builtin.logreg()]
        self.params = {"voting": "soft", "estimators": "rf,hgb,lr", "n_trees": n_trees, "n_rounds": n_rounds}

    def fit(self, train, ctx: Ctx):
        fitted = [m().fit(train, ctx) for m in self.members]
        k = ctx.k

        class _F(Fitted):
            size = f"{len(fitted)} base estimators"

            def predict(self, df):
                avg = _avg_probs([f.proba(df) for f in fitted], k)
                return avg.select("row_id", "y", _argmax_array("prob").alias("p"))

            def proba(self, df):
                return _avg_probs([f.proba(df) for f in fitted], k)
        return _F()


class Stacking(Estimator):
    """Out-of-fold probabilities of the base models (hashed folds) feed a
    balanced logistic regression."""

    def __init__(self, folds: int = 5, n_trees: int = 150, n_rounds: int = 150):
        self.folds = folds
        self.base = [lambda: _forest(n_trees), lambda: _histgbm(n_rounds), lambda: _KnnProba(5)]
        self.params = {"cv": folds, "final_estimator": "logreg", "estimators": "rf,hgb,knn5"}

    def fit(self, train, ctx: Ctx):
        k, nb = ctx.k, len(self.base)
        # hashed folds: independent of partitioning, stratified in expectation, and no
        # class-wide window (a class may hold a third of all rows)
        fold = F.pmod(F.conv(F.substring(hash_key(ctx.seed, "'fold'", "row_id"), 1, 8), 16, 10).cast("long"),
                      F.lit(self.folds))
        tr = train.withColumn("fold", fold).persist()
        meta_cols = [f"m{b}_{c}" for b in range(nb) for c in range(k)]

        def stack(frames):
            j = frames[0].select("row_id", "y", *[F.col("prob")[c].alias(f"m0_{c}") for c in range(k)])
            for b, f in enumerate(frames[1:], 1):
                j = j.join(f.select("row_id", *[F.col("prob")[c].alias(f"m{b}_{c}") for c in range(k)]), "row_id")
            return j.withColumnRenamed("y", "label")
        oof = None
        for fo in range(self.folds):
            fit_part, hold = tr.where(F.col("fold") != fo), tr.where(F.col("fold") == fo)
            part = stack([m().fit(fit_part, ctx).proba(hold) for m in self.base])
            oof = part if oof is None else oof.unionByName(part)
        oof = oof.checkpoint(eager=True)
        final = builtin.logreg().fit(oof, Ctx(meta_cols, k, ctx.seed))
        full = [m().fit(tr, ctx) for m in self.base]
        tr.unpersist()

        class _F(Fitted):
            size = f"{nb} base estimators"

            def predict(self, df):
                return final.predict(stack([f.proba(df) for f in full]))
        return _F()


class _KnnProba(knn.KNN):
    """kNN with class-share probabilities (for stacking)."""

    def fit(self, train, ctx):
        fm = super().fit(train, ctx)
        k, K, feats = self.k, ctx.k, ctx.features

        def proba(df):
            nb = knn.neighbours(train, df, feats, k)
            cnt = nb.groupBy("row_id", "y").agg(F.collect_list("nb_label").alias("ls"))
            return cnt.select("row_id", "y", F.transform(F.sequence(F.lit(0), F.lit(K - 1)),
                                                         lambda c: F.size(F.filter("ls", _eq_col(c))) / k).alias("prob"))
        fm.proba = proba
        return fm


class BaggingKNN(Estimator):
    """15 bootstrap replicates of kNN(5), averaged replicate votes.

    A replicate draws train rows (P1: a row ``w`` times, by a hash), so its neighbours are
    among the nearest train rows: one search over all of them serves every replicate.  A test
    row is settled if each replicate finds its k copies nearer than the last row of the list,
    or the list holds every train row.  The others are searched again with a longer list, and
    rows with ever more ties in one neighbour job keyed by replicate."""

    def __init__(self, n_rep: int = 15, k: int = 5):
        self.n_rep, self.k = n_rep, k
        self.params = {"n_estimators": n_rep, "n_neighbors": k, "bootstrap": True}

    def _draws(self, train: DataFrame, seed: int) -> DataFrame:
        """(drawn, w0, w1 ...): how often each replicate draws a train row; hashed once a row."""
        ws = [f"w{r}" for r in range(self.n_rep)]
        u = train.select(F.col("row_id").alias("drawn")).distinct()
        u = u.select("drawn", *[bootstrap_uniform(seed, F.lit(r), "drawn").alias(w) for r, w in enumerate(ws)])
        return u.select(F.col("drawn").cast("long").alias("drawn"), *[hash_poisson(F.col(w), 1.0).alias(w) for w in ws])

    def _members(self, nb: DataFrame, n_nb: int, draws: DataFrame) -> DataFrame:
        """(row_id, y, nb_label, settled, votes) from the ``n_nb`` nearest train rows; all
        windows and groups are those of ``row_id``: one shuffle and one sort."""
        R, k = self.n_rep, self.k
        ws, less = [f"w{r}" for r in range(R)], [f"less{r}" for r in range(R)]
        one, upto, ties = Window.partitionBy("row_id"), Window.partitionBy("row_id").orderBy("d2"), Window.partitionBy("row_id", "d2")
        nb = nb.join(draws, F.col("nb_row").eqNullSafe(F.col("drawn")))
        nb = nb.select("row_id", "y", "nb_row", "nb_label", "d2", F.max(F.when(F.col("rank") == n_nb, F.col("d2"))).over(one).alias("last"), *ws)
        # copies at a smaller distance: a row behind k of them is no neighbour in that replicate
        nb = nb.select("*", *[(F.sum(w).over(upto) - F.sum(w).over(ties)).alias(x) for w, x in zip(ws, less)])
        each = F.array(*[F.struct(F.lit(r).alias("replicate"), F.col(w).alias("w"), F.col(x).alias("less")) for r, (w, x) in enumerate(zip(ws, less))])
        each = F.filter(each, lambda s: (s["w"] > 0) & (s["less"] < k))
        c = (nb.select("row_id", "y", "nb_row", "nb_label", "d2", "last", F.inline(each))
             .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w"))))
             .withColumn("copy_id", F.xxhash64("nb_row", "copy")))
        first = Window.partitionBy("row_id", "replicate").orderBy("d2", "copy_id")
        c = c.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
        near = F.sum((F.col("d2") < F.col("last")).cast("int")).over(one)
        c = c.withColumn("settled", F.col("last").isNull() | (near == R * k))
        return c.groupBy("row_id", "y", "nb_label", "settled").agg(F.count(F.lit(1)).alias("votes"))

    def fit(self, train, ctx: Ctx):
        R, k, feats, members = self.n_rep, self.k, ctx.features, self._members
        train = train.select("row_id", "label", *feats)
        n = train.count()
        draws = self._draws(train, ctx.seed).persist()

        def by_replicate(te):
            boot = bootstrap(train, R, ctx.seed)
            # a copy's id is a hash of (row, copy): any packing into one long overflows wide ids
            boot = (boot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w"))))
                    .withColumn("row_id", F.xxhash64("row_id", "copy")).drop("w", "copy"))
            te = te.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(R - 1))))
            nb = knn.neighbours(boot, te, feats, k, n_train=n, extra_group="replicate")
            return nb.groupBy("row_id", "y", "nb_label").agg(F.count(F.lit(1)).alias("votes"))

        class _F(Fitted):
            size = f"{R} base estimators"

            def predict(self, df):
                todo, votes = df.select("row_id", "label", *feats), []
                # lists: 6 k + 2 rows hold k copies in each of 15 replicates but once in 10^9
                for n_nb in (6 * k + 2, 8 * (6 * k + 2)):
                    nb = knn.neighbours(train, todo, feats, n_nb, n_train=n)
                    found = members(nb, n_nb, draws).checkpoint(eager=True).where("settled").drop("settled")
                    votes.append(found)
                    done = found.select(F.col("row_id").alias("done")).distinct()
                    todo = todo.join(done, F.col("row_id").eqNullSafe(F.col("done")), "left_anti").checkpoint(eager=True)
                    if todo.isEmpty():
                        break
                else:
                    votes.append(by_replicate(todo))
                tot = reduce(DataFrame.unionByName, votes)
                w = Window.partitionBy("row_id").orderBy(F.col("votes").desc(), F.col("nb_label"))
                return (tot.withColumn("r", F.row_number().over(w)).where("r = 1")
                        .select("row_id", "y", F.col("nb_label").cast("int").alias("p")))
        return _F()


class ReplicateVote(Estimator):
    """Members fit on per-replicate samples, combined by majority vote.

    ``sampler`` 'under' = P2 class-balanced under-sampling (M49 easy_ensemble,
    M50 balanced_bagging)."""

    def __init__(self, member, n_rep: int, sampler: str = "under", **params):
        self.member, self.n_rep, self.sampler = member, n_rep, sampler
        self.params = dict(n_estimators=n_rep, sampler=sampler, **params)

    def fit(self, train, ctx: Ctx):
        samples = undersample(train, self.n_rep, ctx.seed).persist()
        fitted = [self.member().fit(samples.where(F.col("replicate") == r).drop("replicate"), ctx)
                  for r in range(self.n_rep)]
        samples.unpersist()

        class _F(Fitted):
            size = f"{len(fitted)} base estimators"

            def predict(self, df):
                preds = [f.predict(df).select("row_id", "y", F.col("p").alias(f"p{i}")) for i, f in enumerate(fitted)]
                j = reduce(lambda a, b: a.join(b.drop("y"), "row_id"), preds)
                votes = F.array(*[F.col(f"p{i}") for i in range(len(fitted))])
                counts = F.array(*[F.size(F.filter(votes, _eq(c))) for c in range(ctx.k)])
                return j.select("row_id", "y", counts.alias("cnt")).select("row_id", "y", _argmax_array("cnt").alias("p"))
        return _F()


class RUSBoost(builtin.AdaBoostSAMME):
    """SAMME boosting where every round fits on a fresh P2 under-sample."""

    def __init__(self, n_rounds: int = 100, lr: float = 1.0):
        super().__init__(n_rounds, lr)
        self.params = {"n_estimators": n_rounds, "learning_rate": lr, "sampling_strategy": "auto", "replacement": False}
        self.resample = True
