"""I1 on small fixtures: shuffled values and the number of passes."""
import pandas as pd
import numpy as np
from pyspark.sql import functions as F

from classyard.operators import evaluate as ev
from classyard.operators import importance as I


def test_shuffled_values_come_from_the_mapped_row(spark, monkeypatch):
    monkeypatch.setattr(I, "SHUFFLED", 40)               # several blocks
    n, feats, R = 53, ["f0", "f1"], 3
    pdf = pd.DataFrame({"pos": np.arange(n), "row_id": np.arange(n) * 7, "label": 0, "f0": np.arange(n) * 1.0, "f1": np.arange(n) * -1.0})
    s = spark.createDataFrame(pdf).withColumn("f1", F.when(F.col("pos") != 5, F.col("f1"))).repartition(4)
    maps = I._bijections(n, len(feats) * R, 1)
    got = {r["pos"]: r["xs"] for r in I.with_shuffled(s, feats, maps, R, n).collect()}
    assert len(got) == n
    for pos, xs in got.items():
        for jr, (a, b) in enumerate(maps):
            far = (a * pos + b) % n
            assert xs[jr] == (far if jr < R else None if far == 5 else -far)
    a, n = (1 << 39) - 7, (1 << 39) + 21                 # products beyond 63 bits
    x = np.array([0, 1, n - 1, n // 3], np.int64)
    assert I._times(a, x, 5, n).tolist() == [(a * int(v) + 5) % n for v in x]


def test_evaluation_reads_predictions_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    pred = spark.range(100).selectExpr("'a' AS dataset", "'m' AS model", "id AS row_id", "CAST(id % 3 AS INT) AS y", "CAST(id % 2 AS INT) AS p")
    pred = pred.mapInArrow(count, pred.schema)
    classes = spark.createDataFrame([("a", i, str(i)) for i in range(3)], "dataset string, label int, class string")
    e = ev.evaluate(pred, classes)
    assert e["cm"].agg(F.sum("n")).first()[0] == 100 and e["summary"].count() == 1
    assert seen.value == 100


def _toy(spark, n=240, d=3, K=3, more=()):
    rng = np.random.default_rng(6)
    y = rng.integers(0, K, n)
    x = np.round(rng.normal(size=(n, d)) + y[:, None] * 0.7, 1)             # with ties
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(n)] + list(more)
    return spark.createDataFrame(rows, "row_id long, label int, f0 double, f1 double, f2 double").repartition(3)


def test_shuffled_rows_are_dealt_to_all_cores(spark):
    df = I.dense_position(_toy(spark), "row_id", "pos")
    feats = ["f0", "f1", "f2"]
    out = I.with_shuffled(df, feats, I._bijections(240, 6, 1), 2, 240)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 240 and max(sizes) <= 120 and len(sizes) > 3


def test_scores_in_tasks_equal_predict(spark, monkeypatch):
    """A model that scores shuffled values in tasks gives what predict gives, and predict
    gets the rows themselves only; rows that are not finite go to predict."""
    from classyard.operators.models import hist_tree, stats
    from classyard.operators.models.base import Ctx, Fitted
    feats, n = ["f0", "f1", "f2"], 240
    for est in (stats.NearestCentroid(), hist_tree.GiniForest(7, sample="bootstrap")):
        df = _toy(spark).persist()
        fm = est.fit(df, Ctx(feats, 3))
        predict, sent = fm.predict, []
        fm.predict = lambda x, predict=predict, sent=sent: sent.append(x.count()) or predict(x)

        def scores(df):
            return [tuple(r) for r in I.permutation_importance(fm, df, feats, 3, n_repeats=2).orderBy("fi").collect()]
        fast = scores(df)
        assert sent == [n] and any(s for _, s in fast)
        with monkeypatch.context() as m:
            m.setattr(type(fm), "shuffled_scorer", Fitted.shuffled_scorer)
            assert scores(df) == fast
        sent.clear()
        if isinstance(est, stats.NearestCentroid):
            scores(_toy(spark, more=[(999, 1, float("nan"), 0.0, 0.0)]))
            assert max(sent) == (n + 1) * 6
