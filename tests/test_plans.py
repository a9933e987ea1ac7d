"""Physical-plan checks: column pruning / filter pushdown reach the parquet
scan, the closed-form scorer stays in whole-stage codegen, and the split's
cut table is a broadcast (no shuffle join with the data)."""
from pyspark.sql import functions as F

from classyard.operators.models.base import Ctx
from classyard.operators.models.stats import NearestCentroid
from classyard.operators.prep import prepare
from classyard.sources import standins

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_letter_features_read_only_needed_columns(spark):
    rd = standins.lang(spark, SF)
    p = plan(rd.raw)
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p


def test_event_filter_pushed_to_scan(spark):
    rd = standins.evt(spark, SF)
    p = plan(rd.raw.where(F.col("row_id") > 100))
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,100)]" in p


def test_centroid_scoring_is_codegen_projection(spark):
    rd = standins.evt(spark, SF)
    prep = prepare(rd.name, rd.raw, rd.features, rd.benign)
    fm = NearestCentroid().fit(prep.train(), Ctx(prep.features, prep.k))
    out = fm.predict(prep.test())
    p = out._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert "Exchange" not in p            # scoring adds no shuffle: one projection
    assert "Project" in p and "ArrowEvalPython" not in p and "MapInPandas" not in p


def test_split_joins_cut_table_by_broadcast(spark):
    from classyard.operators.prep import label_encode, stratified_split
    rd = standins.evt(spark, SF)
    df = label_encode(rd.raw, "cls", ["click", "error", "purchase", "signup", "view"]).drop("cls")
    p = plan(stratified_split(df))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def _counting(monkeypatch, keys, n):
    """Stand-ins of registry models that note how many train rows they are given, on ``n`` of them."""
    from dataclasses import replace

    from classyard.operators.models.base import Estimator, Fitted
    from classyard.operators.models.registry import REGISTRY
    from classyard.operators.prep import Prepared
    from classyard.plans import queries
    seen = []

    class Counts(Estimator, Fitted):
        def fit(self, train, ctx):
            seen.append(train.count())
            return self

        def predict(self, df):
            return df.select("row_id", F.col("label").alias("y"), F.col("label").alias("p"))

    def prepared(spark, sf, ds):
        df = spark.range(n + 3).selectExpr("id AS row_id", f"IF(id < {n}, 'train', 'test') AS split", "CAST(id % 2 AS INT) AS label", "CAST(id AS DOUBLE) AS f0")
        return Prepared("lang", df, ["a", "b"], ["f0"])
    monkeypatch.setattr(queries, "prepared", prepared)
    for key in keys:
        monkeypatch.setitem(REGISTRY, key, replace(REGISTRY[key], build=Counts))
    return queries.Q, seen


def test_bagging_knn_is_fitted_on_all_train_rows(spark, monkeypatch):
    Q, seen = _counting(monkeypatch, ["bagging_knn"], 40_100)
    assert Q["bagging_knn_lang"](spark, "").count() == 3
    assert seen == [40_100]


def test_family_panel_is_fitted_on_all_train_rows(spark, monkeypatch):
    from classyard.session import checkpoint_dir
    checkpoint_dir(spark)
    Q, seen = _counting(monkeypatch, ["random_forest", "logreg", "knn5", "nearest_centroid"], 15_100)
    assert Q["i8_family_panel_lang"](spark, "").count() == 4
    assert seen == [15_100] * 4
