"""Analytics on hand-made result records (FIXTURES §5): 6 ok models on two
datasets, one model failed on one dataset only, one constant metric column."""
import pytest
from pyspark.sql import functions as F

from classyard.operators import analytics as A
from classyard.sources.results import RESULT_SCHEMA


def records(spark):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(RESULT_SCHEMA)
    rows = []
    models = [("m1", "linear", 0.9, 0.95, 1.0), ("m2", "tree", 0.8, 0.9, 2.0), ("m3", "boosting", 0.7, 0.85, 3.0),
              ("m4", "instance", 0.6, 0.8, 4.0), ("m5", "interpretable", 0.5, 0.7, 5.0), ("m6", "weird", 0.4, 0.6, 6.0)]
    for ds, classes in (("a", ["x", "y"]), ("b", ["p", "q", "r"])):
        for key, fam, f1m, f1w, t in models:
            pc = [{"class": c, "precision": 0.5, "recall": 0.5, "f1": f1m / (i + 1), "support": 10 * (i + 1)}
                  for i, c in enumerate(classes)]
            rows.append(dict(dataset=ds, status="ok", name=key.upper(), key=key, category="ml", family=fam,
                             description="", hyperparams={}, subsample_cap=None, train_time_sec=t,
                             inference_time_sec=1.0, inference_time_per_sample_ms=0.01,   # constant column
                             accuracy=f1w, precision_macro=f1m, recall_macro=f1m, f1_macro=f1m,
                             precision_weighted=f1w, recall_weighted=f1w, f1_weighted=f1w,
                             confusion_matrix=[[1] * len(classes)] * len(classes), class_names=classes,
                             per_class=pc, classification_report="", model_size="n/a", n_train_samples=100,
                             n_test_samples=40, n_features=3, error=None))
    rows.append(dict(dataset="b", status="failed", name="M7", key="m7", category="ml", family="kernel", description="",
                     hyperparams={}, error="boom"))
    rows.append(dict(dataset="a", status="ok", **{k: v for k, v in rows[0].items() if k not in ("dataset", "status", "key", "name")},
                     key="m7", name="M7"))
    return spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in rows], schema)


def test_failed_on_one_dataset_vanishes_from_combined(spark):
    rec = records(spark)
    comb = A.combine(A.dataset_scores(rec), "a", "b")
    keys = {r["key"] for r in comb.collect()}
    assert "m7" not in keys and len(keys) == 6


def test_constant_column_normalises_to_zero_without_error(spark):
    rec = records(spark)
    s = A.dataset_scores(rec).where("dataset = 'a'")
    # infer ms is constant: its inverted min-max term is 1 for every model
    top = s.orderBy(F.col("composite_score").desc()).first()
    assert top["key"] in ("m1", "m7")
    assert all(r["cost_score"] >= 65.0 - 1e-9 for r in s.collect())


def test_rarest_class_and_header(spark):
    rec = records(spark)
    assert {r["dataset"]: r["rare_class"] for r in A.rarest_class(rec).collect()} == {"a": "x", "b": "p"}
    h = {r["dataset"]: r for r in A.dataset_header(rec).collect()}
    assert h["b"]["n_models_failed"] == 1 and h["b"]["n_models_attempted"] == 7
    assert h["a"]["classes"] == "x,y"


def test_group_map_unknown_is_exotic_and_best_fast(spark):
    rec = records(spark)
    g = {r["key"]: r["group"] for r in A.speed_quality_points(rec).where("dataset = 'a'").collect()}
    assert g["m6"] == "exotic" and g["m1"] == "linear"
    bf = {r["dataset"]: r["key"] for r in A.best_fast(rec).collect()}
    assert bf == {"a": "m1", "b": "m1"}


def test_dynamic_sort_nulls_last(spark):
    rec = records(spark)
    s = A.dynamic_sort(rec.where("dataset = 'b'"), "f1_macro", ascending=True).orderBy("position").collect()
    assert s[-1]["key"] == "m7"          # failed run (null metric) sorts last
    assert s[0]["key"] == "m6"


def test_failing_model_becomes_failed_record(spark):
    """An estimator that raises yields a failed record; the run goes on."""
    from classyard.operators.models.base import Estimator, ModelSpec
    from classyard.operators.models.registry import REGISTRY
    from classyard.operators.prep import prepare
    from classyard.plans.benchmark import result_records, run_models
    from classyard.sources import standins

    class Boom(Estimator):
        def fit(self, train, ctx):
            raise RuntimeError("x" * 800)

    rd = standins.evt(spark, "/root/testdata/sf0.001")
    prep = prepare(rd.name, rd.raw, rd.features, rd.benign)
    specs = [ModelSpec("boom", "Boom", "exotic", "", Boom), REGISTRY["nearest_centroid"]]
    pred, runs = run_models(spark, prep, specs)
    classes = prep.class_table(spark).selectExpr("'evt' AS dataset", "label", "class")
    rec = {r["key"]: r for r in result_records(pred, runs, classes).collect()}
    assert rec["boom"]["status"] == "failed" and len(rec["boom"]["error"]) == 500
    assert rec["boom"]["f1_macro"] is None
    assert rec["nearest_centroid"]["status"] == "ok" and rec["nearest_centroid"]["n_test_samples"] > 0
