"""The benchmark run: every registry entry on one prepared dataset.

Per model: optional row cap (F12), fit, predict (one forced action each, so
the timers measure real work), then all predictions of the run go through
one evaluation job (E1-E6) and become result records (S3 schema).  A model
that raises becomes a ``failed`` record (E8) instead of stopping the run.
"""
from __future__ import annotations

import sys
import time
import traceback

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classyard.operators import evaluate as ev
from classyard.operators.models.base import Ctx, ModelSpec
from classyard.operators.prep import Prepared, cap_rows

RUN_SCHEMA = ("dataset string, key string, name string, family string, description string, status string, "
              "hyperparams map<string,string>, subsample_cap int, train_time_sec double, "
              "inference_time_sec double, n_train_samples long, n_features int, model_size string, error string")


def run_models(spark: SparkSession, prep: Prepared, specs: list[ModelSpec],
               n_test: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit + predict every spec; returns (predictions, run records)."""
    train, test = prep.train(), prep.test()
    n_train_full = train.count()
    n_test = n_test if n_test is not None else test.count()
    ctx = Ctx(prep.features, prep.k)
    preds, runs = [], []
    for spec in specs:
        hp = {"subsample_cap": str(spec.subsample_cap), "seed": str(ctx.seed)}
        base = dict(dataset=prep.name, key=spec.key, name=spec.name, family=spec.family,
                    description=spec.description, subsample_cap=spec.subsample_cap,
                    n_features=len(prep.features))
        try:
            est = spec.build()
            hp.update({k: str(v) for k, v in {**spec.hyperparams, **getattr(est, "params", {})}.items()})
            tr = cap_rows(train, spec.subsample_cap) if spec.subsample_cap and n_train_full > spec.subsample_cap else train
            n_tr = min(n_train_full, spec.subsample_cap or n_train_full)
            t0 = time.time()
            fitted = est.fit(tr, ctx)
            t_fit = time.time() - t0
            t0 = time.time()
            p = (fitted.predict(test).select(F.lit(prep.name).alias("dataset"), F.lit(spec.key).alias("model"),
                                            "row_id", F.col("y").cast("int"), F.col("p").cast("int"))
                 .persist(StorageLevel.MEMORY_AND_DISK))
            p.count()
            t_inf = time.time() - t0
            preds.append(p)
            print(f"[run] {prep.name} {spec.key} fit={t_fit:.2f}s infer={t_inf:.2f}s", file=sys.stderr, flush=True)
            runs.append({**base, "status": "ok", "hyperparams": hp, "train_time_sec": t_fit,
                         "inference_time_sec": t_inf, "n_train_samples": n_tr,
                         "model_size": getattr(fitted, "size", "n/a"), "error": None})
        except Exception as e:  # E8: a failure is a record, not a crash
            msg = f"{type(e).__name__}: {e}"
            runs.append({**base, "status": "failed", "hyperparams": hp, "train_time_sec": None,
                         "inference_time_sec": None, "n_train_samples": None, "model_size": None,
                         "error": msg[:500]})
            traceback.print_exc()
    run_df = spark.createDataFrame(runs, RUN_SCHEMA)   # one row per registry entry
    pred = preds[0] if preds else None
    for p in preds[1:]:
        pred = pred.unionByName(p)
    if pred is not None:
        # lineage cut into the shared checkpoint folder: evaluation then reads a
        # flat table, and a lost executor does not re-run model scoring
        pred = pred.checkpoint(eager=True)
        for p in preds:
            p.unpersist()
    return pred, run_df.withColumn("n_test_samples", F.lit(n_test).cast("long"))


def result_records(pred: DataFrame | None, runs: DataFrame, classes: DataFrame, tables: dict | None = None) -> DataFrame:
    """Join run records with E1-E6 into the result-record table (ok + failed).
    ``tables``: what ``ev.evaluate`` made of the predictions, if that ran before."""
    from classyard.sources.results import RESULT_SCHEMA
    cols = [c.split(" ")[0] for c in RESULT_SCHEMA.split(", ")]
    if pred is None:
        ok = None
    else:
        e = tables or ev.evaluate(pred, classes)
        pc = (e["per_class"].groupBy("dataset", "model")
              .agg(F.array_sort(F.collect_list(F.struct("label", "class", "precision", "recall", "f1", "support"))).alias("a"))
              .select("dataset", "model",
                      F.transform("a", lambda s: F.struct(s["class"].alias("class"), s["precision"].alias("precision"),
                                                          s["recall"].alias("recall"), s["f1"].alias("f1"),
                                                          s["support"].alias("support"))).alias("per_class"),
                      F.transform("a", lambda s: s["class"]).alias("class_names")))
        rep = ev.report_text(ev.classification_report(e["per_class"]))
        m = (e["summary"].drop("n_test_samples").join(e["matrix"], ["dataset", "model"])
             .join(pc, ["dataset", "model"]).join(rep, ["dataset", "model"]))
        ok = runs.where("status = 'ok'").join(m.withColumnRenamed("model", "key"), ["dataset", "key"])
    failed = runs.where("status = 'failed'")
    out = failed if ok is None else ok.unionByName(failed, allowMissingColumns=True)
    out = ev.per_row_latency(out).withColumn("category", F.lit("ml"))
    for c in cols:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None))
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(RESULT_SCHEMA)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
