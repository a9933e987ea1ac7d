"""Flagship query: the minimum end-to-end slice.

documents -> letter shares -> label encode -> exact stratified split ->
population-std scaling -> nearest centroid -> predictions -> E1-E6 ->
one result record (S3 schema).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from classyard.operators.models.registry import specs
from classyard.operators.prep import prepare
from classyard.plans.benchmark import result_records, run_models
from classyard.sources import standins


def flagship(spark: SparkSession, sf_dir: str, models: list[str] | None = None) -> DataFrame:
    rd = standins.load(spark, sf_dir, "lang")
    prep = prepare(rd.name, rd.raw, rd.features, rd.benign)
    pred, runs = run_models(spark, prep, specs(models or ["nearest_centroid"]))
    classes = prep.class_table(spark).selectExpr(f"'{prep.name}' AS dataset", "label", "class")
    return result_records(pred, runs, classes)
