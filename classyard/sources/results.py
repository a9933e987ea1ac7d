"""Result-record sink, scan and per-dataset document merge."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "dataset string, status string, name string, key string, category string, family string, "
    "description string, hyperparams map<string,string>, subsample_cap int, "
    "train_time_sec double, inference_time_sec double, inference_time_per_sample_ms double, "
    "accuracy double, precision_macro double, recall_macro double, f1_macro double, "
    "precision_weighted double, recall_weighted double, f1_weighted double, "
    "confusion_matrix array<array<long>>, class_names array<string>, "
    "per_class array<struct<class:string,precision:double,recall:double,f1:double,support:long>>, "
    "classification_report string, model_size string, n_train_samples long, n_test_samples long, "
    "n_features int, error string")


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """S3: one document per (dataset, model); a re-run overwrites only the
    documents it produced (dynamic overwrite of dataset and key folders)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset", "key").format(fmt).save(path))


def read_results(spark: SparkSession, path: str, fmt: str = "json", status: str | None = "ok") -> DataFrame:
    """Scan with the fixed schema (no inference pass); ``dataset`` and ``key``
    come from the partition folders, so filters on them prune folders."""
    schema = ", ".join(p for p in RESULT_SCHEMA.split(", ") if not p.startswith(("dataset ", "key "))) + ", dataset string, key string"
    df = spark.read.schema(schema).format(fmt).load(path)
    return df.where(F.col("status") == status) if status else df


def merge_documents(importance: DataFrame, binary: DataFrame) -> DataFrame:
    """Fold the importance table and the binary view into one JSON document
    per dataset (grouped by the dataset key: one small row per dataset)."""
    imp = importance.groupBy("dataset").agg(
        F.to_json(F.collect_list(F.struct(*[c for c in importance.columns if c != "dataset"]))).alias("feature_selection"))
    mvb = binary.groupBy("dataset").agg(
        F.to_json(F.collect_list(F.struct(*[c for c in binary.columns if c != "dataset"]))).alias("malicious_vs_benign"))
    return imp.join(mvb, "dataset", "full")
