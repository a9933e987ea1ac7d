"""Table scans and source concatenation."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; downstream projections prune columns and push filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Header CSV.  An explicit schema avoids the inference pass; hex-like
    payload columns must be declared as string so they are never re-typed.
    ``options``: the reader's (quote, escape, sep ...)."""
    r = spark.read.option("header", True).options(**options)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def concat_sources(*dfs: DataFrame) -> DataFrame:
    """Row-wise union by column name; columns missing on one side become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
