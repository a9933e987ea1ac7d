"""Reading tables and shared scratch tables for the pipeline operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from classyard.session import checkpoint_dir

#: ASCII white space of all contracts: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    base = checkpoint_dir(spark) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the
    lineage, so a lost executor costs a re-read and not a re-computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_words(text: Column) -> Column:
    """Array of words (runs of non-white characters); null text has none."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.split(t, WHITE_CLASS + "+"), lambda w: w != "")
