"""Stand-in classification datasets built from the driver's tables.

Each builder returns ``raw(row_id long, cls string, f_* double)`` plus the
ordered feature names and the benign class.  The raw frames are lazy scans
with only the needed columns, so parquet column pruning applies.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classyard.functions.exprs import LETTERS, letter_share_columns
from classyard.functions.hashing import hash_id

# lineitem has no single-column key; (orderkey, partkey, suppkey, linenumber) is unique
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
from classyard.sources.tables import read_table


@dataclass
class RawDataset:
    name: str
    raw: DataFrame
    features: list[str]
    benign: str


def letter_features() -> list[str]:
    return [f"f_{i:02d}" for i in range(len(LETTERS))]


def lang(spark: SparkSession, sf_dir: str) -> RawDataset:
    """documents.lang from letter shares; benign = 'en'."""
    d = read_table(spark, sf_dir, "documents")
    raw = d.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("cls"), *letter_share_columns("text"))
    return RawDataset("lang", raw, letter_features(), "en")


def _doc_labels(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    lab = read_table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id")


def qual(spark: SparkSession, sf_dir: str) -> RawDataset:
    """labels.quality (0/1) from letter shares + n_chars; benign = '1'."""
    j = _doc_labels(spark, sf_dir)
    feats = letter_features() + ["f_nchars"]
    raw = j.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("cls"),
                   *letter_share_columns("text"), F.col("n_chars").cast("double").alias("f_nchars"))
    return RawDataset("qual", raw, feats, "1")


def tox(spark: SparkSession, sf_dir: str) -> RawDataset:
    """quality x toxic as four classes 'q0_t0'..'q1_t1'; benign = 'q1_t0'."""
    j = _doc_labels(spark, sf_dir)
    feats = letter_features() + ["f_nchars"]
    cls = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("_t"), F.col("toxic").cast("string"))
    raw = j.select(F.col("doc_id").alias("row_id"), cls.alias("cls"),
                   *letter_share_columns("text"), F.col("n_chars").cast("double").alias("f_nchars"))
    return RawDataset("tox", raw, feats, "q1_t0")


EMB_DIM = 64


def emb(spark: SparkSession, sf_dir: str) -> RawDataset:
    """embeddings.label from the 64 embedding dimensions; benign = '0'."""
    e = read_table(spark, sf_dir, "embeddings")
    feats = [f"f_{i:02d}" for i in range(EMB_DIM)]
    raw = e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("cls"),
                   *[F.col("embedding")[i].cast("double").alias(feats[i]) for i in range(EMB_DIM)])
    return RawDataset("emb", raw, feats, "0")


def line(spark: SparkSession, sf_dir: str) -> RawDataset:
    """lineitem.l_returnflag from quantity/price/discount/tax + one-hot linestatus; benign = 'N'."""
    li = read_table(spark, sf_dir, "lineitem")
    feats = ["f_qty", "f_price", "f_disc", "f_tax", "f_ls_F", "f_ls_O"]
    raw = li.select(
        hash_id(*LINE_KEY).alias("row_id"),
        F.col("l_returnflag").alias("cls"),
        F.col("l_quantity").alias("f_qty"), F.col("l_extendedprice").alias("f_price"),
        F.col("l_discount").alias("f_disc"), F.col("l_tax").alias("f_tax"),
        # F7 one-hot with the fixed level set of l_linestatus
        *[F.coalesce((F.col("l_linestatus") == v).cast("double"), F.lit(0.0)).alias(f"f_ls_{v}") for v in ("F", "O")])
    return RawDataset("line", raw, feats, "N")


def evt(spark: SparkSession, sf_dir: str) -> RawDataset:
    """events.event_type from value, props.k, hour, weekday; benign = 'view'."""
    ev = read_table(spark, sf_dir, "events")
    feats = ["f_value", "f_k", "f_hour", "f_dow"]
    raw = ev.select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("cls"),
        F.coalesce(F.col("value"), F.lit(0.0)).alias("f_value"),
        F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("f_k"),
        F.hour("ts").cast("double").alias("f_hour"),
        (F.dayofweek("ts") - 1).cast("double").alias("f_dow"))
    return RawDataset("evt", raw, feats, "view")


BUILDERS = {"lang": lang, "qual": qual, "tox": tox, "emb": emb, "line": line, "evt": evt}


def load(spark: SparkSession, sf_dir: str, name: str) -> RawDataset:
    return BUILDERS[name](spark, sf_dir)
