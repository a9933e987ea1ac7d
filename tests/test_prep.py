"""Scalar parsers (FIXTURES §1 edge rows), exact rank cuts and the split."""
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from classyard.functions.exprs import equals_indicator, hex_or_number_to_long, hex_payload_bytes
from classyard.functions.hashing import hash_key
from classyard.operators.prep import cap_rows, stratified_split, split_quotas
from classyard.operators.ranking import rank_cut


def test_hex_or_number(spark):
    vals = ["0x18", "0x", "24", "24.9", "-1.5", "abc", None, "", "nan", "inf"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(hex_or_number_to_long("v")).collect()]
    assert got == [24, 0, 24, 24, -1, 0, 0, 0, 0, 0]


def test_payload_and_indicator(spark):
    df = spark.createDataFrame([(None,), ("0",), ("nan",), ("3332",), ("abc",)], "v string")
    assert [r[0] for r in df.select(hex_payload_bytes("v")).collect()] == [0, 0, 0, 2, 1]
    df2 = spark.createDataFrame([("MQTT",), ("0",), (None,)], "v string")
    assert [r[0] for r in df2.select(equals_indicator("v", "MQTT")).collect()] == [1, 0, 0]


def test_rank_cut_equals_window(spark):
    rng = np.random.default_rng(3)
    n = 5000
    pdf = pd.DataFrame({"row_id": np.arange(n), "g": rng.choice([0, 0, 0, 1, 2], n)})  # skewed groups
    df = spark.createDataFrame(pdf).withColumn("key", hash_key(42, "row_id"))
    quotas = spark.createDataFrame([(0, 1234), (1, 0), (2, 5000)], "g long, quota long")
    got = rank_cut(df, ["g"], "key", "row_id", quotas, digits=2)
    w = Window.partitionBy("g").orderBy("key", "row_id")
    exp = (df.join(quotas, "g", "left").withColumn("rk", F.row_number().over(w))
           .withColumn("sel", F.coalesce(F.col("rk") <= F.col("quota"), F.lit(False))))
    a = {r["row_id"]: r["selected"] for r in got.collect()}
    b = {r["row_id"]: r["sel"] for r in exp.collect()}
    assert a == b and len(a) == n


def test_split_quotas_exact(spark):
    df = spark.createDataFrame([(i, i % 7 if i % 7 < 3 else 3) for i in range(1001)], "row_id long, label int")
    q = {r["label"]: r["quota"] for r in split_quotas(df).collect()}
    assert sum(q.values()) == -(-1001 * 3 // 10)
    s = stratified_split(df)
    got = {r["label"]: r["n"] for r in s.where("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == q


def test_cap_rows(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    assert cap_rows(df, 120).count() == 120
    assert cap_rows(df, 1000).count() == 500
