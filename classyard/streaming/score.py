"""Scoring a stream of events with a fitted closed-form model.

The reference computes nothing on streams; this is the natural Spark
extension of the benchmark: a model fitted on the batch stand-in (scaler +
nearest centroid, both pure column expressions) scores a ``readStream`` of
the events table, and a watermarked, hourly windowed confusion count is
maintained as streaming state.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classyard.operators.models.base import Ctx
from classyard.operators.models.stats import NearestCentroid
from classyard.operators.prep import apply_scaler, label_encode, prepare
from classyard.session import checkpoint_dir
from classyard.sources import standins


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, since a stream takes a plain path for a folder; matches the file or a folder of parts
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")


def windowed_confusion(spark: SparkSession, sf_dir: str, window: str = "1 hour",
                       watermark: str = "2 hours") -> DataFrame:
    """Fit on the batch ``evt`` split, score the stream, count (window, y, p).

    Append mode: a window's counts are written once, when the watermark has
    passed its end, and its state is dropped.  Runs over what has arrived
    (``availableNow``) into a Parquet sink in the shared folder, all files in one
    trigger, so no row is late whatever the order of the files.  Windows that are
    still open then, all behind the last one written, are counted by a batch pass
    over their rows."""
    from classyard.operators.models.base import argmin
    rd = standins.evt(spark, sf_dir)
    prep = prepare(rd.name, rd.raw, rd.features, rd.benign)
    fm = NearestCentroid().fit(prep.train(), Ctx(prep.features, prep.k))

    def scored(ev: DataFrame) -> DataFrame:
        feats = ev.select(
            "ts", F.col("event_type").alias("cls"),
            F.coalesce(F.col("value"), F.lit(0.0)).alias("f_value"),
            F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("f_k"),
            F.hour("ts").cast("double").alias("f_hour"), (F.dayofweek("ts") - 1).cast("double").alias("f_dow"))
        lab = label_encode(feats, "cls", prep.classes).drop("cls")
        scaled = apply_scaler(lab, prep.meta["scaler"])
        return (scaled.select("ts", F.col("label").alias("y"), argmin(fm.scores()).alias("p"))
                .select(F.window("ts", window).alias("w"), "y", "p"))

    def counts(sc: DataFrame) -> DataFrame:
        return (sc.groupBy("w", "y", "p").agg(F.count(F.lit(1)).alias("n"))
                .select(F.col("w.start").alias("window_start"), "y", "p", "n"))

    time = F.col("ts").cast("timestamp")   # NTZ -> session-zone (UTC)
    agg = counts(scored(stream_events(spark, sf_dir).withColumn("ts", time).withWatermark("ts", watermark)))
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = (agg.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    closed = spark.read.schema(agg.schema).parquet(f"{base}/out")
    last = closed.agg(F.max(F.unix_micros("window_start"))).first()[0]
    rest = scored(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", time))
    if last is not None:
        rest = rest.where(F.unix_micros("w.start") > last)
    return closed.unionByName(counts(rest))
