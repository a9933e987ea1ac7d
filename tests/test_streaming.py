from pyspark.sql import functions as F

from classyard.streaming.score import windowed_confusion

SF = "/root/testdata/sf0.001"


def test_all_windows_of_a_table_of_several_files(spark, tmp_path):
    """Files that each span the whole time, and windows open at the end."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = {(r.w, r.n) for r in ev.where("ts is not null").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("w"))
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    for sf in (SF, str(tmp_path)):
        out = windowed_confusion(spark, sf)
        assert out.count() == out.select("window_start", "y", "p").distinct().count()
        assert {(r.window_start, r.n) for r in out.groupBy("window_start").agg(F.sum("n").alias("n")).collect()} == want
