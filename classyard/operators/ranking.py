"""Exact per-group rank cuts without putting a whole group in one task.

``row_number() over (partition by g order by key) <= quota`` is the natural
way to write a stratified split or an under-sampler, but a window partitions
by ``g``: a class holding a third of all rows would land in one task.

Instead the md5 ordering key is bucketed by its leading hex digits (which
preserves order).  Bucket counts are a map-side-combined aggregate; a running
sum over that small table finds, per group, the bucket where the quota runs
out.  Only the rows of that one boundary bucket (about n_g / 65536 of the
group) are ranked with a window.  The result equals the window formulation
row for row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classyard.functions.hashing import hash_bucket

MAX_GROUPS = 100_000  # the cut table has one row per group and is broadcast


def rank_cut(df: DataFrame, groups: list[str], key: str, tiebreak: str,
             quotas: DataFrame, quota_col: str = "quota", out: str = "selected",
             digits: int = 4) -> DataFrame:
    """Flag the first ``quota`` rows of each group in (key, tiebreak) order.

    ``quotas`` has one row per group (columns ``groups`` + ``quota_col``);
    groups missing from it select nothing.
    """
    spark = df.sparkSession
    b = "__bucket"
    src = df.withColumn(b, hash_bucket(F.col(key), digits))
    counts = src.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    cum = (counts.join(quotas.select(*groups, F.col(quota_col).alias("__q")), groups)
           .withColumn("__cum", F.sum("__n").over(w))
           .withColumn("__tot", F.sum("__n").over(Window.partitionBy(*groups))))
    reach = F.when(F.col("__cum") >= F.col("__q"),
                   F.struct(b, (F.col("__q") - (F.col("__cum") - F.col("__n"))).alias("need")))
    cut = (cum.groupBy(*groups)
           .agg(F.min(reach).alias("__c"),
                F.first("__q").alias("__q"), F.first("__tot").alias("__tot"))
           .select(*groups, F.col(f"__c.{b}").alias("__cut"), F.col("__c.need").alias("__need"),
                   (F.col("__q") >= F.col("__tot")).alias("__all"), (F.col("__q") <= 0).alias("__none")))
    # eager: one row per group reaches the driver, then goes back as a broadcast
    rows = cut.collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"rank_cut: {len(rows)} groups exceeds the broadcast bound {MAX_GROUPS}")
    schema = cut.schema
    cut_df = F.broadcast(spark.createDataFrame(rows, schema))
    j = src.join(cut_df, groups, "left")
    allc, nonec = F.coalesce(F.col("__all"), F.lit(False)), F.coalesce(F.col("__none"), F.lit(True))
    boundary = ~allc & ~nonec & (F.col(b) == F.col("__cut"))
    easy = (j.where(~boundary)
            .withColumn(out, allc | (~nonec & (F.col(b) < F.col("__cut")))))
    wb = Window.partitionBy(*groups).orderBy(F.col(key), F.col(tiebreak))
    hard = j.where(boundary).withColumn(out, F.row_number().over(wb) <= F.col("__need"))
    drop = [b, "__cut", "__need", "__all", "__none"]
    # few rows: every later pass over the result would run one task per shuffle partition
    hard = hard.coalesce(spark.sparkContext.defaultParallelism)
    return easy.drop(*drop).unionByName(hard.drop(*drop))


POSITION_ROWS = 200_000  # rows numbered by one window, on average


def dense_position(df: DataFrame, key: str, out: str) -> DataFrame:
    """Number all rows 0 ... n-1 (by hash bucket of ``key``, then by key) without
    a global sort: bucket sizes are counted first, and each window numbers one
    bucket behind the rows of the buckets before it."""
    n = df.count()
    buckets = max(1, -(-n // POSITION_ROWS))
    src = df.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    start, starts = 0, []
    for r in src.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("__bucket").collect():
        starts.append((r["__bucket"], start))
        start += r["n"]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "__bucket long, __start long"))   # one row per POSITION_ROWS rows
    number = F.row_number().over(Window.partitionBy("__bucket").orderBy(key))
    return (src.join(first, "__bucket").withColumn(out, F.col("__start") + number - 1).drop("__bucket", "__start"))
