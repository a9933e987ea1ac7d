"""Leaderboard and decision-support analytics A1-A27 over result records.

Inputs are the result-record table (S4 schema; ``status`` ok/failed) and
views derived from it.  Every operator is a grouped aggregate, a window over
one dataset's models (tens of rows per partition: the registry size) or a
projection -- the volume here is set by the registry, not by the data.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scoring weights of the composite score.
QUALITY_WEIGHT, COST_WEIGHT = 0.70, 0.30
W_F1_MACRO, W_F1_WEIGHTED, W_RARE_CLASS = 0.55, 0.20, 0.25
W_INFER, W_TRAIN = 0.65, 0.35

# Model family -> display group; unknown families map to "exotic".
FAMILY_GROUP = {
    "linear": "linear", "naive_bayes": "linear",
    "tree": "tree", "ensemble_bagging": "tree",
    "boosting": "boosting",
    "kernel": "kernel",
    "instance": "instance", "graph": "instance", "probabilistic": "instance",
    "interpretable": "interpretable",
    "exotic": "exotic",
    "meta": "meta", "imbalanced": "meta",
}
GROUP_ORDER = ["linear", "tree", "boosting", "kernel", "instance", "interpretable", "exotic", "meta"]

# Scaling-projection rows (key, complexity mode) and the target row count.
SCALE_ROWS = [("histgbm", "time_linear"), ("random_forest", "time_linear"), ("logreg", "time_linear"),
              ("svc_rbf", "time_quadratic"), ("gaussian_process", "time_cubic"),
              ("label_spreading", "memory_quadratic"), ("knn5", "inference_linear")]
TARGET_ROWS = 4_000_000


def ok(records: DataFrame) -> DataFrame:
    return records.where(F.col("status") == "ok")


def per_class_long(records: DataFrame) -> DataFrame:
    """(dataset, key, label, class, precision, recall, f1, support) from the nested per_class array."""
    return (ok(records).select("dataset", "key", F.posexplode("per_class").alias("label", "pc"))
            .select("dataset", "key", F.col("label").cast("int"), "pc.class", "pc.precision", "pc.recall",
                    "pc.f1", "pc.support"))


def rarest_class(records: DataFrame) -> DataFrame:
    """A1: class with the smallest support per dataset (ties: class order)."""
    pcl = per_class_long(records)
    return (pcl.groupBy("dataset")
            .agg(F.min(F.struct("support", "label", "class")).alias("m"))
            .select("dataset", F.col("m.class").alias("rare_class")))


def rare_class_f1(records: DataFrame) -> DataFrame:
    """A2: F1 of the rarest class for every ok model."""
    return (per_class_long(records).join(F.broadcast(rarest_class(records)), "dataset")
            .where(F.col("class") == F.col("rare_class"))
            .select("dataset", "key", "rare_class", F.col("f1").alias("rare_class_f1")))


def minmax(c: str, invert: bool = False, part: str = "dataset"):
    """A3: min-max normalisation within the dataset; span 0 divides by 1."""
    w = Window.partitionBy(part)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    span = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    n = (F.col(c) - lo) / span
    return (1 - n) if invert else n


def dataset_scores(records: DataFrame) -> DataFrame:
    """Quality, cost and composite score per (dataset, model), x100 rounded to 2."""
    m = ok(records).join(rare_class_f1(records), ["dataset", "key"])
    quality = (W_F1_MACRO * minmax("f1_macro") + W_F1_WEIGHTED * minmax("f1_weighted")
               + W_RARE_CLASS * minmax("rare_class_f1"))
    cost = W_INFER * minmax("inference_time_per_sample_ms", True) + W_TRAIN * minmax("train_time_sec", True)
    s = m.select("dataset", "key", "name", "family", "f1_macro", "f1_weighted", "accuracy", "rare_class",
                 "rare_class_f1", "train_time_sec", F.col("inference_time_per_sample_ms").alias("infer_ms"),
                 "model_size", "subsample_cap", quality.alias("q"), cost.alias("c"))
    return s.select("*", F.round(F.col("q") * 100, 2).alias("quality_score"),
                    F.round(F.col("c") * 100, 2).alias("cost_score"),
                    F.round((QUALITY_WEIGHT * F.col("q") + COST_WEIGHT * F.col("c")) * 100, 2).alias("composite_score")
                    ).drop("q", "c")


def combine(scores: DataFrame, left: str, right: str) -> DataFrame:
    """Models scored on both datasets (inner join on key); averages and gap."""
    a = scores.where(F.col("dataset") == left).alias("a")
    b = scores.where(F.col("dataset") == right).alias("b")
    j = a.join(b, "key")
    out = j.select(
        "key", F.col("a.name").alias("name"), F.col("a.family").alias("family"),
        F.round((F.col("a.composite_score") + F.col("b.composite_score")) / 2, 2).alias("avg_composite"),
        F.round((F.col("a.quality_score") + F.col("b.quality_score")) / 2, 2).alias("avg_quality"),
        F.round((F.col("a.cost_score") + F.col("b.cost_score")) / 2, 2).alias("avg_cost"),
        F.round(F.abs(F.col("a.composite_score") - F.col("b.composite_score")), 2).alias("consistency_gap"),
        F.col("a.composite_score").alias("left_composite"), F.col("b.composite_score").alias("right_composite"),
        F.col("a.quality_score").alias("left_quality"), F.col("b.quality_score").alias("right_quality"),
        F.col("a.infer_ms").alias("left_infer_ms"), F.col("b.infer_ms").alias("right_infer_ms"),
        F.col("a.train_time_sec").alias("left_train_sec"), F.col("b.train_time_sec").alias("right_train_sec"),
        F.col("a.f1_macro").alias("left_f1_macro"), F.col("b.f1_macro").alias("right_f1_macro"))
    w = Window.orderBy(F.col("avg_composite").desc(), F.col("key"))
    return out.withColumn("rank", F.row_number().over(w))


def dataset_header(records: DataFrame) -> DataFrame:
    """Classes, sizes, attempted / ok / failed counts and families per dataset."""
    best = F.max_by(F.struct("class_names", "n_train_samples", "n_test_samples", "n_features"),
                    F.when(F.col("status") == "ok", F.struct("f1_macro", F.col("key"))))
    return records.groupBy("dataset").agg(
        best.alias("ref"), F.count(F.lit(1)).alias("n_models_attempted"),
        F.count_if(F.col("status") == "ok").alias("n_models_ok"),
        F.count_if(F.col("status") == "failed").alias("n_models_failed"),
        F.array_sort(F.collect_set("family")).alias("families")
    ).select("dataset", F.concat_ws(",", "ref.class_names").alias("classes"), "ref.n_train_samples",
             "ref.n_test_samples", "ref.n_features", "n_models_attempted", "n_models_ok", "n_models_failed",
             F.concat_ws(",", "families").alias("families"))


def leaderboard(records: DataFrame) -> DataFrame:
    """Ok models by F1-macro desc (stable tiebreak on key) with their rank."""
    w = Window.partitionBy("dataset").orderBy(F.col("f1_macro").desc(), F.col("key"))
    return ok(records).withColumn("rank", F.row_number().over(w))


def top_k(records: DataFrame, by: str, k: int = 15, ascending: bool = False) -> DataFrame:
    """A10: top-k per dataset by a metric (a partial top-k: window + filter)."""
    o = F.col(by).asc() if ascending else F.col(by).desc()
    w = Window.partitionBy("dataset").orderBy(o, F.col("key"))
    return ok(records).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_fast(records: DataFrame, min_f1: float = 0.80) -> DataFrame:
    """Fastest-training model with F1-macro >= min_f1 per dataset."""
    return (ok(records).where(F.col("f1_macro") >= min_f1).groupBy("dataset")
            .agg(F.min(F.struct("train_time_sec", "key", "name")).alias("m"))
            .select("dataset", F.col("m.key").alias("key"), F.col("m.name").alias("name"),
                    F.col("m.train_time_sec").alias("train_time_sec")))


def group_of(family_col: str = "family"):
    """Family -> display group (unknown -> exotic), as a literal map lookup."""
    m = F.create_map(*[x for kv in FAMILY_GROUP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(m[F.col(family_col)], F.lit("exotic"))


def family_rollup(records: DataFrame) -> DataFrame:
    """Per family count, best model, best / average F1-macro, sorted by best F1."""
    r = (ok(records).groupBy("dataset", "family").agg(
        F.count(F.lit(1)).alias("count"),
        F.max_by(F.col("key"), F.struct("f1_macro", F.col("key"))).alias("best_key"),
        F.max("f1_macro").alias("best_f1_macro"), F.avg("f1_macro").alias("avg_f1_macro")))
    w = Window.partitionBy("dataset").orderBy(F.col("best_f1_macro").desc(), F.col("family"))
    return r.withColumn("group", group_of()).withColumn("rank", F.row_number().over(w))


def filter_groups(records: DataFrame, groups: list[str]) -> DataFrame:
    """A13 filter: keep models whose family group is active."""
    return records.where(group_of().isin(groups))


def speed_quality_points(records: DataFrame) -> DataFrame:
    """x = max(train time, 0.001) on a log10 axis, y = F1-macro."""
    x = F.greatest(F.col("train_time_sec"), F.lit(0.001))
    return ok(records).select("dataset", "key", x.alias("x"), F.log10(x).alias("log10_x"),
                              F.col("f1_macro").alias("y"), group_of().alias("group"))


def class_f1_matrix(records: DataFrame) -> DataFrame:
    """Model x class F1 (long form; absent cells 0), rows ordered by F1-macro."""
    lb = leaderboard(records).select("dataset", "key", F.col("rank").alias("row_order"), "class_names")
    cells = lb.select("dataset", "key", "row_order", F.explode("class_names").alias("class"))
    pcl = per_class_long(records).select("dataset", "key", "class", "f1")
    return (cells.join(pcl, ["dataset", "key", "class"], "left")
            .select("dataset", "key", "row_order", "class", F.coalesce("f1", F.lit(0.0)).alias("f1")))


def row_normalised_cm(records: DataFrame) -> DataFrame:
    """Confusion cells divided by their row total (empty row -> 0)."""
    cells = (ok(records).select("dataset", "key", F.posexplode("confusion_matrix").alias("y", "row"))
             .select("dataset", "key", "y", F.posexplode("row").alias("p", "n")))
    tot = F.sum("n").over(Window.partitionBy("dataset", "key", "y"))
    return cells.select("dataset", "key", "y", "p", "n",
                        F.when(tot == 0, 0.0).otherwise(F.col("n") / tot).alias("share"))


def dynamic_sort(records: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Any column, asc/desc, nulls last, failed rows included; emits the position."""
    o = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    w = Window.partitionBy("dataset").orderBy(o, F.col("key"))
    return records.withColumn("position", F.row_number().over(w))


def failed_report(records: DataFrame) -> DataFrame:
    """Failed runs per dataset and their share of attempted runs."""
    return records.groupBy("dataset").agg(
        F.count_if(F.col("status") == "failed").alias("n_failed"), F.count(F.lit(1)).alias("n_attempted")
    ).withColumn("failed_share", F.col("n_failed") / F.col("n_attempted"))


def binary_summary(binary: DataFrame, top: int = 15) -> DataFrame:
    """Best / worst malicious F1, mean FNR and model count per dataset."""
    return binary.groupBy("dataset").agg(
        F.max_by("model", F.struct("f1_malicious", F.col("model"))).alias("best_model"),
        F.min_by("model", F.struct("f1_malicious", F.col("model"))).alias("worst_model"),
        F.max("f1_malicious").alias("best_f1_malicious"), F.min("f1_malicious").alias("worst_f1_malicious"),
        F.avg("false_negative_rate").alias("avg_fnr"), F.count(F.lit(1)).alias("n_models"))


def scaling_projection(records: DataFrame, n_train: DataFrame) -> DataFrame:
    """Projected cost at TARGET_ROWS from each mode's complexity class.

    ``n_train(dataset, n_train)``; rows for registry keys absent on a dataset
    carry nulls (shown as 'not available')."""
    modes = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(m).alias("mode")) for k, m in SCALE_ROWS])
    base = n_train.select("dataset", "n_train", F.explode(modes).alias("sr")).select("dataset", "n_train", "sr.*")
    m = ok(records).select("dataset", "key", "subsample_cap", "train_time_sec", "inference_time_per_sample_ms")
    j = base.join(m, ["dataset", "key"], "left")
    n_used = F.coalesce(F.col("subsample_cap").cast("double"), F.col("n_train").cast("double"))
    s = F.lit(float(TARGET_ROWS)) / n_used
    t = F.col("train_time_sec")
    proj = (F.when(F.col("mode") == "time_linear", t * s)
            .when(F.col("mode") == "time_quadratic", t * s * s)
            .when(F.col("mode") == "time_cubic", t * s * s * s)
            .when(F.col("mode") == "memory_quadratic", n_used * n_used * 8 * s * s)
            .when(F.col("mode") == "inference_linear", F.col("inference_time_per_sample_ms") * s))
    cur = F.when(F.col("mode") == "memory_quadratic", n_used * n_used * 8).when(
        F.col("mode") == "inference_linear", F.col("inference_time_per_sample_ms")).otherwise(t)
    avail = F.col("train_time_sec").isNotNull()
    return j.select("dataset", "key", "mode", F.when(avail, n_used).alias("n_used"),
                    F.when(avail, cur).alias("current"), F.when(avail, proj).alias("projected"))


def _cut(combined: DataFrame, frac: float, name: str) -> DataFrame:
    """Adds ``name`` = avg_quality at index floor(n * frac) of the descending list."""
    w = Window.orderBy(F.col("avg_quality").desc(), F.col("key"))
    allw = Window.partitionBy()
    r = combined.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(allw))
    return r.withColumn(name, F.max(F.when(F.col("__i") == F.floor(F.col("__n") * frac), F.col("avg_quality"))).over(allw)
                        ).drop("__i", "__n")


def quality_tier(combined: DataFrame, frac: float = 0.25) -> DataFrame:
    """cut = value at index floor(n * frac) of the descending quality list; keep >= cut."""
    return _cut(combined, frac, "cut").where(F.col("avg_quality") >= F.col("cut"))


def scenarios(combined: DataFrame) -> DataFrame:
    """Scenario picks -- fastest inference / training in the quality
    tier, most consistent among the top 20, best interpretable."""
    tier = quality_tier(combined)
    fi = tier.select(F.min(F.struct((F.col("left_infer_ms") + F.col("right_infer_ms")), F.col("rank"), F.col("key")))["key"].alias("v"))
    ft = tier.select(F.min(F.struct((F.col("left_train_sec") + F.col("right_train_sec")), F.col("rank"), F.col("key")))["key"].alias("v"))
    mc = combined.where(F.col("rank") <= 20).select(F.min(F.struct("consistency_gap", "rank", "key"))["key"].alias("v"))
    it = (combined.where((group_of() == "interpretable") | (F.col("key") == "decision_tree"))
          .select(F.min(F.struct(-F.col("avg_composite"), F.col("rank"), F.col("key")))["key"].alias("v")))

    def lab(df, s):
        return df.select(F.lit(s).alias("scenario"), F.col("v").alias("key"))
    return (lab(fi, "fastest_inference").unionByName(lab(ft, "fastest_training"))
            .unionByName(lab(mc, "most_consistent")).unionByName(lab(it, "interpretable")))


def consistency_tables(combined: DataFrame) -> DataFrame:
    """Per-dataset composite pairs and the top-half latency table
    (latency sum clamped at 0.0005, log10 axis)."""
    lat = F.greatest(F.col("left_infer_ms") + F.col("right_infer_ms"), F.lit(0.0005))
    return (_cut(combined, 0.5, "half_cut")
            .select("key", "left_composite", "right_composite",
                    (F.col("avg_quality") >= F.col("half_cut")).alias("top_half"),
                    lat.alias("latency"), F.log10(lat).alias("log10_latency"), "avg_quality"))


def comparison_table(combined: DataFrame, column: str = "avg_composite", ascending: bool = False) -> DataFrame:
    """The full comparison table, sortable by any of its columns."""
    cols = ["key", "name", "family", "avg_composite", "avg_quality", "avg_cost", "consistency_gap",
            "left_f1_macro", "right_f1_macro", "left_infer_ms"]
    o = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return combined.select(*cols).withColumn("position", F.row_number().over(Window.orderBy(o, F.col("key"))))
