"""Evaluation operators E1-E10 over a prediction table.

Input: ``pred(dataset, model, row_id, y int, p int)`` for any number of models
and datasets, and ``classes(dataset, label int, class string)``.  The only
pass over prediction rows is one partial aggregate to (dataset, model, y, p)
counts; everything after works on that K x K-per-model table, whose size is
set by the registry and class count, never by the data volume.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classyard.functions.exprs import safe_div

KEYS = ["dataset", "model"]


def confusion_counts(pred: DataFrame) -> DataFrame:
    """Sparse confusion counts (map-side combined)."""
    return pred.groupBy(*KEYS, "y", "p").agg(F.count(F.lit(1)).alias("n"))


def confusion_long(pred: DataFrame, classes: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """E2 (long form): dense K x K grid per (dataset, model); empty cells are 0.
    ``counts``: stored confusion counts, for they are read twice."""
    counts = confusion_counts(pred) if counts is None else counts
    k = classes.groupBy("dataset").agg(F.count(F.lit(1)).alias("k"))
    models = counts.select(*KEYS).distinct().join(F.broadcast(k), "dataset")
    grid = (models
            .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
            .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("k") - 1))))
    return (grid.join(counts, KEYS + ["y", "p"], "left")
            .select(*KEYS, "y", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_matrix(cm: DataFrame) -> DataFrame:
    """E2 (nested form): array<array<long>>, rows = true class, cols = predicted."""
    rows = (cm.groupBy(*KEYS, "y")
            .agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("r"))
            .select(*KEYS, "y", F.transform("r", lambda s: s["n"]).alias("row")))
    return (rows.groupBy(*KEYS)
            .agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias("m"))
            .select(*KEYS, F.transform("m", lambda s: s["row"]).alias("confusion_matrix")))


def per_class(cm: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Per-class precision / recall / F1 / support; 0 on zero division."""
    sup = cm.groupBy(*KEYS, F.col("y").alias("label")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy(*KEYS, F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    tp = cm.where(F.col("y") == F.col("p")).select(*KEYS, F.col("y").alias("label"), F.col("n").alias("tp"))
    j = sup.join(prd, KEYS + ["label"]).join(tp, KEYS + ["label"])
    out = j.select(
        *KEYS, "label", "support", "predicted", "tp",
        safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
        safe_div(F.col("tp"), F.col("support")).alias("recall"),
        safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))
    if classes is not None:
        out = out.join(F.broadcast(classes), ["dataset", "label"])
    return out


def summary_metrics(pc: DataFrame) -> DataFrame:
    """Accuracy, macro (labels present in y or yhat) and weighted P/R/F1."""
    present = (F.col("support") > 0) | (F.col("predicted") > 0)

    def macro(c):
        return safe_div(F.sum(F.when(present, F.col(c)).otherwise(0.0)), F.sum(present.cast("int")))

    def weighted(c):
        return safe_div(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    return pc.groupBy(*KEYS).agg(
        safe_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        macro("precision").alias("precision_macro"),
        macro("recall").alias("recall_macro"),
        macro("f1").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
        F.sum("support").alias("n_test_samples"))


def accuracy(pred: DataFrame) -> DataFrame:
    """E1 directly from predictions: share of rows with y == p."""
    return pred.groupBy(*KEYS).agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def classification_report(pc: DataFrame, digits: int | None = 2) -> DataFrame:
    """Long report table -- one row per class, then accuracy, macro avg
    (over all K labels, as the report is built with explicit labels) and
    weighted avg; values rounded to 2 digits."""
    cls_rows = pc.select(*KEYS, F.col("label").alias("ord"), F.col("class").alias("row"),
                         "precision", "recall", F.col("f1").alias("f1_score"), "support")
    tot = pc.groupBy(*KEYS).agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        safe_div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        safe_div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    acc = tot.select(*KEYS, F.lit(1000).alias("ord"), F.lit("accuracy").alias("row"),
                     F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                     safe_div(F.col("tp"), F.col("support")).alias("f1_score"), "support")
    mac = tot.select(*KEYS, F.lit(1001).alias("ord"), F.lit("macro avg").alias("row"),
                     F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), "support")
    wei = tot.select(*KEYS, F.lit(1002).alias("ord"), F.lit("weighted avg").alias("row"),
                     F.col("wp").alias("precision"), F.col("wr").alias("recall"), F.col("wf").alias("f1_score"), "support")
    out = cls_rows.unionByName(acc).unionByName(mac).unionByName(wei)
    rnd = (lambda c: F.round(c, digits).alias(c)) if digits is not None else F.col
    return out.select(*KEYS, "ord", "row", *[rnd(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("long"))


def report_text(report: DataFrame) -> DataFrame:
    """E6 rendered as one fixed-width string per (dataset, model)."""
    line = F.when(F.col("row") == "accuracy",
                  F.format_string("%14s %9s %9s %9.2f %9d", F.col("row"), F.lit(""), F.lit(""), F.col("f1_score"), F.col("support"))
                  ).otherwise(F.format_string("%14s %9.2f %9.2f %9.2f %9d", F.col("row"), F.col("precision"),
                                              F.col("recall"), F.col("f1_score"), F.col("support")))
    head = F.format_string("%14s %9s %9s %9s %9s", F.lit(""), F.lit("precision"), F.lit("recall"), F.lit("f1-score"), F.lit("support"))
    return (report.groupBy(*KEYS)
            .agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))).alias("ls"))
            .select(*KEYS, F.concat_ws("\n", F.array_insert(F.transform("ls", lambda s: s["l"]), 1, head))
                    .alias("classification_report")))


def per_row_latency(runs: DataFrame) -> DataFrame:
    """Inference milliseconds per test row as a derived column."""
    return runs.withColumn("inference_time_per_sample_ms",
                           F.col("inference_time_sec") / F.col("n_test_samples") * 1000.0)


def binary_collapse(cm: DataFrame, benign: DataFrame) -> DataFrame:
    """Benign-vs-malicious view from the K x K counts.

    ``benign(dataset, benign_label)``: any attack predicted as any attack is a TP.
    """
    j = cm.join(F.broadcast(benign), "dataset")
    yb, pb = F.col("y") == F.col("benign_label"), F.col("p") == F.col("benign_label")
    s = j.groupBy(*KEYS).agg(
        F.sum(F.when(~yb & ~pb, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(yb & pb, F.col("n")).otherwise(0)).alias("tn"),
        F.sum(F.when(yb & ~pb, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~yb & pb, F.col("n")).otherwise(0)).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    prec, rec = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    # The column names that result records carry.
    return s.select(
        *KEYS, tp.alias("tp_malicious_caught"), tn.alias("tn_benign_passed"),
        fp.alias("fp_benign_flagged_as_attack"), fn.alias("fn_attack_missed_as_benign"),
        safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        prec.alias("precision_malicious"), rec.alias("recall_malicious"),
        safe_div(2 * prec * rec, prec + rec).alias("f1_malicious"),
        safe_div(fp, fp + tn).alias("false_positive_rate"),
        safe_div(fn, fn + tp).alias("false_negative_rate"))


def binary_ranking(binary: DataFrame) -> DataFrame:
    """Rank models by malicious F1 (desc, ties by model key) per dataset."""
    w = Window.partitionBy("dataset").orderBy(F.col("f1_malicious").desc(), F.col("model"))
    wr = Window.partitionBy("dataset").orderBy(F.col("f1_malicious").asc(), F.col("model"))
    return (binary.withColumn("rank", F.row_number().over(w))
            .withColumn("is_best", F.col("rank") == 1)
            .withColumn("is_worst", F.row_number().over(wr) == 1))


def evaluate(pred: DataFrame, classes: DataFrame, materialize: bool = True) -> dict[str, DataFrame]:
    """All evaluation tables of a prediction table, sharing one K x K aggregate.

    The aggregate is models x K^2 rows whatever the data size; it is computed
    once (one pass over the predictions) and every derived table reads it.
    """
    counts = confusion_counts(pred)
    if materialize:
        counts = counts.checkpoint(eager=True)     # a cached table may be computed again, this one is not
    cm = confusion_long(pred, classes, counts)
    if materialize:
        cm = cm.persist()
        cm.count()
    pc = per_class(cm, classes)
    if materialize:
        pc = pc.persist()
        pc.count()
    return {"cm": cm, "per_class": pc, "summary": summary_metrics(pc), "matrix": confusion_matrix(cm)}
