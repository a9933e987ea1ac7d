"""Evaluation operators against hand-made matrices (FIXTURES §6 golden) and a
NumPy property check on random matrices."""
import numpy as np
import pandas as pd
import pytest

from classyard.operators import evaluate as ev

# One golden confusion matrix and its class names.
CM = [[3531, 471, 0, 51, 298, 0],
      [231, 35554, 0, 3271, 21, 0],
      [1, 21, 89, 72, 1, 0],
      [0, 642, 0, 48997, 0, 0],
      [1022, 288, 0, 20, 1948, 0],
      [0, 0, 0, 0, 0, 2761]]
CLASSES = ["bruteforce", "dos", "flood", "legitimate", "malformed", "slowite"]


def cm_frames(spark, cm, classes, ds="d", model="m"):
    rows = [(ds, model, y, p, int(n)) for y, r in enumerate(cm) for p, n in enumerate(r)]
    cmdf = spark.createDataFrame(rows, "dataset string, model string, y int, p int, n long")
    cl = spark.createDataFrame([(ds, i, c) for i, c in enumerate(classes)], "dataset string, label int, class string")
    return cmdf, cl


def test_golden_metrics(spark):
    cmdf, cl = cm_frames(spark, CM, CLASSES)
    pc = ev.per_class(cmdf, cl)
    s = ev.summary_metrics(pc).first()
    assert s["accuracy"] == pytest.approx(0.9354416356128512, abs=1e-15)
    assert s["precision_macro"] == pytest.approx(0.9155401974597867, abs=1e-15)
    assert s["recall_macro"] == pytest.approx(0.7977348853355197, abs=1e-15)
    assert s["f1_macro"] == pytest.approx(0.8371205420250712, abs=1e-15)
    assert s["precision_weighted"] == pytest.approx(0.936156711374458, abs=1e-15)
    assert s["f1_weighted"] == pytest.approx(0.9341250097466756, abs=1e-15)
    flood = pc.where("class = 'flood'").first()
    assert flood["precision"] == 1.0
    assert flood["recall"] == pytest.approx(0.483695652173913, abs=1e-15)
    assert flood["f1"] == pytest.approx(0.652014652014652, abs=1e-15)
    assert flood["support"] == 184


def test_golden_binary_collapse(spark):
    cmdf, _ = cm_frames(spark, CM, CLASSES)
    benign = spark.createDataFrame([("d", 3)], "dataset string, benign_label int")
    b = ev.binary_collapse(cmdf, benign).first()
    assert (b["tp_malicious_caught"], b["tn_benign_passed"], b["fp_benign_flagged_as_attack"],
            b["fn_attack_missed_as_benign"]) == (46237, 48997, 642, 3414)


def test_macro_over_present_labels(spark):
    # class 2 never appears in y or p: excluded from the macro average
    cm = [[5, 1, 0], [2, 4, 0], [0, 0, 0]]
    cmdf, cl = cm_frames(spark, cm, ["a", "b", "c"])
    s = ev.summary_metrics(ev.per_class(cmdf, cl)).first()
    p = np.array([5 / 7, 4 / 5]); r = np.array([5 / 6, 4 / 6])
    assert s["precision_macro"] == pytest.approx(p.mean())
    assert s["recall_macro"] == pytest.approx(r.mean())


def test_random_matrices_vs_numpy(spark):
    rng = np.random.default_rng(7)
    for _ in range(3):
        k = int(rng.integers(2, 6))
        cm = rng.integers(0, 20, (k, k))
        cmdf, cl = cm_frames(spark, cm.tolist(), [f"c{i}" for i in range(k)])
        s = ev.summary_metrics(ev.per_class(cmdf, cl)).first()
        tp = np.diag(cm); sup = cm.sum(1); prd = cm.sum(0)
        prec = np.where(prd > 0, tp / np.maximum(prd, 1), 0.0)
        rec = np.where(sup > 0, tp / np.maximum(sup, 1), 0.0)
        f1 = np.where(sup + prd > 0, 2 * tp / np.maximum(sup + prd, 1), 0.0)
        present = (sup > 0) | (prd > 0)
        assert s["accuracy"] == pytest.approx(tp.sum() / cm.sum())
        assert s["f1_macro"] == pytest.approx(f1[present].mean())
        assert s["f1_weighted"] == pytest.approx((f1 * sup).sum() / sup.sum())


def test_confusion_from_predictions_is_dense(spark):
    pred = spark.createDataFrame([("d", "m", 1, 0, 0), ("d", "m", 2, 0, 1)], "dataset string, model string, row_id long, y int, p int")
    cl = spark.createDataFrame([("d", i, c) for i, c in enumerate("abc")], "dataset string, label int, class string")
    cm = ev.confusion_long(pred, cl)
    assert cm.count() == 9
    m = ev.confusion_matrix(cm).first()["confusion_matrix"]
    assert m == [[1, 1, 0], [0, 0, 0], [0, 0, 0]]
