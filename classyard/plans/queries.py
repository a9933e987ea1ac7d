"""Registered queries: Spark plans + their DuckDB oracle SQL.

Each query reads the driver's tables (through the stand-in builders) and
returns a DataFrame whose column names and types match the oracle SQL.
Doubles are rounded to 6 digits on both sides; integers are bigint.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classyard.operators.models.registry import REGISTRY, SQL_EXACT
from classyard.plans import oracle as O
from classyard.plans.queries_base import predictions, prepared

def _r(c: str, d: int = 6):
    return F.round(F.col(c), d).alias(c)


def _big(*cs):
    return [F.col(c).cast("bigint").alias(c) for c in cs]


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ F6 + F11
for _ds in O.DATASETS:
    def _split(spark, sf, ds=_ds):
        p = prepared(spark, sf, ds)
        return p.df.select(*_big("row_id", "label"), "split")
    register(f"f11_split_{_ds}",
             O.with_(O.prep_ctes(_ds)) + f"SELECT CAST(row_id AS BIGINT) AS row_id, CAST(label AS BIGINT) AS label, split FROM {_ds}_prep")(_split)

# ------------------------------------------------------------------ models
for _ds in O.DATASETS:
    for _m in SQL_EXACT:
        if _m.startswith("knn") and _ds not in O.KNN_ORACLE:
            continue
        def _pred(spark, sf, ds=_ds, m=_m):
            return predictions(spark, sf, ds, m).select(*_big("row_id", "y", "p"))
        register(f"{_m}_{_ds}",
                 O.with_(O.prep_ctes(_ds), O.model_ctes(_ds, _m))
                 + f"SELECT CAST(row_id AS BIGINT) AS row_id, CAST(y AS BIGINT) AS y, CAST(p AS BIGINT) AS p FROM {_ds}_{_m}_pred")(_pred)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ------------------------------------------------------------------ evaluation
def _lb():
    from classyard.plans import leaderboard as L
    return L


def _wa(body: str) -> str:
    return "WITH " + O.analytics_ctes() + "\n" + body


def _evq(name, sql):
    return register(name, _wa(sql))


@_evq("e2_confusion", "SELECT dataset, model, CAST(y AS BIGINT) AS y, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n FROM lb_cm")
def _e2(spark, sf):
    return _lb().lb_eval(spark, sf)["cm"].select("dataset", "model", *_big("y", "p", "n"))


@_evq("e3_per_class", "SELECT dataset, model, CAST(label AS BIGINT) AS label, class, round(precision, 6) AS precision, "
      "round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM lb_pc")
def _e3(spark, sf):
    pc = _lb().lb_eval(spark, sf)["per_class"]
    return pc.select("dataset", "model", *_big("label"), "class", _r("precision"), _r("recall"), _r("f1"), *_big("support"))


_SUMCOLS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted"]


@_evq("e1_e4_e5_summary", "SELECT dataset, model, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SUMCOLS) + " FROM lb_sum")
def _e145(spark, sf):
    return _lb().lb_eval(spark, sf)["summary"].select("dataset", "model", *[_r(c) for c in _SUMCOLS])


@_evq("e6_report", """SELECT dataset, model, CAST(ord AS BIGINT) AS ord, row, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM (
  SELECT dataset, model, label AS ord, class AS row, precision, recall, f1 AS f1_score, support FROM lb_pc
  UNION ALL SELECT dataset, model, 1000, 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM lb_pc GROUP BY dataset, model
  UNION ALL SELECT dataset, model, 1001, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM lb_pc GROUP BY dataset, model
  UNION ALL SELECT dataset, model, 1002, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
            sum(f1 * support) / sum(support), sum(support) FROM lb_pc GROUP BY dataset, model)""")
def _e6(spark, sf):
    from classyard.operators.evaluate import classification_report
    rep = classification_report(_lb().lb_eval(spark, sf)["per_class"], digits=None)
    return rep.select("dataset", "model", *_big("ord"), "row", _r("precision"), _r("recall"), _r("f1_score"), *_big("support"))


_BINCOLS = ["accuracy", "precision_malicious", "recall_malicious", "f1_malicious", "false_positive_rate", "false_negative_rate"]
_BINSQL = """lb_bin0 AS (SELECT c.dataset, c.model,
   sum(CASE WHEN c.y <> b.benign_label AND c.p <> b.benign_label THEN n ELSE 0 END) AS tp,
   sum(CASE WHEN c.y = b.benign_label AND c.p = b.benign_label THEN n ELSE 0 END) AS tn,
   sum(CASE WHEN c.y = b.benign_label AND c.p <> b.benign_label THEN n ELSE 0 END) AS fp,
   sum(CASE WHEN c.y <> b.benign_label AND c.p = b.benign_label THEN n ELSE 0 END) AS fn
   FROM lb_cm c JOIN lb_benign b ON b.dataset = c.dataset GROUP BY c.dataset, c.model),
 lb_bin1 AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS pr,
   CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS rc FROM lb_bin0),
 lb_bin AS (SELECT dataset, model, tp AS tp_malicious_caught, tn AS tn_benign_passed, fp AS fp_benign_flagged_as_attack,
   fn AS fn_attack_missed_as_benign,
   CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END AS accuracy,
   pr AS precision_malicious, rc AS recall_malicious,
   CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS f1_malicious,
   CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END AS false_positive_rate,
   CASE WHEN fn + tp = 0 THEN 0.0 ELSE fn / (fn + tp) END AS false_negative_rate FROM lb_bin1)"""


def _wb(body: str) -> str:
    return "WITH " + O.analytics_ctes() + ",\n" + _BINSQL + "\n" + body


def _binary(spark, sf):
    from classyard.operators.evaluate import binary_collapse
    L = _lb()
    return binary_collapse(L.lb_eval(spark, sf)["cm"], L.lb_benign(spark, sf))


@register("e9_binary", _wb("SELECT dataset, model, CAST(tp_malicious_caught AS BIGINT) AS tp_malicious_caught, "
                           "CAST(tn_benign_passed AS BIGINT) AS tn_benign_passed, CAST(fp_benign_flagged_as_attack AS BIGINT) AS fp_benign_flagged_as_attack, "
                           "CAST(fn_attack_missed_as_benign AS BIGINT) AS fn_attack_missed_as_benign, "
                           + ", ".join(f"round({c}, 6) AS {c}" for c in _BINCOLS) + " FROM lb_bin"))
def _e9(spark, sf):
    b = _binary(spark, sf)
    return b.select("dataset", "model", *_big("tp_malicious_caught", "tn_benign_passed", "fp_benign_flagged_as_attack",
                                              "fn_attack_missed_as_benign"), *[_r(c) for c in _BINCOLS])


@register("e10_binary_rank", _wb("""SELECT dataset, model, round(f1_malicious, 6) AS f1_malicious,
  row_number() OVER (PARTITION BY dataset ORDER BY f1_malicious DESC, model) AS rank,
  CAST(row_number() OVER (PARTITION BY dataset ORDER BY f1_malicious DESC, model) = 1 AS BIGINT) AS is_best,
  CAST(row_number() OVER (PARTITION BY dataset ORDER BY f1_malicious ASC, model) = 1 AS BIGINT) AS is_worst FROM lb_bin"""))
def _e10(spark, sf):
    from classyard.operators.evaluate import binary_ranking
    r = binary_ranking(_binary(spark, sf))
    return r.select("dataset", "model", _r("f1_malicious"), *_big("rank"), F.col("is_best").cast("bigint").alias("is_best"),
                    F.col("is_worst").cast("bigint").alias("is_worst"))


_RUNCOLS = ["train_time_sec", "inference_time_sec", "inference_time_per_sample_ms"]


@_evq("e7_e8_run_records", "SELECT dataset, key, status, " + ", ".join(f"round({c}, 9) AS {c}" for c in _RUNCOLS)
      + ", CAST(n_train_samples AS BIGINT) AS n_train_samples, CAST(n_test_samples AS BIGINT) AS n_test_samples, "
        "CAST(n_features AS BIGINT) AS n_features FROM lb_rec")
def _e78(spark, sf):
    r = _lb().lb_records(spark, sf)
    return r.select("dataset", "key", "status", *[_r(c, 9) for c in _RUNCOLS], *_big("n_train_samples", "n_test_samples", "n_features"))


# ------------------------------------------------------------------ analytics
def _A():
    from classyard.operators import analytics as A
    return A


def _rec(spark, sf):
    return _lb().lb_records(spark, sf)


def _comb(spark, sf):
    L = _lb()
    return _A().combine(_A().dataset_scores(_rec(spark, sf)), L.LEFT, L.RIGHT)


@_evq("a1_rarest_class", "SELECT dataset, rare_class FROM lb_rare")
def _a1(spark, sf):
    return _A().rarest_class(_rec(spark, sf))


@_evq("a2_rare_class_f1", "SELECT dataset, key, rare_class, round(rare_class_f1, 6) AS rare_class_f1 FROM lb_sc0")
def _a2(spark, sf):
    return _A().rare_class_f1(_rec(spark, sf)).select("dataset", "key", "rare_class", _r("rare_class_f1"))


@_evq("a3_a6_scores", "SELECT dataset, key, quality_score, cost_score, composite_score FROM lb_scores")
def _a36(spark, sf):
    return _A().dataset_scores(_rec(spark, sf)).select("dataset", "key", "quality_score", "cost_score", "composite_score")


@_evq("a7_combined", "SELECT key, name, family, avg_composite, avg_quality, avg_cost, consistency_gap, rank FROM lb_comb")
def _a7(spark, sf):
    return _comb(spark, sf).select("key", "name", "family", "avg_composite", "avg_quality", "avg_cost",
                                   "consistency_gap", *_big("rank"))


@_evq("a8_dataset_header", """SELECT h.dataset, (SELECT string_agg(class, ',' ORDER BY label) FROM lb_cls c WHERE c.dataset = h.dataset) AS classes,
  CAST(n_train_samples AS BIGINT) AS n_train_samples, CAST(n_test_samples AS BIGINT) AS n_test_samples,
  CAST(n_features AS BIGINT) AS n_features, CAST(n_models_attempted AS BIGINT) AS n_models_attempted,
  CAST(n_models_ok AS BIGINT) AS n_models_ok, CAST(n_models_failed AS BIGINT) AS n_models_failed, families FROM (
  SELECT dataset, max(n_train_samples) AS n_train_samples, max(n_test_samples) AS n_test_samples, max(n_features) AS n_features,
         count(*) AS n_models_attempted, count_if(status = 'ok') AS n_models_ok, count_if(status = 'failed') AS n_models_failed,
         string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM lb_rec GROUP BY dataset) h""")
def _a8(spark, sf):
    return _A().dataset_header(_rec(spark, sf)).select(
        "dataset", "classes", *_big("n_train_samples", "n_test_samples", "n_features", "n_models_attempted",
                                    "n_models_ok", "n_models_failed"), "families")


@_evq("a9_leaderboard", "SELECT dataset, key, round(f1_macro, 6) AS f1_macro, row_number() OVER (PARTITION BY dataset ORDER BY f1_macro DESC, key) AS rank FROM lb_rec")
def _a9(spark, sf):
    return _A().leaderboard(_rec(spark, sf)).select("dataset", "key", _r("f1_macro"), *_big("rank"))


@_evq("a10_top_f1", "SELECT * FROM (SELECT dataset, key, row_number() OVER (PARTITION BY dataset ORDER BY f1_macro DESC, key) AS rank FROM lb_rec) WHERE rank <= 3")
def _a10(spark, sf):
    return _A().top_k(_rec(spark, sf), "f1_macro", 3).select("dataset", "key", *_big("rank"))


@_evq("a10_fastest_train", "SELECT * FROM (SELECT dataset, key, row_number() OVER (PARTITION BY dataset ORDER BY train_time_sec ASC, key) AS rank FROM lb_rec) WHERE rank <= 3")
def _a10b(spark, sf):
    return _A().top_k(_rec(spark, sf), "train_time_sec", 3, ascending=True).select("dataset", "key", *_big("rank"))


@_evq("a11_best_fast", "SELECT dataset, key, round(train_time_sec, 9) AS train_time_sec FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY train_time_sec, key) AS rk FROM lb_rec WHERE f1_macro >= 0.8) WHERE rk = 1")
def _a11(spark, sf):
    return _A().best_fast(_rec(spark, sf)).select("dataset", "key", _r("train_time_sec", 9))


@_evq("a12_a13_family_rollup", f"""SELECT dataset, family, count, best_key, round(best_f1_macro, 6) AS best_f1_macro,
  round(avg_f1_macro, 6) AS avg_f1_macro, {O.family_group_sql()} AS "group",
  row_number() OVER (PARTITION BY dataset ORDER BY best_f1_macro DESC, family) AS rank FROM (
  SELECT dataset, family, count(*) AS count, arg_max(key, f1_macro) AS best_key, max(f1_macro) AS best_f1_macro, avg(f1_macro) AS avg_f1_macro
  FROM lb_rec GROUP BY dataset, family)""")
def _a12(spark, sf):
    r = _A().family_rollup(_rec(spark, sf))
    return r.select("dataset", "family", *_big("count"), "best_key", _r("best_f1_macro"), _r("avg_f1_macro"), "group", *_big("rank"))


@_evq("a13_group_filter", f"SELECT dataset, key, family FROM lb_rec WHERE {O.family_group_sql()} IN ('instance', 'linear', 'exotic')")
def _a13(spark, sf):
    """Only models of the active display groups."""
    return _A().filter_groups(_A().ok(_rec(spark, sf)), ["instance", "linear", "exotic"]).select("dataset", "key", "family")


@_evq("a14_speed_quality_points", f"SELECT dataset, key, round(greatest(train_time_sec, 0.001), 9) AS x, round(log10(greatest(train_time_sec, 0.001)), 6) AS log10_x, round(f1_macro, 6) AS y, {O.family_group_sql()} AS \"group\" FROM lb_rec")
def _a14(spark, sf):
    return _A().speed_quality_points(_rec(spark, sf)).select("dataset", "key", _r("x", 9), _r("log10_x"), _r("y"), "group")


@_evq("a15_class_f1_matrix", """SELECT pc.dataset, pc.model AS key, CAST(lb.rank AS BIGINT) AS row_order, pc.class, round(pc.f1, 6) AS f1
  FROM lb_pc pc JOIN (SELECT dataset, key, row_number() OVER (PARTITION BY dataset ORDER BY f1_macro DESC, key) AS rank FROM lb_rec) lb
  ON lb.dataset = pc.dataset AND lb.key = pc.model""")
def _a15(spark, sf):
    return _A().class_f1_matrix(_rec(spark, sf)).select("dataset", "key", *_big("row_order"), "class", _r("f1"))


@_evq("a16_row_normalised_cm", """SELECT dataset, model AS key, CAST(y AS BIGINT) AS y, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n,
  round(CASE WHEN sum(n) OVER (PARTITION BY dataset, model, y) = 0 THEN 0.0 ELSE n / sum(n) OVER (PARTITION BY dataset, model, y) END, 6) AS share FROM lb_cm""")
def _a16(spark, sf):
    return _A().row_normalised_cm(_rec(spark, sf)).select("dataset", "key", *_big("y", "p", "n"), _r("share"))


@_evq("a17_dynamic_sort", "SELECT dataset, key, row_number() OVER (PARTITION BY dataset ORDER BY inference_time_per_sample_ms DESC NULLS LAST, key) AS position FROM lb_rec")
def _a17(spark, sf):
    return _A().dynamic_sort(_rec(spark, sf), "inference_time_per_sample_ms", ascending=False).select("dataset", "key", *_big("position"))


@_evq("a18_failed_report", "SELECT dataset, count_if(status = 'failed') AS n_failed, count(*) AS n_attempted, round(count_if(status = 'failed') / count(*), 6) AS failed_share FROM lb_rec GROUP BY dataset")
def _a18(spark, sf):
    return _A().failed_report(_rec(spark, sf)).select("dataset", *_big("n_failed", "n_attempted"), _r("failed_share"))


@register("a19_binary_summary", _wb("""SELECT dataset, arg_max(model, (f1_malicious, model)) AS best_model, arg_min(model, (f1_malicious, model)) AS worst_model,
  round(max(f1_malicious), 6) AS best_f1_malicious, round(min(f1_malicious), 6) AS worst_f1_malicious,
  round(avg(false_negative_rate), 6) AS avg_fnr, count(*) AS n_models FROM lb_bin GROUP BY dataset"""))
def _a19(spark, sf):
    s = _A().binary_summary(_binary(spark, sf))
    return s.select("dataset", "best_model", "worst_model", _r("best_f1_malicious"), _r("worst_f1_malicious"), _r("avg_fnr"), *_big("n_models"))


def _scale_sql():
    from classyard.operators.analytics import SCALE_ROWS, TARGET_ROWS
    vals = ", ".join(f"('{k}', '{m}')" for k, m in SCALE_ROWS)
    return f"""SELECT b.dataset, b.key, b.mode,
  CASE WHEN r.train_time_sec IS NOT NULL THEN CAST(coalesce(r.subsample_cap, z.n_train) AS DOUBLE) END AS n_used,
  round(CASE WHEN r.train_time_sec IS NULL THEN NULL WHEN b.mode = 'memory_quadratic' THEN z.n_train * z.n_train * 8.0
       WHEN b.mode = 'inference_linear' THEN r.inference_time_per_sample_ms ELSE r.train_time_sec END, 6) AS current,
  round(CASE WHEN r.train_time_sec IS NULL THEN NULL
       WHEN b.mode = 'time_linear' THEN r.train_time_sec * ({TARGET_ROWS}.0 / z.n_train)
       WHEN b.mode = 'time_quadratic' THEN r.train_time_sec * ({TARGET_ROWS}.0 / z.n_train) * ({TARGET_ROWS}.0 / z.n_train)
       WHEN b.mode = 'time_cubic' THEN r.train_time_sec * ({TARGET_ROWS}.0 / z.n_train) * ({TARGET_ROWS}.0 / z.n_train) * ({TARGET_ROWS}.0 / z.n_train)
       WHEN b.mode = 'memory_quadratic' THEN z.n_train * z.n_train * 8.0 * ({TARGET_ROWS}.0 / z.n_train) * ({TARGET_ROWS}.0 / z.n_train)
       WHEN b.mode = 'inference_linear' THEN r.inference_time_per_sample_ms * ({TARGET_ROWS}.0 / z.n_train) END, 6) AS projected
  FROM (SELECT z.dataset, v.key, v.mode FROM lb_size z, (VALUES {vals}) v(key, mode)) b
  JOIN lb_size z ON z.dataset = b.dataset LEFT JOIN lb_rec r ON r.dataset = b.dataset AND r.key = b.key"""


@_evq("a21_scaling_projection", _scale_sql())
def _a21(spark, sf):
    L = _lb()
    sizes = L.lb_sizes(spark, sf)
    nt = spark.createDataFrame([(d, z["n_train"]) for d, z in sizes.items()], "dataset string, n_train long")
    s = _A().scaling_projection(_rec(spark, sf), nt)
    return s.select("dataset", "key", "mode", "n_used", _r("current"), _r("projected"))


@_evq("a22_quality_tier", "SELECT key, avg_quality, cut FROM lb_cut WHERE avg_quality >= cut")
def _a22(spark, sf):
    return _A().quality_tier(_comb(spark, sf)).select("key", "avg_quality", "cut")


@_evq("a23_a25_scenarios", f"""SELECT 'fastest_inference' AS scenario, (SELECT key FROM lb_cut WHERE avg_quality >= cut ORDER BY left_infer_ms + right_infer_ms, rank, key LIMIT 1) AS key
  UNION ALL SELECT 'fastest_training', (SELECT key FROM lb_cut WHERE avg_quality >= cut ORDER BY left_train_sec + right_train_sec, rank, key LIMIT 1)
  UNION ALL SELECT 'most_consistent', (SELECT key FROM lb_comb WHERE rank <= 20 ORDER BY consistency_gap, rank, key LIMIT 1)
  UNION ALL SELECT 'interpretable', (SELECT key FROM lb_comb WHERE {O.family_group_sql()} = 'interpretable' OR key = 'decision_tree' ORDER BY avg_composite DESC, rank, key LIMIT 1)""")
def _a2325(spark, sf):
    return _A().scenarios(_comb(spark, sf))


@_evq("a26_consistency_tables", """SELECT key, left_composite, right_composite, CAST(avg_quality >= half_cut AS BIGINT) AS top_half,
  round(greatest(left_infer_ms + right_infer_ms, 0.0005), 9) AS latency, round(log10(greatest(left_infer_ms + right_infer_ms, 0.0005)), 6) AS log10_latency FROM lb_cut""")
def _a26(spark, sf):
    t = _A().consistency_tables(_comb(spark, sf))
    return t.select("key", "left_composite", "right_composite", F.col("top_half").cast("bigint").alias("top_half"),
                    _r("latency", 9), _r("log10_latency"))


@_evq("a27_comparison_table", """SELECT key, name, family, avg_composite, avg_quality, avg_cost, consistency_gap,
  round(left_f1_macro, 6) AS left_f1_macro, round(right_f1_macro, 6) AS right_f1_macro, round(left_infer_ms, 9) AS left_infer_ms,
  row_number() OVER (ORDER BY consistency_gap ASC NULLS LAST, key) AS position FROM lb_comb""")
def _a27(spark, sf):
    t = _A().comparison_table(_comb(spark, sf), "consistency_gap", ascending=True)
    return t.select("key", "name", "family", "avg_composite", "avg_quality", "avg_cost", "consistency_gap",
                    _r("left_f1_macro"), _r("right_f1_macro"), _r("left_infer_ms", 9), *_big("position"))


# ------------------------------------------------------------------ importance
def _btrain(spark, sf, ds, raw=False):
    """Train rows of a stand-in with the benign-vs-malicious target."""
    from classyard.operators.prep import benign_relabel
    from classyard.plans.queries_base import prepared_raw
    p = prepared_raw(spark, sf, ds) if raw else prepared(spark, sf, ds)
    return benign_relabel(p.train(), p.benign_label), p.features


def _imp_sql(ds, body_ctes, body):
    return ("WITH " + O.prep_ctes(ds) + ",\n" + O.binary_train_cte(ds) + ",\n"
            + O.binary_train_cte(ds, raw=True) + body_ctes + "\n" + body)


for _ds in ["lang"]:
    def _i7(spark, sf, ds=_ds):
        from classyard.operators import importance as I
        tr, fs = _btrain(spark, sf, ds)
        return I.top_k(I.anova_f(tr, fs), fs).select("feature", _r("importance"), *_big("rank"))

    def _i6(spark, sf, ds=_ds):
        from classyard.operators import importance as I
        tr, fs = _btrain(spark, sf, ds, raw=True)
        return I.top_k(I.mutual_info_binned(tr, fs), fs).select("feature", _r("importance"), *_big("rank"))

    def _i9(spark, sf, ds=_ds):
        from classyard.operators import importance as I
        tr, fs = _btrain(spark, sf, ds)
        rtr, _ = _btrain(spark, sf, ds, raw=True)
        ov = I.overlap(I.top_k(I.mutual_info_binned(rtr, fs), fs), I.top_k(I.anova_f(tr, fs), fs))
        return ov.agg(F.count(F.lit(1)).cast("bigint").alias("shared_top5"))

    def _a20(spark, sf, ds=_ds):
        from classyard.operators import importance as I
        tr, fs = _btrain(spark, sf, ds)
        rtr, _ = _btrain(spark, sf, ds, raw=True)
        return I.filter_tables({"mutual_info": I.mutual_info_binned(rtr, fs), "anova_f": I.anova_f(tr, fs)}, fs).select(
            "method", "feature", _r("importance"), *_big("rank"))

    register(f"a20_filter_top10_{_ds}", _imp_sql(
        _ds, O.anova_ctes(_ds) + O.mi_ctes(_ds),
        f"SELECT 'mutual_info' AS method, * FROM ({O.topk_sql(_ds, f'{_ds}_mi', 10)}) "
        f"UNION ALL SELECT 'anova_f' AS method, * FROM ({O.topk_sql(_ds, f'{_ds}_anova', 10)})"))(_a20)
    register(f"i7_i5_anova_top15_{_ds}", _imp_sql(_ds, O.anova_ctes(_ds), O.topk_sql(_ds, f"{_ds}_anova")))(_i7)
    register(f"i6_i5_mutual_info_top15_{_ds}", _imp_sql(_ds, O.mi_ctes(_ds), O.topk_sql(_ds, f"{_ds}_mi")))(_i6)
    register(f"i9_top5_overlap_{_ds}", _imp_sql(
        _ds, O.anova_ctes(_ds) + O.mi_ctes(_ds),
        f"SELECT CAST(count(*) AS BIGINT) AS shared_top5 FROM (SELECT feature FROM ({O.topk_sql(_ds, f'{_ds}_mi', 5)}) "
        f"INTERSECT SELECT feature FROM ({O.topk_sql(_ds, f'{_ds}_anova', 5)}))"))(_i9)


@register("i1_permutation_importance_lang")
def _i1(spark, sf):
    """I1 for the nearest-centroid model on lang (rows check: randomised)."""
    from classyard.operators import importance as I
    p = prepared(spark, sf, "lang")
    from classyard.operators.models.base import Ctx
    fm = REGISTRY["nearest_centroid"].build().fit(p.train(), Ctx(p.features, p.k))
    return I.top_k(I.permutation_importance(fm, p.test(), p.features, p.k), p.features).select(
        "feature", _r("importance"), *_big("rank"))


# ------------------------------------------------------------------ F / P / S operators
@register("f1_f2_f3_parsers_events", """SELECT event_id,
  coalesce(CASE WHEN concat('0x', hex(user_id)) LIKE '0x%' THEN TRY_CAST(concat('0x', hex(user_id)) AS BIGINT) END, 0) AS flags,
  coalesce(TRY_CAST(trunc(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT), 0) AS k_int,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click,
  CAST(CASE WHEN CAST(value AS VARCHAR) IS NULL THEN 0 ELSE floor(length(hex(event_id)) / 2) END AS BIGINT) AS payload_bytes
  FROM events""")
def _f123(spark, sf):
    from classyard.functions.exprs import equals_indicator, hex_or_number_to_long, hex_payload_bytes
    from classyard.sources.tables import read_table
    ev = read_table(spark, sf, "events")
    return ev.select("event_id",
                     hex_or_number_to_long(F.concat(F.lit("0x"), F.hex("user_id"))).alias("flags"),
                     hex_or_number_to_long(F.get_json_object("props", "$.k")).alias("k_int"),
                     equals_indicator("event_type", "click").cast("int").alias("is_click"),
                     F.when(F.col("value").isNull(), F.lit(0)).otherwise(hex_payload_bytes(F.hex("event_id"))).cast("bigint").alias("payload_bytes"))


@register("f7_one_hot_lineitem", f"""SELECT {O.LINE_ID_SQL} AS row_id,
  CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS f_ls_F, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS f_ls_O FROM lineitem""")
def _f7(spark, sf):
    from classyard.operators.prep import one_hot
    from classyard.sources.tables import read_table
    from classyard.functions.hashing import hash_id
    from classyard.sources.standins import LINE_KEY
    li = read_table(spark, sf, "lineitem").select(hash_id(*LINE_KEY).alias("row_id"), "l_linestatus")
    return one_hot(li, "l_linestatus", ["F", "O"], "f_ls")


@register("f12_row_cap_lineitem", f"""SELECT row_id FROM (SELECT {O.LINE_ID_SQL} AS row_id FROM lineitem)
  ORDER BY md5(concat('{42}', '|', 'cap', '|', CAST(row_id AS VARCHAR))), row_id LIMIT 1000""")
def _f12(spark, sf):
    from classyard.operators.prep import cap_rows
    from classyard.sources.tables import read_table
    from classyard.functions.hashing import hash_id
    from classyard.sources.standins import LINE_KEY
    li = read_table(spark, sf, "lineitem").select(hash_id(*LINE_KEY).alias("row_id"))
    return cap_rows(li, 1000)


@register("f13_class_weights_evt", "WITH " + O.prep_ctes("evt") + """
SELECT CAST(label AS BIGINT) AS label, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 9) AS weight
FROM (SELECT label, count(*) AS n_c FROM evt_prep WHERE split = 'train' GROUP BY label)""")
def _f13(spark, sf):
    from classyard.operators.prep import balanced_weights
    p = prepared(spark, sf, "evt")
    w = balanced_weights(p.train().select("label"))
    return w.groupBy("label").agg(F.first("weight").alias("weight")).select(*_big("label"), _r("weight", 9))


@register("f14_benign_relabel_lang", "WITH " + O.prep_ctes("lang") + """
SELECT CAST(p.row_id AS BIGINT) AS row_id, CASE WHEN c.class = 'en' THEN 0 ELSE 1 END AS malicious FROM lang_prep p JOIN lang_cls c ON c.label = p.label""")
def _f14(spark, sf):
    from classyard.operators.prep import benign_relabel
    p = prepared(spark, sf, "lang")
    return benign_relabel(p.df, p.benign_label, out="malicious").select(*_big("row_id"), F.col("malicious").cast("int"))


@register("p2_undersample_evt", "WITH " + O.prep_ctes("evt") + f""",
tr AS (SELECT row_id, label FROM evt_prep WHERE split = 'train'),
m AS (SELECT min(n) AS m FROM (SELECT label, count(*) AS n FROM tr GROUP BY label)),
rep AS (SELECT r.replicate, tr.* FROM tr, (VALUES (0), (1), (2)) r(replicate))
SELECT CAST(replicate AS BIGINT) AS replicate, CAST(row_id AS BIGINT) AS row_id, CAST(label AS BIGINT) AS label FROM (
  SELECT rep.*, row_number() OVER (PARTITION BY replicate, label ORDER BY md5(concat('{42}', '|', CAST(replicate AS VARCHAR), '|', CAST(row_id AS VARCHAR))), row_id) AS rk
  FROM rep) , m WHERE rk <= m.m""")
def _p2(spark, sf):
    from classyard.operators.samplers import undersample
    p = prepared(spark, sf, "evt")
    return undersample(p.train().select("row_id", "label"), 3).select(*_big("replicate", "row_id", "label"))


_REPLICATES = "WITH " + O.prep_ctes("evt") + """,
rep AS (SELECT r.replicate, row_id, label FROM evt_prep, (VALUES (0), (1), (2)) r(replicate) WHERE split = 'train')"""


@register("p1_bootstrap_evt", _REPLICATES + f"""
SELECT CAST(replicate AS BIGINT) AS replicate, CAST(row_id AS BIGINT) AS row_id, CAST(w AS BIGINT) AS w
FROM (SELECT replicate, row_id, {O.poisson_sql(O.uniform_sql("boot", "replicate", "row_id"), 1.0)} AS w FROM rep) WHERE w > 0""")
def _p1(spark, sf):
    """P1 multiplicities for 3 replicates."""
    from classyard.operators.samplers import bootstrap
    p = prepared(spark, sf, "evt")
    return bootstrap(p.train().select("row_id", "label"), 3).select(*_big("replicate", "row_id", "w"))


@register("p3_balanced_bootstrap_evt", _REPLICATES + f""",
n AS (SELECT label, count(*) / 3 AS n_c FROM rep GROUP BY label),
rate AS (SELECT label, (SELECT min(n_c) FROM n)::DOUBLE / n_c AS lam FROM n),
cdf AS (SELECT label, {O.poisson_cdf_sql("lam", 18)} FROM rate)
SELECT CAST(replicate AS BIGINT) AS replicate, CAST(row_id AS BIGINT) AS row_id, CAST(label AS BIGINT) AS label, CAST(w AS BIGINT) AS w
FROM (SELECT replicate, row_id, label, CASE {" ".join(f"WHEN u < c{j} THEN {j}" for j in range(18))} ELSE 18 END AS w
      FROM (SELECT rep.*, {O.uniform_sql("bal", "replicate", "row_id")} AS u FROM rep) JOIN cdf USING (label)) WHERE w > 0""")
def _p3(spark, sf):
    from classyard.operators.samplers import balanced_bootstrap
    p = prepared(spark, sf, "evt")
    return balanced_bootstrap(p.train().select("row_id", "label"), 3).select(*_big("replicate", "row_id", "label", "w"))


@register("p4_one_side_sample_lineitem")
def _p4(spark, sf):
    """P4 on the distance of a line's price from the mean: large ones stay, a tenth
    of all are drawn from the others (the cut is an approximate quantile: rows check)."""
    from classyard.functions.hashing import hash_id
    from classyard.operators.samplers import one_side_sample
    from classyard.sources.standins import LINE_KEY
    from classyard.sources.tables import read_table
    li = read_table(spark, sf, "lineitem")
    mean = li.agg(F.avg("l_extendedprice")).first()[0] or 0.0
    g = li.select(hash_id(*LINE_KEY).alias("row_id"), (F.col("l_extendedprice") - mean).alias("g"))
    return one_side_sample(g, "g").select("row_id", "w")


@register("s1_csv_scan_events", "SELECT event_id, event_type, value, props FROM events")
def _s1(spark, sf):
    """Events written as header CSV files to the shared folder and scanned with a
    declared schema; quotes, commas and nulls come back."""
    import uuid
    from classyard.session import checkpoint_dir
    from classyard.sources.tables import read_csv, read_table
    path = f"{checkpoint_dir(spark).rstrip('/')}/events-csv-{uuid.uuid4().hex}"
    cols = read_table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    cols.write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path, cols.schema.simpleString()[7:-1].replace(":", " "), escape='"')


@register("f4_f5_drop_fill_events", "SELECT event_id, event_type, coalesce(value, 0.0) AS value FROM events")
def _f45(spark, sf):
    """F4 drops columns (absent names are ignored), F5 fills numeric nulls with 0."""
    from classyard.operators.prep import drop_columns, fill_zero
    from classyard.sources.tables import read_table
    ev = read_table(spark, sf, "events")
    return fill_zero(drop_columns(ev, [c for c in ev.columns if c not in ("event_id", "event_type", "value")] + ["absent"]), ["value"])


@register("f8_assemble_line", "WITH " + O.prep_ctes("line") + f""",
x AS (SELECT row_id, [{", ".join(O.feats("line"))}] AS v FROM line_prep WHERE split = 'test')
SELECT row_id, CAST(j AS BIGINT) AS j, round(v[j + 1], 6) AS x FROM x, unnest(range({len(O.feats("line"))})) AS u(j)""")
def _f8(spark, sf):
    """F8: features in one vector, in order."""
    from pyspark.ml.functions import vector_to_array
    from classyard.operators.prep import assemble
    p = prepared(spark, sf, "line")
    v = assemble(p.test(), p.features).select("row_id", F.posexplode(vector_to_array("features")).alias("j", "x"))
    return v.select("row_id", *_big("j"), _r("x"))


@register("s2_concat_sources", """SELECT event_type, count(*) AS n FROM (
  SELECT event_id, event_type FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, event_type FROM events WHERE event_type <> 'view')
  GROUP BY event_type""")
def _s2(spark, sf):
    from classyard.sources.tables import concat_sources, read_table
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    u = concat_sources(ev.where("event_type = 'view'"), ev.where("event_type <> 'view'"))
    return u.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@_evq("s3_s4_result_roundtrip", "SELECT dataset, key, round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy FROM lb_rec")
def _s34(spark, sf):
    import uuid
    from classyard.session import checkpoint_dir
    from classyard.sources.results import read_results, write_results
    path = f"{checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    write_results(_lb().lb_records(spark, sf), path)
    return read_results(spark, path).select("dataset", "key", _r("f1_macro"), _r("accuracy"))


@register("s5_merge_documents")
def _s5(spark, sf):
    """Importance table + binary view folded into one JSON document per dataset (rows check)."""
    from classyard.operators import importance as I
    from classyard.sources.results import merge_documents
    tr, fs = _btrain(spark, sf, "lang")
    imp = I.top_k(I.anova_f(tr, fs), fs).select(F.lit("lang").alias("dataset"), F.lit("anova_f").alias("method"),
                                                "rank", "feature", "importance")
    return merge_documents(imp, _binary(spark, sf))


# ------------------------------------------------------------------ rows-checked models
# Randomised / iterative estimators have no exact SQL form: the driver gets a
# rows-only check, our tests pin them against NumPy and invariants.
ROWS_MODELS = ["extra_tree", "logreg_elasticnet", "linear_svc", "sgd_modified_huber", "sgd_log", "sgd_hinge", "ridge", "lda", "qda", "elm", "rbf_sampler_ridge", "decision_tree", "random_forest", "bagging_dt",
               "perceptron", "passive_aggressive", "nystroem_sgd", "gaussian_process", "label_spreading",
               "som_classifier", "bagging_knn", "logreg", "extra_trees", "balanced_random_forest", "balanced_bagging",
               "figs", "rgf", "adaboost"]

for _m in ROWS_MODELS:
    def _rows(spark, sf, m=_m):
        from classyard.operators.prep import cap_rows
        from classyard.operators.models.base import Ctx
        p = prepared(spark, sf, "lang")
        spec = REGISTRY[m]
        tr = cap_rows(p.train(), spec.subsample_cap) if spec.subsample_cap else p.train()
        fm = spec.build().fit(tr, Ctx(p.features, p.k))
        return fm.predict(p.test()).select(*_big("row_id", "y", "p"))
    register(f"{_m}_lang")(_rows)


@register("hist_boosting_core_5rounds_lang")
def _hbc(spark, sf):
    """The histogram boosting core (xgboost-style depth 6) with 5 rounds."""
    from classyard.operators.models import hist_tree
    from classyard.operators.models.base import Ctx
    p = prepared(spark, sf, "lang")
    fm = hist_tree.HistGBM(n_rounds=5, lr=0.1, depth=6).fit(p.train(), Ctx(p.features, p.k))
    return fm.predict(p.test()).select(*_big("row_id", "y", "p"))


@register("streaming_windowed_confusion_evt")
def _stream(spark, sf):
    """Structured Streaming: fitted model scoring the events stream (rows check)."""
    from classyard.streaming.score import windowed_confusion
    return windowed_confusion(spark, sf).select("window_start", *_big("y", "p", "n"))


@register("i1_permutation_importance_line")
def _i1_line(spark, sf):
    """I1 on wide (60-bit) row ids, over all test rows (rows check)."""
    from classyard.operators import importance as I
    from classyard.operators.models.base import Ctx
    p = prepared(spark, sf, "line")
    fm = REGISTRY["nearest_centroid"].build().fit(p.train(), Ctx(p.features, p.k))
    return I.top_k(I.permutation_importance(fm, p.test(), p.features, p.k), p.features).select(
        "feature", _r("importance"), *_big("rank"))


@register("i4_additive_importance_lang")
def _i4(spark, sf):
    """I4: mean absolute contribution of each shape function of an additive
    booster (rows check)."""
    from classyard.operators import importance as I
    from classyard.operators.models import hist_tree
    from classyard.operators.models.base import Ctx
    p = prepared(spark, sf, "lang")
    fm = hist_tree.HistGBM(n_rounds=2 * len(p.features), lr=0.1, depth=2, cyclic=True, hess_scale=1.0, lam=0.0,
                           min_child_weight=0.0, min_child_samples=2).fit(p.train(), Ctx(p.features, p.k))
    return I.top_k(I.additive_importance(fm, p.train(), p.features), p.features).select("feature", _r("importance"), *_big("rank"))


@register("i8_family_panel_lang")
def _i8(spark, sf):
    """I8: native + permutation importance for representative families (rows check)."""
    from classyard.operators import importance as I
    p = prepared(spark, sf, "lang")
    panel = I.family_panel(spark, p, ["random_forest", "logreg", "knn5", "nearest_centroid"])
    return panel.select("model", "method", *_big("rank"), "feature", _r("importance"))


for _name, _kw in [("leafwise", dict(depth=10, policy="leaves", max_leaves=31, min_child_samples=20, hess_scale=1.0, lam=0.0)),
                   ("oblivious", dict(depth=6, policy="oblivious", lam=3.0, hess_scale=1.0))]:
    def _hbc_p(spark, sf, kw=_kw):
        """The histogram boosting core with a leaf-budget / oblivious growth policy, 5 rounds."""
        from classyard.operators.models import hist_tree
        from classyard.operators.models.base import Ctx
        p = prepared(spark, sf, "lang")
        fm = hist_tree.HistGBM(n_rounds=5, lr=0.1, **kw).fit(p.train(), Ctx(p.features, p.k))
        return fm.predict(p.test()).select(*_big("row_id", "y", "p"))
    register(f"hist_boosting_{_name}_5rounds_lang")(_hbc_p)
