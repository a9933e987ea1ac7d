"""ANSI-SQL (DuckDB dialect) formulations of the registered queries.

The SQL here is the independent check of the Spark plans: the same data
preparation (letter shares, sorted class dictionary, md5-ordered per-class
test quotas with integer arithmetic, population-std scaling) and the same
closed-form models, written as joins and aggregates over the raw tables.
Wide feature lists are generated, so the text stays in step with the
feature definitions in ``sources/standins.py``.
"""
from __future__ import annotations

import math

from classyard.functions.exprs import LETTERS
from classyard.functions.hashing import SEED

DATASETS = {
    "lang": dict(benign="en"),
    "evt": dict(benign="view"),
    "emb": dict(benign="0"),
    "tox": dict(benign="q1_t0"),
    "qual": dict(benign="1"),
    "line": dict(benign="N"),
}

LINE_ID_SQL = ("CAST(concat('0x', substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
               "CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), 1, 15)) AS BIGINT)")

# exact all-pairs kNN in SQL is only run where the pair count is small
KNN_ORACLE = {"lang", "evt", "emb", "tox", "qual"}


def feats(ds: str) -> list[str]:
    if ds == "lang":
        return [f"f_{i:02d}" for i in range(len(LETTERS))]
    if ds == "evt":
        return ["f_value", "f_k", "f_hour", "f_dow"]
    if ds == "emb":
        return [f"f_{i:02d}" for i in range(64)]
    if ds in ("tox", "qual"):
        return [f"f_{i:02d}" for i in range(len(LETTERS))] + ["f_nchars"]
    if ds == "line":
        return ["f_qty", "f_price", "f_disc", "f_tax", "f_ls_F", "f_ls_O"]
    raise KeyError(ds)


def _letter_cols() -> str:
    t = "lower(text)"
    return ", ".join(
        f"CASE WHEN length({t}) = 0 THEN 0.0 ELSE "
        f"(length({t}) - length(replace({t}, '{ch}', ''))) / length({t}) END AS f_{i:02d}"
        for i, ch in enumerate(LETTERS))


def raw_sql(ds: str) -> str:
    if ds == "lang":
        return f"SELECT doc_id AS row_id, lang AS cls, {_letter_cols()} FROM documents"
    if ds == "tox":
        return (f"SELECT d.doc_id AS row_id, concat('q', CAST(l.quality AS VARCHAR), '_t', CAST(l.toxic AS VARCHAR)) AS cls, "
                f"{_letter_cols()}, CAST(d.n_chars AS DOUBLE) AS f_nchars FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    if ds == "qual":
        return (f"SELECT d.doc_id AS row_id, CAST(l.quality AS VARCHAR) AS cls, {_letter_cols()}, "
                f"CAST(d.n_chars AS DOUBLE) AS f_nchars FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    if ds == "line":
        return (f"SELECT {LINE_ID_SQL} AS row_id, l_returnflag AS cls, l_quantity AS f_qty, "
                "l_extendedprice AS f_price, l_discount AS f_disc, l_tax AS f_tax, "
                "CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS f_ls_F, "
                "CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS f_ls_O FROM lineitem")
    if ds == "emb":
        cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f_{i:02d}" for i in range(64))
        return f"SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS cls, {cols} FROM embeddings"
    if ds == "evt":
        return ("SELECT event_id AS row_id, event_type AS cls, coalesce(value, 0.0) AS f_value, "
                "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS f_k, "
                "CAST(hour(ts) AS DOUBLE) AS f_hour, CAST(dayofweek(ts) AS DOUBLE) AS f_dow FROM events")
    raise KeyError(ds)


def prep_ctes(ds: str, scale: bool = True) -> str:
    """CTEs ending in ``{ds}_prep(row_id, split, label, f_*)`` and ``{ds}_cls``."""
    fs = feats(ds)
    p = ds
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in fs)
    scaled = ", ".join(
        f"({f} - m_{f}) / (CASE WHEN s_{f} IS NULL OR s_{f} < 1e-12 THEN 1.0 ELSE s_{f} END) AS {f}" for f in fs)
    plain = ", ".join(fs)
    return f"""
{p}_raw AS ({raw_sql(ds)}),
{p}_cls AS (SELECT cls AS class, CAST(row_number() OVER (ORDER BY cls) - 1 AS INTEGER) AS label
            FROM (SELECT DISTINCT cls FROM {p}_raw)),
{p}_lab AS (SELECT r.*, c.label, md5(concat('{SEED}', '|', CAST(r.row_id AS VARCHAR))) AS hkey
            FROM {p}_raw r JOIN {p}_cls c ON r.cls = c.class),
{p}_cnt AS (SELECT label, count(*) AS n_c FROM {p}_lab GROUP BY label),
{p}_tot AS (SELECT sum(n_c) AS n, (3 * sum(n_c) + 9) // 10 AS n_test FROM {p}_cnt),
{p}_q0 AS (SELECT label, (n_test * n_c) // n AS base, (n_test * n_c) % n AS rem, n_test FROM {p}_cnt, {p}_tot),
{p}_quota AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                     <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM {p}_q0),
{p}_split AS (SELECT l.*, CASE WHEN row_number() OVER (PARTITION BY l.label ORDER BY hkey, row_id) <= q.quota
                          THEN 'test' ELSE 'train' END AS split
              FROM {p}_lab l JOIN {p}_quota q ON l.label = q.label),
{p}_stats AS (SELECT {stats} FROM {p}_split WHERE split = 'train'),
{p}_prep AS (SELECT row_id, split, label, {scaled if scale else plain} FROM {p}_split, {p}_stats)"""


def uniform_sql(tag: str, *cols: str) -> str:
    """Hashed uniform of ``functions.hashing``: 52 bits of an md5 key."""
    parts = ", '|', ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST(concat('0x', substr(md5(concat('{SEED}', '|', '{tag}', '|', {parts})), 1, 13)) AS BIGINT)::DOUBLE / {1 << 52}"


def poisson_sql(u: str, lam: float, most: int = 12) -> str:
    """Poisson number by inverse CDF, with the cumulated shares written out."""
    p, c, cases = math.exp(-lam), 0.0, []
    for j in range(most):
        c += p
        p *= lam / (j + 1)
        cases.append(f"WHEN {u} < {c!r}::DOUBLE THEN {j}")
    return f"CASE {' '.join(cases)} ELSE {most} END"


def poisson_cdf_sql(lam: str, most: int) -> str:
    """Columns c0 ... of cumulated shares for a column of rates."""
    cols = [f"exp(-{lam}) AS p0", "p0 AS c0"]
    for j in range(1, most):
        cols += [f"p{j - 1} * {lam} / {j} AS p{j}", f"c{j - 1} + p{j} AS c{j}"]
    return ", ".join(cols)


def _sum(terms: list[str]) -> str:
    return " + ".join(terms)


def model_ctes(ds: str, model: str) -> str:
    """CTE ``{ds}_{model}_pred(row_id, y, p)`` over ``{ds}_prep``."""
    fs = feats(ds)
    p = f"{ds}_{model}"
    tr, te = f"(SELECT * FROM {ds}_prep WHERE split = 'train')", f"(SELECT * FROM {ds}_prep WHERE split = 'test')"
    pick = (f"{p}_pred AS (SELECT row_id, y, p FROM (SELECT row_id, y, label AS p, "
            f"row_number() OVER (PARTITION BY row_id ORDER BY score {{order}}, label) AS rk FROM {p}_sc) WHERE rk = 1)")
    if model == "nearest_centroid":
        cent = ", ".join(f"avg({f}) AS c_{f}" for f in fs)
        d = _sum([f"(t.{f} - c.c_{f}) * (t.{f} - c.c_{f})" for f in fs])
        return f""",
{p}_c AS (SELECT label, {cent} FROM {tr} GROUP BY label),
{p}_sc AS (SELECT t.row_id, t.label AS y, c.label, {d} AS score FROM {te} t, {p}_c c),
{pick.format(order='ASC')}"""
    if model == "gnb":
        st = ", ".join(f"avg({f}) AS mu_{f}, var_pop({f}) AS v_{f}" for f in fs)
        gv = ", ".join(f"var_pop({f})" for f in fs)
        const = _sum([f"ln(2 * pi() * (v_{f} + e.eps))" for f in fs])
        quad = _sum([f"(t.{f} - c.mu_{f}) * (t.{f} - c.mu_{f}) / (2 * (c.v_{f} + e.eps))" for f in fs])
        return f""",
{p}_c0 AS (SELECT label, count(*) AS n_c, {st} FROM {tr} GROUP BY label),
{p}_e AS (SELECT 1e-9 * greatest({gv}) AS eps FROM {tr}),
{p}_c AS (SELECT c0.*, ln(n_c / sum(n_c) OVER ()) - 0.5 * ({const}) AS k0 FROM {p}_c0 c0, {p}_e e),
{p}_sc AS (SELECT t.row_id, t.label AS y, c.label, c.k0 - ({quad}) AS score FROM {te} t, {p}_c c, {p}_e e),
{pick.format(order='DESC')}"""
    if model == "bnb":
        st = ", ".join(f"sum(CASE WHEN {f} > 0 THEN 1 ELSE 0 END) AS fc_{f}" for f in fs)
        flp = ", ".join(f"ln((fc_{f} + 1.0) / (n_c + 2.0)) AS l_{f}" for f in fs)
        neg = lambda f: f"ln(1 - exp(l_{f}))"
        w = _sum([f"CASE WHEN t.{f} > 0 THEN c.l_{f} - ln(1 - exp(c.l_{f})) ELSE 0 END" for f in fs])
        base = _sum([neg(f) for f in fs])
        return f""",
{p}_c0 AS (SELECT label, count(*) AS n_c, {st} FROM {tr} GROUP BY label),
{p}_c1 AS (SELECT label, n_c, {flp} FROM {p}_c0),
{p}_c AS (SELECT *, ({base}) + ln(n_c / sum(n_c) OVER ()) AS b FROM {p}_c1),
{p}_sc AS (SELECT t.row_id, t.label AS y, c.label, ({w}) + c.b AS score FROM {te} t, {p}_c c),
{pick.format(order='DESC')}"""
    if model == "cnb":
        mm = ", ".join(f"min({f}) AS lo_{f}, CASE WHEN max({f}) - min({f}) = 0 THEN 1.0 ELSE max({f}) - min({f}) END AS r_{f}" for f in fs)
        x = lambda a, f: f"(({a}.{f} - m.lo_{f}) / m.r_{f})"
        fc = ", ".join(f"sum({x('t', f)}) AS fc_{f}" for f in fs)
        comp = ", ".join(f"sum(fc_{f}) OVER () - fc_{f} + 1.0 AS cc_{f}" for f in fs)
        tot = _sum([f"cc_{f}" for f in fs])
        w = ", ".join(f"-ln(cc_{f} / ({tot})) AS w_{f}" for f in fs)
        sc = _sum([f"{x('t', f)} * c.w_{f}" for f in fs])
        return f""",
{p}_mm AS (SELECT {mm} FROM {tr}),
{p}_c0 AS (SELECT t.label, {fc} FROM {tr} t, {p}_mm m GROUP BY t.label),
{p}_c1 AS (SELECT label, {comp} FROM {p}_c0),
{p}_c AS (SELECT label, {w} FROM {p}_c1),
{p}_sc AS (SELECT t.row_id, t.label AS y, c.label, {sc} AS score FROM {te} t, {p}_c c, {p}_mm m),
{pick.format(order='DESC')}"""
    if model in ("knn5", "knn15_distance"):
        k = 5 if model == "knn5" else 15
        d = _sum([f"(t.{f} - r.{f}) * (t.{f} - r.{f})" for f in fs])
        if model == "knn5":
            wexpr = "1.0"
        else:
            wexpr = ("CASE WHEN max(CASE WHEN d2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id) = 1 "
                     "THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / sqrt(d2) END")
        return f""",
{p}_d AS (SELECT t.row_id, t.label AS y, r.row_id AS nb_row, r.label, round({d}, 10) AS d2
          FROM {te} t, {tr} r),
{p}_nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, nb_row) AS rk FROM {p}_d) WHERE rk <= {k}),
{p}_sc AS (SELECT row_id, y, label, sum(w) AS score FROM (SELECT *, {wexpr} AS w FROM {p}_nb) GROUP BY row_id, y, label),
{pick.format(order='DESC')}"""
    raise KeyError(model)


def with_(*ctes: str) -> str:
    body = ",".join(c.strip().lstrip(",") for c in ctes)
    return "WITH " + body + "\n"


# ---------------------------------------------------------------- leaderboard
def leaderboard_ctes() -> str:
    """All CTEs up to ``lb_rec`` (flat result records with modeled costs),
    ``lb_pc`` (per-class metrics), ``lb_cm`` (dense confusion counts)."""
    from classyard.operators.models.registry import REGISTRY, SQL_EXACT
    from classyard.plans.leaderboard import DATASETS, INFER_FACTOR, TRAIN_PASSES, UNIT
    parts = []
    for ds in DATASETS:
        parts.append(prep_ctes(ds))
        for m in SQL_EXACT:
            parts.append(model_ctes(ds, m))
    preds = " UNION ALL ".join(f"SELECT '{ds}' AS dataset, '{m}' AS model, row_id, y, p FROM {ds}_{m}_pred"
                               for ds in DATASETS for m in SQL_EXACT)
    cls = " UNION ALL ".join(f"SELECT '{ds}' AS dataset, label, class FROM {ds}_cls" for ds in DATASETS)
    sizes = " UNION ALL ".join(
        f"SELECT '{ds}' AS dataset, count_if(split = 'train') AS n_train, count_if(split = 'test') AS n_test, "
        f"{len(feats(ds))} AS d, (SELECT count(*) FROM {ds}_cls) AS k FROM {ds}_prep" for ds in DATASETS)
    benign = " UNION ALL ".join(
        f"SELECT '{ds}' AS dataset, label AS benign_label FROM {ds}_cls WHERE class = '{DATASETS_BENIGN[ds]}'"
        for ds in DATASETS)
    reg = ", ".join(
        "('{k}', '{n}', '{f}', {tp}, '{fac}')".format(k=m, n=REGISTRY[m].name.replace("'", "''"),
                                                     f=REGISTRY[m].family, tp=TRAIN_PASSES[m], fac=INFER_FACTOR[m])
        for m in SQL_EXACT)
    lb = f"""
lb_pred AS ({preds}),
lb_cls AS ({cls}),
lb_size AS ({sizes}),
lb_benign AS ({benign}),
lb_reg(key, name, family, passes, fac) AS (VALUES {reg}),
lb_cnt AS (SELECT dataset, model, y, p, count(*) AS n FROM lb_pred GROUP BY dataset, model, y, p),
lb_models AS (SELECT DISTINCT dataset, model FROM lb_pred),
lb_cm AS (SELECT m.dataset, m.model, a.label AS y, b.label AS p, coalesce(c.n, 0) AS n
          FROM lb_models m JOIN lb_cls a ON a.dataset = m.dataset JOIN lb_cls b ON b.dataset = m.dataset
          LEFT JOIN lb_cnt c ON c.dataset = m.dataset AND c.model = m.model AND c.y = a.label AND c.p = b.label),
lb_pc0 AS (SELECT c.dataset, c.model, k.label, k.class,
                  sum(CASE WHEN c.y = k.label THEN n ELSE 0 END) AS support,
                  sum(CASE WHEN c.p = k.label THEN n ELSE 0 END) AS predicted,
                  sum(CASE WHEN c.y = k.label AND c.p = k.label THEN n ELSE 0 END) AS tp
           FROM lb_cm c JOIN lb_cls k ON k.dataset = c.dataset GROUP BY c.dataset, c.model, k.label, k.class),
lb_pc AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
                    CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
                    CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END AS f1
          FROM lb_pc0),
lb_sum AS (SELECT dataset, model,
                  sum(tp) / sum(support) AS accuracy,
                  sum(CASE WHEN support > 0 OR predicted > 0 THEN precision ELSE 0 END) / count_if(support > 0 OR predicted > 0) AS precision_macro,
                  sum(CASE WHEN support > 0 OR predicted > 0 THEN recall ELSE 0 END) / count_if(support > 0 OR predicted > 0) AS recall_macro,
                  sum(CASE WHEN support > 0 OR predicted > 0 THEN f1 ELSE 0 END) / count_if(support > 0 OR predicted > 0) AS f1_macro,
                  sum(precision * support) / sum(support) AS precision_weighted,
                  sum(recall * support) / sum(support) AS recall_weighted,
                  sum(f1 * support) / sum(support) AS f1_weighted
           FROM lb_pc GROUP BY dataset, model),
lb_rec AS (SELECT s.*, s.model AS key, r.name, r.family, 'ok' AS status, CAST(NULL AS INTEGER) AS subsample_cap,
                  z.n_train * z.d * r.passes * {UNIT} AS train_time_sec,
                  z.n_test * z.d * (CASE WHEN r.fac = 'k' THEN z.k ELSE z.n_train END) * {UNIT} AS inference_time_sec,
                  z.n_test * z.d * (CASE WHEN r.fac = 'k' THEN z.k ELSE z.n_train END) * {UNIT} / z.n_test * 1000.0 AS inference_time_per_sample_ms,
                  z.n_train AS n_train_samples, z.n_test AS n_test_samples, z.d AS n_features
           FROM lb_sum s JOIN lb_reg r ON r.key = s.model JOIN lb_size z ON z.dataset = s.dataset)"""
    return ",".join(p.strip().lstrip(",") for p in parts) + "," + lb


DATASETS_BENIGN = {k: v["benign"] for k, v in DATASETS.items()}


def _mm(c: str, invert: bool = False) -> str:
    lo, hi = f"min({c}) OVER (PARTITION BY dataset)", f"max({c}) OVER (PARTITION BY dataset)"
    n = f"(({c} - {lo}) / (CASE WHEN {hi} - {lo} = 0 THEN 1.0 ELSE {hi} - {lo} END))"
    return f"(1 - {n})" if invert else n


def analytics_ctes() -> str:
    """leaderboard + rarest class, per-dataset scores and the combined table."""
    from classyard.operators.analytics import (COST_WEIGHT, QUALITY_WEIGHT, W_F1_MACRO, W_F1_WEIGHTED,
                                               W_INFER, W_RARE_CLASS, W_TRAIN)
    from classyard.plans.leaderboard import LEFT, RIGHT
    q = f"{W_F1_MACRO} * {_mm('f1_macro')} + {W_F1_WEIGHTED} * {_mm('f1_weighted')} + {W_RARE_CLASS} * {_mm('rare_class_f1')}"
    c = f"{W_INFER} * {_mm('inference_time_per_sample_ms', True)} + {W_TRAIN} * {_mm('train_time_sec', True)}"
    return leaderboard_ctes() + f""",
lb_rare AS (SELECT dataset, class AS rare_class FROM (SELECT dataset, class,
            row_number() OVER (PARTITION BY dataset ORDER BY support, label) AS rk FROM lb_pc) WHERE rk = 1),
lb_sc0 AS (SELECT r.*, ra.rare_class, pc.f1 AS rare_class_f1 FROM lb_rec r JOIN lb_rare ra ON ra.dataset = r.dataset
           JOIN lb_pc pc ON pc.dataset = r.dataset AND pc.model = r.key AND pc.class = ra.rare_class),
lb_sc1 AS (SELECT *, {q} AS q, {c} AS c FROM lb_sc0),
lb_scores AS (SELECT dataset, key, name, family, f1_macro, f1_weighted, accuracy, rare_class, rare_class_f1,
                     train_time_sec, inference_time_per_sample_ms AS infer_ms,
                     round(q * 100, 2) AS quality_score, round(c * 100, 2) AS cost_score,
                     round(({QUALITY_WEIGHT} * q + {COST_WEIGHT} * c) * 100, 2) AS composite_score FROM lb_sc1),
lb_comb0 AS (SELECT a.key, a.name, a.family,
                    round((a.composite_score + b.composite_score) / 2, 2) AS avg_composite,
                    round((a.quality_score + b.quality_score) / 2, 2) AS avg_quality,
                    round((a.cost_score + b.cost_score) / 2, 2) AS avg_cost,
                    round(abs(a.composite_score - b.composite_score), 2) AS consistency_gap,
                    a.composite_score AS left_composite, b.composite_score AS right_composite,
                    a.infer_ms AS left_infer_ms, b.infer_ms AS right_infer_ms,
                    a.train_time_sec AS left_train_sec, b.train_time_sec AS right_train_sec,
                    a.f1_macro AS left_f1_macro, b.f1_macro AS right_f1_macro
             FROM (SELECT * FROM lb_scores WHERE dataset = '{LEFT}') a JOIN (SELECT * FROM lb_scores WHERE dataset = '{RIGHT}') b ON a.key = b.key),
lb_comb AS (SELECT *, row_number() OVER (ORDER BY avg_composite DESC, key) AS rank FROM lb_comb0),
lb_cut AS (SELECT *, max(CASE WHEN i = floor(n * 0.25) THEN avg_quality END) OVER () AS cut,
                     max(CASE WHEN i = floor(n * 0.5) THEN avg_quality END) OVER () AS half_cut
           FROM (SELECT *, row_number() OVER (ORDER BY avg_quality DESC, key) - 1 AS i, count(*) OVER () AS n FROM lb_comb))"""


def family_group_sql(col: str = "family") -> str:
    from classyard.operators.analytics import FAMILY_GROUP
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY_GROUP.items())
    return f"(CASE {col} {whens} ELSE 'exotic' END)"


# ---------------------------------------------------------------- importance
def binary_train_cte(ds: str, raw: bool = False) -> str:
    """Train rows with the benign-vs-malicious target; ``raw``: unscaled features."""
    fs = feats(ds)
    b = DATASETS[ds]["benign"]
    name, src = (f"{ds}_btr_raw", f"{ds}_split") if raw else (f"{ds}_btr", f"{ds}_prep")
    return (f"{name} AS (SELECT p.row_id, CASE WHEN c.class = '{b}' THEN 0 ELSE 1 END AS y, "
            + ", ".join(f"p.{f}" for f in fs) + f" FROM {src} p JOIN {ds}_cls c ON c.label = p.label WHERE p.split = 'train')")


def anova_ctes(ds: str) -> str:
    fs = feats(ds)
    lg = " UNION ALL ".join(f"SELECT {i} AS fi, y, {f} AS x FROM {ds}_btr" for i, f in enumerate(fs))
    return f""",
{ds}_av_g AS (SELECT fi, y, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM ({lg}) GROUP BY fi, y),
{ds}_av_t AS (SELECT fi, sum(n) AS nn, sum(s) AS s, sum(ss) AS ss, count(*) AS k, sum(s * s / n) AS b FROM {ds}_av_g GROUP BY fi),
{ds}_anova AS (SELECT fi, CASE WHEN ss - b > 0 THEN ((b - s * s / nn) / (k - 1)) / ((ss - b) / (nn - k)) ELSE 0.0 END AS score FROM {ds}_av_t)"""


def mi_ctes(ds: str, bins: int = 16) -> str:
    fs = feats(ds)
    mm = ", ".join(f"min({f}) AS lo_{i}, max({f}) AS hi_{i}" for i, f in enumerate(fs))
    lg = " UNION ALL ".join(
        f"SELECT {i} AS fi, y, CASE WHEN hi_{i} = lo_{i} THEN 0 ELSE least(floor(({f} - lo_{i}) / (hi_{i} - lo_{i}) * {bins}), {bins - 1}) END AS b "
        f"FROM {ds}_btr_raw, {ds}_mm" for i, f in enumerate(fs))
    return f""",
{ds}_mm AS (SELECT {mm} FROM {ds}_btr_raw),
{ds}_mi_c AS (SELECT fi, b, y, count(*) AS n FROM ({lg}) GROUP BY fi, b, y),
{ds}_mi_c2 AS (SELECT *, sum(n) OVER (PARTITION BY fi) AS nn, sum(n) OVER (PARTITION BY fi, b) AS nb,
               sum(n) OVER (PARTITION BY fi, y) AS ny FROM {ds}_mi_c),
{ds}_mi AS (SELECT fi, sum((n / nn) * ln((CAST(n AS DOUBLE) * nn) / (CAST(nb AS DOUBLE) * ny))) AS score FROM {ds}_mi_c2 GROUP BY fi)"""


def topk_sql(ds: str, scores: str, k: int = 15) -> str:
    fs = feats(ds)
    names = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(fs))
    return (f"SELECT feature, round(importance, 6) AS importance, rank FROM (SELECT CASE fi {names} END AS feature, importance, "
            f"row_number() OVER (ORDER BY importance DESC, fi DESC) AS rank FROM (SELECT fi, CASE WHEN sum(score) OVER () > 0 "
            f"THEN score / sum(score) OVER () ELSE score END AS importance FROM {scores})) WHERE rank <= {k}")
