"""Toxicity by cumulative-link (proportional-odds) ordinal regression.

Severity grades 0 < 1 < ... share one weight vector over sparse hashed text
features; only the ordered thresholds differ: P(grade <= k) = s(theta_k - w.x).
Scoring gives the expected severity and rejects documents that are likelier
toxic (grade >= 1) than not.

Features are the lower-cased words (runs of letters and digits) and their first
four and five bytes, hashed; a value is log(1 + count).  The model is fitted on a
bounded sample of labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN`` documents, first in
hash order; counts and scores cover every document).  Labels with two values are
graded by the text: toxic documents with at least the median signal (summed
values of toxic features) are severe (2), the others mild (1).  Labels with more values are grades.

Null or empty texts have no features, severity by the thresholds alone, and are
kept.  Null labels and labels without a document are ignored; a document that is
labelled more than once has its highest label; without any toxic label all
documents get severity 0.  Repeated rows are scored alike; an empty table gives
no rows.  Only doc_id and text are read, so other columns cannot clash.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.llm.textvec import Buffer, mix64
from classyard.llm.tokens import text_slices

DIM = 1 << 20
MAX_TOXIC, MAX_CLEAN = 1500, 4500
MIN_RATIO, MIN_G = 8.0, 25.0     # of a feature: rate among toxic against clean documents, and G statistic
PREFIXES = (4, 5)

_DULL = np.ones(256, bool)
_DULL[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature) of all words and prefixes; words per text."""
    buf = Buffer(texts, lower=True)
    start, end, doc = buf.words(_DULL)
    ids, docs = [buf.hash(start, end)], [doc]
    for k, n in enumerate(PREFIXES):
        long = end - start > n
        ids.append(mix64(buf.hash(start[long], start[long] + n) + np.uint64(k + 1)))
        docs.append(doc[long])
    return np.concatenate(docs), (np.concatenate(ids) % np.uint64(DIM)).astype(np.int64), np.bincount(doc, minlength=len(buf.ends))


class Model:
    """Weights of the selected features (ascending ids) and the thresholds."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, theta: np.ndarray):
        self.ids, self.weight, self.theta = ids, weight, theta

    def at_least(self, texts) -> np.ndarray:
        """P(grade >= k) for k = 1 ..., a column each."""
        n = len(texts)
        if not len(self.theta):
            return np.zeros((n, 1))
        doc, feature, _ = features(texts)
        at = np.minimum(np.searchsorted(self.ids, feature), len(self.ids) - 1) if len(self.ids) else feature
        hit = self.ids[at] == feature if len(self.ids) else np.zeros(len(feature), bool)
        pair, count = np.unique(doc[hit] * DIM + at[hit], return_counts=True)
        score = np.bincount(pair // DIM, weights=self.weight[pair % DIM] * np.log1p(count), minlength=n)
        return _sigmoid(score[:, None] - self.theta[None, :])


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sketch(ids: bytes) -> tuple[int, int]:
    """Two min-hashes of a document's features: near copies mostly agree."""
    f = np.frombuffer(bytes(ids), "<i4").astype(np.uint64)
    return tuple(int(mix64(f + np.uint64(k << 32)).min()) if len(f) else 0 for k in (1, 2))


def _g_statistic(a, b, n_a: int, n_b: int) -> np.ndarray:
    """Log-likelihood ratio of a feature's rates in two groups of documents."""
    def term(x, n, rate):
        return np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(n * rate, 1e-12)), 0.0)
    rate = (a + b) / (n_a + n_b)
    return 2 * (term(a, n_a, rate) + term(n_a - a, n_a, 1 - rate) + term(b, n_b, rate) + term(n_b - b, n_b, 1 - rate))


def fit_ordinal(row, col, val, grade, dim: int, rounds: int = 400, l2: float = 5e-5, rate: float = 0.05):
    """Weights and ordered thresholds of the proportional-odds likelihood by
    full-batch Adam on sparse (row, col, val) triples."""
    n, top = len(grade), int(grade.max())
    row_weight = 1 / n
    p = np.zeros(dim + top)                     # weights, first threshold, log gaps
    m, v = np.zeros_like(p), np.zeros_like(p)

    def thresholds(p):
        return p[dim] + np.concatenate([[0.0], np.cumsum(np.exp(p[dim + 1:]))])
    for t in range(1, rounds + 1):
        theta = thresholds(p)
        x = np.bincount(row, weights=val * p[col], minlength=n)
        cum = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None, :] - x[:, None]), np.ones((n, 1))], axis=1)
        each = np.maximum(cum[np.arange(n), grade + 1] - cum[np.arange(n), grade], 1e-12)
        slope = cum * (1 - cum)
        up, lo = slope[np.arange(n), grade + 1] / each, slope[np.arange(n), grade] / each
        g = np.zeros_like(p)
        gx = row_weight * (up - lo)             # of minus log likelihood, by x
        g[:dim] = np.bincount(col, weights=val * gx[row], minlength=dim) + l2 * p[:dim]
        gt = np.zeros(top)
        for k in range(top):
            gt[k] = np.sum(row_weight * ((grade == k + 1) * lo - (grade == k) * up))
        g[dim] = gt.sum()
        for k in range(1, top):
            g[dim + k] = gt[k:].sum() * np.exp(p[dim + k])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return p[:dim], thresholds(p)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled sample.  The driver receives at most
    MAX_TOXIC + MAX_CLEAN documents as sparse counts."""
    none = Model(np.empty(0, np.int64), np.empty(0), np.empty(0))
    given = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.lit(7), "doc_id")))
    some = [r for cond, n in (("toxic > 0", MAX_TOXIC), ("toxic <= 0", MAX_CLEAN))
            for r in given.where(cond).orderBy("h", "doc_id").limit(n).collect()]
    if not any(r["toxic"] > 0 for r in some):
        return none
    sample = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in some], "doc_id long, toxic int")

    def run(batches):
        for b in batches:
            for lo, hi, texts in text_slices(b.column(1)):
                doc, f, n = features(texts)
                pair, count = np.unique(doc * DIM + f, return_counts=True)
                cut = np.searchsorted(pair, np.arange(1, hi - lo) * DIM)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], pa.array(n.astype(np.int64)),
                     pa.array([x.astype("<i4").tobytes() for x in np.split(pair % DIM, cut)], pa.binary()),
                     pa.array([x.astype("<i4").tobytes() for x in np.split(count, cut)], pa.binary())],
                    ["toxic", "n", "ids", "counts"])
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(sample), "doc_id").select("toxic", "text")
            .mapInArrow(run, "toxic int, n long, ids binary, counts binary").limit(4 * (MAX_TOXIC + MAX_CLEAN)).collect())
    if not any(r["toxic"] > 0 for r in rows) or not any(r["toxic"] <= 0 for r in rows):
        return none
    rows.sort(key=lambda r: (r["toxic"], r["n"], bytes(r["ids"]), bytes(r["counts"])))
    rows = list({(r["toxic"] > 0, *_sketch(r["ids"])): r for r in rows}.values())   # one of each group of copies
    ids = [np.frombuffer(bytes(r["ids"]), "<i4") for r in rows]
    counts = [np.frombuffer(bytes(r["counts"]), "<i4") for r in rows]
    label = np.array([max(r["toxic"], 0) for r in rows])
    bad, good = label > 0, label == 0
    seen_bad = np.bincount(np.concatenate([i for i, b in zip(ids, bad) if b]), minlength=DIM)
    seen_good = np.bincount(np.concatenate([i for i, b in zip(ids, good) if b]), minlength=DIM)
    ratio = ((seen_bad + 0.5) / (bad.sum() + 1)) / ((seen_good + 0.5) / (good.sum() + 1))
    chosen = np.flatnonzero((ratio >= MIN_RATIO) & (_g_statistic(seen_bad, seen_good, bad.sum(), good.sum()) >= MIN_G))
    if not len(chosen):
        return none
    place = np.full(DIM, -1)
    place[chosen] = np.arange(len(chosen))
    row = np.concatenate([np.full(len(i), k) for k, i in enumerate(ids)])
    col, val = place[np.concatenate(ids)], np.log1p(np.concatenate(counts))
    row, col, val = row[col >= 0], col[col >= 0], val[col >= 0]
    grade = label
    if label.max() == 1:
        signal = np.bincount(row, weights=val, minlength=len(rows))
        grade = label + (bad & (signal >= max(np.median(signal[bad]), 1e-9)))
    weight, theta = fit_ordinal(row, col, val, grade, len(chosen))
    return Model(chosen, weight, theta)


def scored(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """severity (expected grade), grade (likeliest by halves), p_toxic and
    toxic of each text, after the carried columns."""
    fields = docs.select(*carry).schema

    def run(batches):
        for b in batches:
            k = b.num_columns - 1
            for lo, hi, texts in text_slices(b.column(k)):
                p = model.at_least(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(i)[lo:hi] for i in range(k)] + [pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)),
                                                              pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)],
                    [f.name for f in fields] + ["severity", "grade", "p_toxic", "toxic"])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["severity double, grade int, p_toxic double, toxic boolean"])
    return docs.select(*carry, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade, p_toxic, toxic of every document."""
    return scored(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs, labels), "doc_id")


def cleaned(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns of ``docs``."""
    model = train(docs, labels)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"])
    return scored(whole, model, "doc").where(~F.col("toxic")).select("doc.*")
