"""URL filter: host and path rules, then logistic regression on hashed
character n-grams of host and path.

A rule (host, path) fits its host and all subdomains where the URL's path starts
with the rule's path; the longest rule that fits decides, the first by code
point among equally long ones.  URLs without a fitting rule are judged by a
logistic regression that is trained from a small labelled URL table (the driver
holds that table and one weight vector of ``DIM`` numbers, whatever the corpus).

The host lies after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path follows up to ``?``, ``#`` or the end.  A null URL or one
without ``://`` has an empty host and path; no n-gram speaks for or against it,
so it is allowed.  Repeated rows are judged alike; an empty table gives no rows;
only the id and url columns are read, so other columns cannot clash.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classyard.llm.textvec import Buffer, mix64

DIM = 1 << 16
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules, (verdict, rule).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]

# The small labelled URL table (1: block).
LABELLED = [
    ("http://spam-farm.example.org/en/12", 1), ("https://www.spam-farm.example.net/de/3", 1),
    ("https://cheap-pills.example.net/en/9", 1), ("http://www.cheap-pills.example.org/fr/77", 1),
    ("https://casino-win.example.net/en/5", 1), ("http://m.casino-win.example.org/de/8", 1),
    ("https://adult-x.example.org/en/4", 1), ("http://blog.adult-x.example.net/en/6", 1),
    ("https://free-bets.example.net/en/2", 1), ("http://www.free-bets.example.org/es/1", 1),
    ("https://ads-track.example.org/en/31", 1), ("http://ads-track.example.net/de/44", 1),
    ("http://buy-pills-now.test/cheap/offer", 1), ("http://win-casino-bonus.test/free/bets", 1),
    ("https://xxx-adult.test/videos/free", 1), ("http://online-casino.test/win", 1),
    ("http://spam.test/farm/click", 1), ("http://track.ads.test/click/win", 1),
    ("http://news.example.org/en/10", 0), ("https://www.library.example.net/de/5", 0),
    ("https://blog.garden.example.org/en/8", 0), ("http://m.weather.example.net/en/2", 0),
    ("https://school.example.org/fr/6", 0), ("http://www.museum.example.net/en/71", 0),
    ("https://thther.example.org/en/41", 0), ("http://blog.ththan.example.net/de/96", 0),
    ("https://m.therou.example.net/en/47", 0), ("http://therin.example.org/de/33", 0),
    ("https://www.tionsh.example.net/en/53", 0), ("http://ththed.example.org/es/12", 0),
    ("https://blog.theres.example.org/en/9", 0), ("http://therti.example.net/de/61", 0),
    ("https://en.wiki.test/article/history", 0), ("http://docs.project.test/guide/install", 0),
    ("https://www.university.test/research/paper", 0), ("http://recipes.test/soup/onion", 0),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    u, pattern = F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):   # the last that fits wins
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def gram_features(hosts, paths) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed n-gram) of hosts and paths; digits count as one letter."""
    rows, ids = [], []
    digits = str.maketrans("0123456789", "0" * 10)
    for side, texts in enumerate((hosts, paths)):
        buf = Buffer([f"^{t.translate(digits)}$" if t else "" for t in texts])
        for n in GRAMS:
            start = np.arange(max(0, len(buf.data) - n))
            row = np.searchsorted(buf.ends, start, side="right")
            inside = start + n < buf.ends[row]
            rows.append(row[inside])
            ids.append(mix64(buf.hash(start[inside], start[inside] + n) + np.uint64(side)) % np.uint64(DIM))
    return np.concatenate(rows), np.concatenate(ids).astype(np.int64)


def _distinct(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(rows * DIM + ids)
    return pair // DIM, pair % DIM


def _parts(url: str) -> tuple[str, str]:
    if "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    rest = rest.partition("?")[0].partition("#")[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def train(labelled, rounds: int = 300, l2: float = 3e-3, rate: float = 0.5) -> np.ndarray:
    """Weights by gradient descent on the log loss; no intercept, so an URL
    that shares no n-gram with the table scores 0."""
    parts = [_parts(u) for u, _ in labelled]
    y = np.array([b for _, b in labelled], float)
    rows, ids = _distinct(*gram_features([h for h, _ in parts], [p for _, p in parts]))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(y))))
    w = np.zeros(DIM)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-scale * np.bincount(rows, weights=w[ids], minlength=len(y))))
        w -= rate * (np.bincount(ids, weights=((p - y) * scale)[rows], minlength=DIM) / len(y) + l2 * w)
    return w


def score(weights: np.ndarray, hosts, paths) -> np.ndarray:
    """Probability of "block"."""
    rows, ids = _distinct(*gram_features(hosts, paths))
    n = np.maximum(1, np.bincount(rows, minlength=len(hosts)))
    return 1 / (1 + np.exp(-np.bincount(rows, weights=weights[ids], minlength=len(hosts)) / np.sqrt(n)))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, p_block of every URL."""
    weights = train(labelled)
    host, path = host_and_path(F.col("url"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 5000):
                part = b.slice(lo, 5000)
                p = score(weights, part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], ["id", "host", "path", "p_block"])
    scored = (pages.select(F.col(key).cast("long").alias("id"), host.alias("host"), path.alias("path"))
              .mapInArrow(run, "id long, host string, path string, p_block double"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return scored.select(F.col("id").alias(key), "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, own).alias("verdict"), "p_block")
