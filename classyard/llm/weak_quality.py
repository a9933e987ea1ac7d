"""Quality by weak supervision, in DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0) on each document.  The counts of
all vote patterns (at most 3**rules rows, whatever the corpus size) go to the
driver, where expectation-maximisation fits how often each rule gives each vote
on good and on bad documents.  The posterior probability of "good" is then a
sum of per-vote log odds: a plain column expression.

Null or empty texts have no words, fail the base rule and are not kept; the
numbers of such rows are 0.  Repeated rows are judged alike.  An empty table
gives no rows.  Only doc_id and text are read, so other columns cannot clash.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classyard.llm.common import split_words, stored

WINDOW = 5
ROUNDS = 60
#: What is believed of a rule before any document is seen, as so many documents
#: of all: shares of its votes on good and on bad documents (MAP estimates).
BELIEF = 0.05
ON_GOOD = {-1: 0.01, 0: 0.09, 1: 0.90}
ON_BAD = {-1: 0.50, 0: 0.10, 1: 0.40}
NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _count_kept(text: Column, pattern: str) -> Column:
    """Code points of ``text`` left after deleting ``pattern``."""
    return F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""
    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            again = F.transform(s, lambda e, i: F.when(
                (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["i"]))
            return let(F.array_sort(F.filter(again, lambda x: x.isNotNull())), lambda at: F.aggregate(
                F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0), lambda a, x: a + x))
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(pairs), of_sorted))
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(hashes, covered))


def numbers(docs: DataFrame) -> DataFrame:
    """doc_id, the base numbers and what the rules need besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .select("doc_id", let(split_words(F.col("text")), lambda w: F.struct(
                F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"))).alias("w"),
                _count_kept(text, r"[^#*$%&|<>]+").alias("n_symbols"),
                let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
                _count_kept(text, r"[^A-Z]+").alias("n_upper"), _count_kept(text, r"[^!?]+").alias("n_shout"),
                _count_kept(text, r"[^\p{L}]+").alias("n_letters"))
            .select("doc_id", *[F.col(c).cast("long").alias(c) for c in
                                ("w.n_words", "w.word_chars", "n_symbols")],
                    F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
                    F.col("l.n").cast("long").alias("n_lines"), F.col("n_upper").cast("long"), F.col("n_shout").cast("long"),
                    F.col("n_letters").cast("long"))
            .toDF("doc_id", *NUMBERS, "n_lines", "n_upper", "n_shout", "n_letters"))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """name -> vote; every rule abstains between its two bounds."""
    n, chars = F.col("n_words"), F.col("word_chars")
    each = {
        "length": (n, 40, 10, True), "word_length": (F.try_divide(chars, n), None, None, None),
        "symbols": (F.try_divide(F.col("n_symbols"), n), 0.03, 0.10, False), "symbol_share": (F.try_divide(F.col("n_symbols"), chars), 0.01, 0.04, False),
        "letters": (F.try_divide(F.col("n_letters"), chars), 0.92, 0.85, True), "dup_lines": (F.try_divide(F.col("n_dup_lines"), F.col("n_lines")), 0.10, 0.30, False),
        "repeats": (F.try_divide(F.col("n_repeat_words"), n), 0.05, 0.15, False), "upper": (F.try_divide(F.col("n_upper"), chars), 0.15, 0.30, False),
        "shouting": (F.try_divide(F.col("n_shout"), n), 0.10, 0.25, False),
    }
    out = {}
    for name, (v, good, bad, high) in each.items():
        if good is None:
            out[name] = _vote(v, v.between(3.5, 9), ~v.between(2.5, 14))
        else:
            out[name] = _vote(v, v >= good if high else v <= good, v < bad if high else v > bad)
    return out


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """EM over (votes, count): log prior odds of "good", and per rule the log
    odds of each vote.  Starts from "any bad vote is a bad sign"; each round
    keeps a bad vote likelier on bad documents and a good vote on good ones."""
    total = sum(c for _, c in patterns)
    if not total:
        return 0.0, []
    k = len(patterns[0][0])
    good = {p: {0: 0.95, 1: 0.25}.get(sum(v < 0 for v in p), 0.05) for p, _ in patterns}
    weight = BELIEF * total
    for _ in range(rounds):
        share = sum(c * good[p] for p, c in patterns)
        prior = math.log((share + 0.9 * weight) / (total - share + 0.1 * weight))
        odds = []
        for j in range(k):
            yes, no = {v: weight * ON_GOOD[v] for v in ON_GOOD}, {v: weight * ON_BAD[v] for v in ON_BAD}
            for p, c in patterns:
                yes[p[j]] += c * good[p]
                no[p[j]] += c * (1 - good[p])
            a, b = sum(yes.values()), sum(no.values())
            o = {v: math.log(yes[v] / a) - math.log(no[v] / b) for v in yes}
            odds.append({-1: min(o[-1], 0.0), 0: 0.0, 1: max(o[1], 0.0)})
        good = {p: 1 / (1 + math.exp(-max(-500, min(500, prior + sum(o[v] for o, v in zip(odds, p)))))) for p, _ in patterns}
    return prior, odds


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base numbers, base_failed, posterior and kept."""
    votes = rules()
    nums = stored(numbers(docs), "quality-numbers")
    rows = nums.select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()])
    names = [f"vote_{k}" for k in votes]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # documents that the base rule drops teach the rules nothing
    seen = rows.where(~failed).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    prior, odds = fit(sorted((tuple(r[c] for c in names), r["n"]) for r in seen))
    score = F.lit(float(prior))
    for c, o in zip(names, odds):
        score = score + F.when(F.col(c) < 0, o[-1]).when(F.col(c) > 0, o[1]).otherwise(o[0])
    return (rows.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-score)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
            .select("doc_id", *NUMBERS, "base_failed", "kept", "posterior"))
