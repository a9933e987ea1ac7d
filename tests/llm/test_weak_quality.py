import random
import re
from collections import Counter

import pytest

from classyard.llm import weak_quality as W

from .util import DOC_SCHEMA, edge_docs, empty_docs
from .util import words as numbered

DIGITS = str.maketrans("0123456789", "aeioulnrst")


def words(*args):
    return numbered(*args).translate(DIGITS)


def slow_numbers(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def check(spark, texts):
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOC_SCHEMA).repartition(4)
    got = {r.doc_id: r for r in W.judge(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r, want = got[k], slow_numbers(t)
        assert tuple(r[c] for c in W.NUMBERS) == want, (k, t)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    return got


def test_numbers_and_verdicts(spark):
    rng = random.Random(6)
    clean = [words(rng, rng.randrange(12, 300), 5000).replace("x w", "x\nw", 2) for _ in range(120)]
    junk = [" | ".join(words(rng, 60, 5000).split()) for _ in range(8)]
    junk += [" ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words(rng, 80, 5000).split()) for _ in range(8)]
    junk += ["!! ".join(words(rng, 70, 5000).upper().split()) for _ in range(8)]
    junk += ["\n".join([words(rng, 6, 5000)] * 30) for _ in range(8)]
    odd = [None, "", " \n", "a", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 40, "a a a a a a", "A\n\nA\n \nA \nA", "é ü\x0bß\x0c" * 9, words(rng, 9000, 50)]
    got = check(spark, clean + junk + odd)
    assert all(got[k].kept for k in range(len(clean)))
    assert not any(got[len(clean) + k].kept for k in range(len(junk)))


@pytest.mark.parametrize("seed", range(3))
def test_repeated_windows_of_random_texts(spark, seed):
    rng = random.Random(seed)
    check(spark, [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(60)])


def test_no_python_in_the_plan(spark, capsys):
    W.judge(edge_docs(spark)).explain("formatted")
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_em_and_edges(spark):
    assert W.fit([]) == (0.0, [])
    prior, odds = W.fit([((1, 1), 900), ((-1, -1), 80), ((-1, 1), 10), ((1, -1), 10)])
    assert prior > 1 and all(o[-1] < -2 and o[1] > 0 for o in odds)
    df = edge_docs(spark)
    assert W.judge(df).count() == df.count() and W.judge(empty_docs(spark)).count() == 0
