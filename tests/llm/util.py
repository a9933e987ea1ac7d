"""Small fixtures with nulls, blanks, ties, repeated rows and clashing names."""
import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WIDE_SCHEMA = DOC_SCHEMA + ", shard long, ids string, size long, part int, digest string, n long"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}x" for _ in range(n))


def edge_docs(spark, seed=1, n=40, wide=True):
    """Documents with null / empty / blank / very long / repeated rows."""
    rng = random.Random(seed)
    rows = [(k, words(rng, rng.randrange(1, 120)), "en", f"src{k % 3}", 5) for k in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, " \n\t ", "en", "", 4),
             (n + 3, words(rng, 9000), "en", "src1", 1), (None, "lonely words here", "en", None, None),
             (n + 5, rows[0][1], "en", "src2", 5), (n + 6, rows[0][1] + "  ", "en", "src2", 5),
             rows[1], rows[1], (n + 7, "ÀÉ é́ Σας   a\r\nb", "fr", "src1", 9)]
    if wide:
        rows = [r + (7, "x", -1, 2, "d", 3) for r in rows]
    return spark.createDataFrame(rows, WIDE_SCHEMA if wide else DOC_SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
