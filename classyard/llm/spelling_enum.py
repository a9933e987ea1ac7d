"""Spelling variants by PartEnum signatures over letter multisets.

A word's letters are a binary vector with one place per (letter, how manyth).  Two
words that differ by one replaced code point have vectors of Hamming distance
two, by one inserted code point of distance one.  Places are dealt to a few
partitions and signatures enumerate what stays equal:

* equal length, distance 2: ``PARTS_2`` partitions, any two of them left out;
* lengths s and s + 1, distance 1: ``PARTS_1`` partitions, any one left out.

Words near each other agree in one such signature.  Here many words share their
letters (plain signatures give 3.4 billion candidates for the million words of
check_l), so the signature also holds what else stays equal: the lengths, and the
first or the last half of the word (an edit leaves one of them alone).  That
is exact as well.  An equi-join of the signatures gives candidates, the edit
distance verifies them, and a pair is taken at one of its signatures only: the
left halves before the right ones, and the least partitions left out.

Counting words aggregates before the shuffle, so frequent words cost one row per
task.  A bucket holds distinct words of one length with the same half and
much the same letters.  Forms point from words to words of at least ten times
their count, so pointer doubling ends after a few rounds.

Null texts have no words; a null doc_id is written as an empty string in the slip
hash; repeated rows count again; texts of any length are cut in one regular
expression; an empty table gives no rows.  Only doc_id and text are read.
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classyard.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS_2 = 4                     # partitions for words of equal length (two are left out)
PARTS_1 = 3                     # partitions for lengths that differ by one (one is left out)
MIN_LENGTH, MIN_COUNT = 7, 2
RATIO = 10                      # a form is so many times as frequent
SLIP = 31                       # one run in so many loses a code point
TASK_WORDS = 30_000             # words whose signatures one task makes


# --- words ------------------------------------------------------------------

def corpus_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased; where ``slip``
    divides the CRC-32 h of ``<doc_id>:<run>``, without code point h % length.
    Shorter runs cannot become words, so the pattern leaves them out."""
    run = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % min_length), F.lit(0)))
    r = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    r = r.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    r = r.select("run", F.char_length("run").alias("size"), h.alias("h"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    return (r.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
            .where(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


# --- signatures -------------------------------------------------------------

def _partition_digests(parts: int) -> list[Column]:
    """The word's sorted letters, its places, and one number per partition that
    stands for the set of places in it."""
    letters = F.array_sort(F.filter(F.split("word", ""), lambda c: c != ""))

    def place(c, i):
        nth = (i + 2 - F.array_position(F.col("letters"), c)).cast("int")
        return F.struct(((F.ascii(c) + nth) % parts).alias("p"), F.xxhash64(c, nth).alias("h"))
    places = F.transform(F.col("letters"), place)
    digest = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.aggregate(
        F.filter(F.col("places"), lambda x: x["p"] == p), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["h"])))
    return [letters, places, digest]


def _with_digests(words: DataFrame, parts: int) -> DataFrame:
    letters, places, digest = _partition_digests(parts)
    return (words.select("word", "n", F.char_length("word").alias("size")).withColumn("letters", letters)
            .withColumn("places", places).withColumn("d", digest).select("word", "n", "size", "d"))


def _halves(h: Column) -> list[tuple[int, Column]]:
    return [(0, F.substring("word", F.lit(1), h)), (1, F.substring("word", F.col("size") - h + 1, h))]


def replaced_signatures(words: DataFrame) -> DataFrame:
    """(key, word, n, side, i, j, di, dj): signatures for one replaced code point.
    i and j are the partitions left out, di and dj their digests."""
    h = F.floor(F.col("size") / 2).cast("int")
    rows = [F.struct(F.xxhash64(F.lit(10 * side + 1), F.lit(10 * i + j), "size", half,
                                *[F.col("d")[p] for p in range(PARTS_2) if p not in (i, j)]).alias("key"),
                     F.lit(side).alias("side"), F.lit(i).alias("i"), F.lit(j).alias("j"),
                     F.col("d")[i].alias("di"), F.col("d")[j].alias("dj"))
            for side, half in _halves(h) for i, j in combinations(range(PARTS_2), 2)]
    return _with_digests(words, PARTS_2).select("word", "n", F.inline(F.array(*rows)))


def inserted_signatures(words: DataFrame, longer: bool) -> DataFrame:
    """(key, word, n, side, prefix): signatures for one inserted code point, of the
    longer or of the shorter word."""
    short = F.col("size") - (1 if longer else 0)
    h = F.ceil(short / 2).cast("int")
    rows = [F.struct(F.xxhash64(F.lit(10 * side + 2), F.lit(i), short, half,
                                *[F.col("d")[p] for p in range(PARTS_1) if p != i]).alias("key"), F.lit(side).alias("side"))
            for side, half in _halves(h) for i in range(PARTS_1)]
    return _with_digests(words, PARTS_1).select("word", "n", F.substring("word", F.lit(1), h).alias("prefix"), F.inline(F.array(*rows)))


def _shuffled(df: DataFrame) -> DataFrame:
    """Never broadcast: Spark judges a table by the bytes of its Parquet files, which
    says nothing of the signatures made from it, and little of its rows in memory."""
    return df.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), each pair once: words that differ by exactly one inserted,
    deleted or replaced code point."""
    one = F.levenshtein("a", "b", 1) == 1

    def named(sig, x, keep):
        return sig.select("key", F.col("word").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{x}_{c}") for c in keep])
    sig = replaced_signatures(words)
    left, right = named(sig, "a", ["side", "i", "j", "di", "dj"]), named(sig, "b", ["side", "i", "j", "di", "dj"])
    h = F.floor(F.char_length("a") / 2).cast("int")
    once = ((F.col("a_di") != F.col("b_di")) & ((F.col("a_dj") != F.col("b_dj")) | (F.col("a_i") == 0) & (F.col("a_j") == 1))
            | (F.col("a_di") == F.col("b_di")) & (F.col("a_dj") != F.col("b_dj")) & (F.col("a_i") == 0))
    first = (F.col("a_side") == 0) | (F.substring("a", F.lit(1), h) != F.substring("b", F.lit(1), h))
    same = left.join(_shuffled(right), "key").where((F.col("a") < F.col("b")) & once & first).where(one).select("a", "na", "b", "nb")
    left, right = named(inserted_signatures(words, False), "a", ["side", "prefix"]), named(inserted_signatures(words, True), "b", ["prefix"])
    first = (F.col("a_side") == 0) | (F.col("a_prefix") != F.col("b_prefix"))
    return same.unionByName(left.join(_shuffled(right), "key").where(first).where(one).select("a", "na", "b", "nb"))


# --- forms and roots --------------------------------------------------------

def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all ``words`` (word, n), one row a
    word: the most frequent near word if it is ``ratio`` times as frequent, and
    the last word that forms lead to."""
    words = stored(words.select("word", "n"), "spelling-words")
    # a word makes many signatures: spread the small table before they are made
    pairs = near_pairs(words.repartition(-(-words.count() // TASK_WORDS) or 1, "word"))
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
                                         F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(_shuffled(best), "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
                                F.when(is_form, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(roots.join(_shuffled(ahead), "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                               F.col("further").isNotNull().alias("moved")), "spelling-roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(_shuffled(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of all texts."""
    return variant_groups(corpus_words(docs))


_BYTES = ("flatten(list_transform(string_split({s}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] "
          "ELSE [(192 + (unicode(ch) >> 6))::BIGINT, (128 + (unicode(ch) & 63))::BIGINT] END))")
_CRC = ("xor(list_reduce(list_concat([4294967295::BIGINT], " + _BYTES + "), "
        "lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")

ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run
  FROM documents),
slips AS (
  SELECT run, count(*) AS n, {_CRC.format(s="doc || ':' || run")} AS h FROM (SELECT doc, run FROM runs WHERE length(run) >= 7) GROUP BY doc, run),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM slips)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (
  SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM words, unnest(range(0, length(word))) AS u(p)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, near)) AS near FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN b.near END AS form,
         CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS at, form AS ahead FROM forms
  UNION ALL SELECT c.word, c.ahead, f.form FROM chain c JOIN forms f ON f.word = c.ahead)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.ahead IS NULL
"""
