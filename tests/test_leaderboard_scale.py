"""The leaderboard's shared steps at size: what moves, runs or is computed more than once."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from classyard.functions.exprs import LETTERS, letter_share_columns
from classyard.operators import prep
from classyard.operators.models import knn
from classyard.operators.ranking import rank_cut


@pytest.fixture
def conf(spark):
    old = {}

    def put(name, value):
        old.setdefault(name, spark.conf.get(name))
        spark.conf.set(name, value)
    yield put
    for name, value in old.items():
        spark.conf.set(name, value)


def _plan(df):
    return df._jdf.queryExecution().toString()


def _points(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), *map(float, rng.integers(0, 5, 2))) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label int, a double, b double")


def test_rank_cut_leaves_few_tasks(spark, conf):
    conf("spark.sql.shuffle.partitions", "64")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("key")).repartition(3)
    quota = spark.createDataFrame([(0, 300), (1, 5)], "g long, quota long")
    out = rank_cut(df, ["g"], "key", "id", quota)
    assert out.rdd.getNumPartitions() <= 3 + spark.sparkContext.defaultParallelism
    got = {g: sorted(r["id"] for r in out.where(f"selected and g = {g}").collect()) for g in (0, 1)}
    for g, n in ((0, 300), (1, 5)):
        assert got[g] == sorted(r["id"] for r in df.where(f"g = {g}").orderBy("key", "id").limit(n).collect())


def test_rows_of_a_knn_round_move_once(spark, conf):
    """Counts of buckets go to the rows, the rows do not go to the counts."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = _points(spark, 60)
    te = df.select("row_id", F.col("label").alias("y"), "a", "b", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("mine"),
                   F.lit(0).cast("long").alias("bucket"), F.lit(float("inf")).alias("kth"), F.lit(60.0).alias("work"))
    tr = df.select("row_id", "label", "a", "b", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("bucket"))
    found = knn._meet(te, tr, 3, ["a", "b"], [], None, first=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2
    assert found.count() == 60


def test_votes_need_no_window_and_stay_the_same(spark):
    df = _points(spark, 200)
    nb = knn.neighbours(df.where("row_id < 150"), df.where("row_id >= 150"), ["a", "b"], 15).localCheckpoint()
    out = knn.votes(nb, {"five": (5, False), "fifteen": (15, True), "near": (4, True)})
    assert "Window" not in _plan(out)
    for name, k, weighted in (("five", 5, False), ("fifteen", 15, True), ("near", 4, True)):
        want = sorted(map(tuple, knn.vote(nb.where(F.col("rank") <= k), weighted).collect()))
        assert sorted(map(tuple, out.select("row_id", "y", f"{name}.p").collect())) == want


def test_features_are_stored_before_the_split(spark, monkeypatch):
    def stored():
        return sum(r.numCachedPartitions() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    before, seen, split = stored(), [], prep.stratified_split
    monkeypatch.setattr(prep, "stratified_split", lambda *a, **k: seen.append(stored()) or split(*a, **k))
    raw = _points(spark, 50).select("row_id", F.col("label").cast("string").alias("cls"), "a", "b")
    p = prep.prepare("t", raw, ["a", "b"], "0")
    assert seen[0] > before
    assert p.df.count() == 50


def test_leaderboard_is_evaluated_once(spark, monkeypatch):
    from classyard.plans import leaderboard as L
    monkeypatch.setattr(L, "_REC", {})
    calls, plain = [], L.ev.evaluate
    monkeypatch.setattr(L.ev, "evaluate", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert L.lb_records(spark, "/root/testdata/sf0.001").count() == 12
    assert L.lb_eval(spark, "/root/testdata/sf0.001")["cm"].count() > 0
    assert len(calls) == 1


def test_letter_shares_count_every_letter(spark):
    texts = ["", "aB c", "ÉéñÑ zz", "İI ß", "日本 a\U0001f600", None, "x" * 1_200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    for r in df.select("i", *letter_share_columns("text")).collect():
        t = texts[r["i"]]
        low = None if t is None else t.lower()
        assert list(r)[1:] == [None if t is None else low.count(c) / len(low) if low else 0.0 for c in LETTERS]


def test_parts_of_a_round_are_dealt_by_number(spark, conf):
    """Two buckets of few bytes and much work are not put into one task."""
    conf("spark.sql.adaptive.coalescePartitions.enabled", "true")
    df = _points(spark, 40)
    at = (F.col("row_id") % 2).alias("bucket")
    te = df.select("row_id", F.col("label").alias("y"), "a", "b", at.alias("cell"), at.alias("mine"), at,
                   F.lit(float("inf")).alias("kth"), F.lit(3.0 * knn.TASK_PAIRS / 40).alias("work"))
    found = knn._meet(te, df.select("row_id", "label", "a", "b", at.alias("cell"), at), 3, ["a", "b"], [], None, first=True)
    assert found.rdd.getNumPartitions() >= 8             # two buckets in two parts or more
    rows = found.select("row_id", F.size("nb_row").alias("n"), F.forall("nb_row", lambda x: x % 2 == F.col("row_id") % 2).alias("own")).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(40)) and all(r["n"] == 3 and r["own"] for r in rows)
