"""One test for each fault found in review."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from classyard import session
from classyard.functions.exprs import hex_or_number_to_long
from classyard.operators import importance as I
from classyard.operators import samplers
from classyard.operators.models.base import Ctx
from classyard.operators.models.builtin import AdaBoostSAMME
from classyard.operators.models.ensembles import BaggingKNN
from classyard.operators.models.registry import REGISTRY
from classyard.operators.prep import prepare
from classyard.operators.ranking import dense_position
from classyard.sources import standins

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def line(spark):
    rd = standins.load(spark, SF, "line")
    return prepare(rd.name, rd.raw, rd.features, rd.benign)


def test_malformed_hex_is_zero(spark):
    df = spark.createDataFrame([("0x1g",), ("0xg",), ("0x 1",), ("0xFF",), ("0x",)], "v string")
    assert [r[0] for r in df.select(hex_or_number_to_long("v")).collect()] == [0, 0, 0, 255, 0]


def test_wide_ids_do_not_overflow(spark, line):
    ctx = Ctx(line.features, line.k)
    small = line.train().where(F.pmod(F.xxhash64("row_id"), F.lit(8)) == 0)
    pred = BaggingKNN(3, 5).fit(small, ctx).predict(line.test()).count()
    assert pred == line.test().count()
    fm = REGISTRY["nearest_centroid"].build().fit(line.train(), ctx)
    assert I.permutation_importance(fm, line.test(), line.features, line.k).count() == len(line.features)


def test_permutation_scores_every_row_once(spark):
    n, feats = 997, ["a", "b"]
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame([(int(i) * 10 ** 14, int(a[i] > 0), float(a[i]), float(b[i])) for i in range(n)],
                               "row_id long, label int, a double, b double").repartition(5)
    pos = [r.pos for r in dense_position(df, "row_id", "pos").collect()]
    assert sorted(pos) == list(range(n))
    for p, q in I._bijections(n, 6, 1) + I._bijections(12, 6, 1):
        m = n if p < n and (p, q) in I._bijections(n, 6, 1) else 12
        assert sorted((p * x + q) % m for x in range(m)) == list(range(m))

    class Rule:
        def predict(self, d):
            return d.select("row_id", F.col("label").alias("y"), (F.col("a") > 0).cast("int").alias("p"))
    got = {r.fi: r.score for r in I.permutation_importance(Rule(), df, feats, 2).collect()}
    assert 0.4 < got[0] < 0.6 and got[1] == 0.0


def test_boosting_weights_stay_finite(spark, line):
    fm = AdaBoostSAMME(12, ckpt_every=5).fit(line.train(), Ctx(line.features, line.k))
    assert fm.predict(line.test()).where("p is null").count() == 0


def test_balanced_bootstrap_has_no_multiplicity_cut(spark):
    df = spark.range(200_000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"))
    got = {r.w: r["count"] for r in samplers.balanced_bootstrap(df, 1).groupBy("w").count().collect()}
    assert max(got) >= 6 and abs(sum(w * n for w, n in got.items()) / 200_000 - 1) < 0.01


def test_checkpoint_folder_of_the_context_is_used(spark):
    assert session.checkpoint_dir(spark)
    class Conf:
        def get(self, *_):
            return None
    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self):
            return self.dir
    class Session:
        conf, sparkContext = Conf(), Context()
    Session.sparkContext.dir = "hdfs://shared/x"
    assert session.checkpoint_dir(Session()) == "hdfs://shared/x"
    Session.sparkContext.dir = None
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_spreading_degrees_leave_self_edges_out(spark):
    from classyard.operators.models.graph import LabelSpreading
    rng = np.random.default_rng(3)
    n, k, a = 60, 4, 0.2
    x = rng.normal(size=(n, 2)) + np.repeat([[0, 0], [3, 0], [0, 3]], 20, axis=0)
    y = np.repeat([0, 1, 2], 20)
    df = spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "row_id long, label int, f0 double, f1 double")
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    A = np.zeros((n, n))
    for i in range(n):
        A[i, np.argsort(d2[i], kind="stable")[:k]] = 1
    np.fill_diagonal(A, 0)
    deg = A.sum(axis=0)
    root = np.sqrt(np.where(deg == 0, 1, deg))
    S = A / root[:, None] / root[None]
    Y = np.eye(3)[y]
    V = Y.copy()
    for _ in range(30):
        V = a * S @ V + (1 - a) * Y
    want = np.array([np.argmax(V[np.argsort(d2[i], kind="stable")[:k]].sum(axis=0)) for i in range(n)])
    fm = LabelSpreading(k=k, alpha=a).fit(df, Ctx(["f0", "f1"], 3))
    got = {r.row_id: r.p for r in fm.predict(df).collect()}
    assert np.mean([got[i] == want[i] for i in range(n)]) > 0.98
