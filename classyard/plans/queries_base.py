"""Per-process cache of prepared stand-ins and checkpointed model predictions,
shared by the registered queries (the driver calls them one after another)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classyard.operators.models import knn
from classyard.operators.models.base import Ctx
from classyard.operators.models.registry import REGISTRY
from classyard.operators.prep import Prepared, prepare
from classyard.sources import standins

_PREP: dict = {}
_PRED: dict = {}


def prepared(spark: SparkSession, sf_dir: str, ds: str) -> Prepared:
    key = (id(spark), sf_dir, ds)
    if key not in _PREP:
        rd = standins.load(spark, sf_dir, ds)
        _PREP[key] = prepare(rd.name, rd.raw, rd.features, rd.benign)
    return _PREP[key]


def predictions(spark: SparkSession, sf_dir: str, ds: str, model: str) -> DataFrame:
    """(row_id, y, p) of one registry model on one stand-in, checkpointed once."""
    key = (id(spark), sf_dir, ds, model)
    if key not in _PRED:
        prep = prepared(spark, sf_dir, ds)
        fitted = REGISTRY[model].build().fit(prep.train(), Ctx(prep.features, prep.k))
        _PRED[key] = fitted.predict(prep.test()).checkpoint(eager=True)
    return _PRED[key]


def knn_predictions(spark: SparkSession, sf_dir: str, ds: str, models: list[str]) -> None:
    """``predictions`` of several nearest-neighbour models from one search."""
    found = [m for m in models if (id(spark), sf_dir, ds, m) not in _PRED]
    if len(found) < 2:
        return
    prep = prepared(spark, sf_dir, ds)
    both = knn.predictions(prep.train(), prep.test(), prep.features, {m: REGISTRY[m].build() for m in found}).checkpoint(eager=True)
    for m in found:
        _PRED[id(spark), sf_dir, ds, m] = both.where(F.col(m).isNotNull()).select("row_id", "y", f"{m}.p")


_RAW: dict = {}


def prepared_raw(spark: SparkSession, sf_dir: str, ds: str) -> Prepared:
    """Same split as ``prepared`` (md5-ordered, data-independent of scaling) but
    unscaled features -- for scale-invariant statistics such as binned MI."""
    key = (id(spark), sf_dir, ds)
    if key not in _RAW:
        rd = standins.load(spark, sf_dir, ds)
        _RAW[key] = prepare(rd.name, rd.raw, rd.features, rd.benign, scale=False)
    return _RAW[key]
