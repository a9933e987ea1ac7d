"""Preprocessing operators: F4-F14 of the inventory.

A *prepared dataset* is one DataFrame
``row_id long, split string, label int, f_00..f_NN double`` plus a small
class dictionary.  Flat double columns (not a vector) keep every transform in
whole-stage codegen and let the same plan be written as SQL.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classyard.functions.hashing import SEED, hash_key
from classyard.operators.ranking import rank_cut

ZERO_SCALE = 1e-12  # a std below this is treated as zero variance (divisor 1)


@dataclass
class Prepared:
    name: str
    df: DataFrame                 # row_id, split, label, features...
    classes: list[str]            # label i -> class name, sorted
    features: list[str]
    benign: str | None = None
    meta: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.classes)

    @property
    def benign_label(self) -> int | None:
        return self.classes.index(self.benign) if self.benign in self.classes else None

    def train(self) -> DataFrame:
        return self.df.where(F.col("split") == "train")

    def test(self) -> DataFrame:
        return self.df.where(F.col("split") == "test")

    def class_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, c) for i, c in enumerate(self.classes)],
                                     "label int, class string")


# ---------------------------------------------------------------- F4 / F5
def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """drop leakage / id / set-valued columns (absent names are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def fill_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """nulls -> 0 on numeric columns."""
    return df.na.fill(0, subset=cols) if cols else df.na.fill(0)


# ---------------------------------------------------------------- F6
MAX_CLASSES = 10_000


def class_levels(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct class names; a target with more than MAX_CLASSES values
    is no class label, and everything that is sized by K relies on this bound."""
    found = df.select(col).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{col} has more than {MAX_CLASSES} values")
    return sorted(r[0] for r in found)


def label_encode(df: DataFrame, col: str, levels: list[str], out: str = "label") -> DataFrame:
    """class name -> 0..K-1 in sorted order; an unseen level raises."""
    idx = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col)).cast("int") - 1
    checked = F.when(idx >= 0, idx).otherwise(
        F.raise_error(F.concat(F.lit("unseen label: "), F.col(col).cast("string"))))
    return df.withColumn(out, checked)


# ---------------------------------------------------------------- F7
def one_hot(df: DataFrame, col: str, levels: list[str], prefix: str) -> DataFrame:
    """one 0/1 column per level (all levels kept, null -> all zeros)."""
    cols = [F.coalesce((F.col(col) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}")
            for v in levels]
    return df.select("*", *cols).drop(col)


# ---------------------------------------------------------------- F8
def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """F8: feature columns -> ml Vector, in the given order; nulls raise."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


# ---------------------------------------------------------------- F9 / F10
def fit_standard_scaler(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """F9 fit: mean and *population* std per feature in one pass over train rows."""
    aggs = []
    for c in features:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = train.agg(*aggs).first()
    out = {}
    for c in features:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        s = 1.0 if (s is None or s < ZERO_SCALE) else s
        out[c] = (m or 0.0, s)
    return out


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """F9 apply: (x - mean) / std, a pure projection (no shuffle)."""
    cols = [((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) if c in params else F.col(c)
            for c, (m, s) in ((c, params.get(c, (0.0, 1.0))) for c in df.columns)]
    return df.select(*cols)


def fit_minmax(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """F10 fit: per-feature min and range (range 0 -> 1)."""
    row = train.agg(*[x for c in features for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    out = {}
    for c in features:
        lo, hi = row[f"lo_{c}"] or 0.0, row[f"hi_{c}"] or 0.0
        out[c] = (lo, (hi - lo) or 1.0)
    return out


def apply_minmax(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """F10 apply: (x - min) / range, no clipping."""
    return df.select(*[((F.col(c) - F.lit(lo)) / F.lit(r)).alias(c) if c in params else F.col(c)
                       for c, (lo, r) in ((c, params.get(c, (0.0, 1.0))) for c in df.columns)])


# ---------------------------------------------------------------- F11
def split_quotas(df: DataFrame, label: str = "label", num: int = 3, den: int = 10) -> DataFrame:
    """Per-class test quota for a num/den test fraction.

    n_test = ceil(n * num / den); class c gets floor(n_test * n_c / n) and the
    remaining rows go to the largest remainders (ties: lower label).  Integer
    arithmetic, so both engines agree exactly.  One row per class.
    """
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n_c"))
    w_all = Window.partitionBy()
    n = F.sum("n_c").over(w_all)
    n_test = F.floor((n * num + (den - 1)) / den)
    q = cnt.select(label, "n_c", n.alias("n"), n_test.alias("n_test"))
    q = q.select(label, (F.floor(F.col("n_test") * F.col("n_c") / F.col("n"))).alias("base"),
                 F.pmod(F.col("n_test") * F.col("n_c"), F.col("n")).alias("rem"), "n_test")
    rk = F.row_number().over(Window.partitionBy().orderBy(F.col("rem").desc(), F.col(label)))
    left = F.col("n_test") - F.sum("base").over(w_all)
    return q.select(label, (F.col("base") + F.when(rk <= left, 1).otherwise(0)).cast("long").alias("quota"))


def stratified_split(df: DataFrame, label: str = "label", seed: int = SEED,
                     num: int = 3, den: int = 10) -> DataFrame:
    """exact per-class test quota, rows ordered by md5(seed|row_id).

    The quota table has K rows (a window over it is one tiny task); the
    selection itself is ``rank_cut`` which never ranks a whole class.
    """
    keyed = df.withColumn("__key", hash_key(seed, "row_id"))
    flagged = rank_cut(keyed, [label], "__key", "row_id", split_quotas(keyed, label, num, den),
                       out="__test")
    return (flagged.withColumn("split", F.when(F.col("__test"), "test").otherwise("train"))
            .drop("__key", "__test"))


# ---------------------------------------------------------------- F12
def cap_rows(df: DataFrame, cap: int | None, seed: int = SEED) -> DataFrame:
    """fixed-seed uniform sample of ``cap`` rows without replacement; no-op if n <= cap."""
    if not cap:
        return df
    keyed = df.withColumn("__g", F.lit(0)).withColumn("__key", hash_key(seed, "'cap'", "row_id"))
    quota = df.sparkSession.createDataFrame([(0, int(cap))], "__g int, quota long")
    return (rank_cut(keyed, ["__g"], "__key", "row_id", quota, out="__keep")
            .where("__keep").drop("__g", "__key", "__keep"))


# ---------------------------------------------------------------- F13
def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """w_c = n / (K * n_c), attached through a K-row broadcast join."""
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = cnt.select(label, (F.sum("n_c").over(Window.partitionBy()) /
                           (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("n_c"))).alias(out))
    return df.join(F.broadcast(w), label)  # K rows: bounded by the class count


# ---------------------------------------------------------------- F14
def benign_relabel(df: DataFrame, benign_label: int, label: str = "label", out: str = "label") -> DataFrame:
    """0 for the benign class, 1 for any attack class."""
    return df.withColumn(out, (F.col(label) != F.lit(benign_label)).cast("int"))


# ---------------------------------------------------------------- pipeline
def prepare(name: str, raw: DataFrame, features: list[str], benign: str | None,
            seed: int = SEED, scale: bool = True, persist: bool = True) -> Prepared:
    """raw(row_id, cls, features...) -> label-encoded, split, scaled dataset.

    Scaling statistics come from train rows only.  The result is persisted
    (memory + disk) because every model of a run reads it.
    """
    levels = class_levels(raw, "cls")
    df = label_encode(raw, "cls", levels).drop("cls")
    # features are computed once into the cache, before the split's stages read it side by side
    base = df.persist(StorageLevel.MEMORY_AND_DISK)
    base.count()
    df = stratified_split(base, "label", seed)
    df = df.select("row_id", "split", "label", *features)
    meta = {}
    if scale:
        params = fit_standard_scaler(df.where(F.col("split") == "train"), features)
        df = apply_scaler(df, params)
        meta["scaler"] = params
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        base.unpersist()
    return Prepared(name, df, levels, features, benign, meta)
