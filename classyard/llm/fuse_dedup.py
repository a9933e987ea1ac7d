"""Exact deduplication screened by static binary-fuse filters.

Rows arrive in batches.  Each batch is first grouped by the SHA-256 of its
normalised text (new-batch duplicates).  Its distinct digests are then screened
against the immutable snapshot of every earlier batch: a snapshot holds its
digests in exact buckets, and one static 3-wise binary-fuse filter with 8-bit
fingerprints per bucket.  Only digests that a filter lets through (all known
ones and 1/256 of the others) are joined with the exact buckets; the rest are
new and form the snapshot of this batch.  Rows of groups with two or more
members are finally compared byte by byte with the row that stays; rows that
differ in spite of equal digests would be grouped by their text instead.

Texts are equal when identical without their ASCII white space; null counts as
empty.  Of equal texts the row with the most code points stays, then the
smallest doc_id (null last), then the first of fully equal rows.  Further
columns of the input are kept apart, so their names may clash with ours.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.llm.common import WHITE_CLASS, stored

BUCKET_KEYS = 1024   # digests per bucket, on average
BATCHES = 2


# --- the filter -------------------------------------------------------------

def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = h + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """Membership filter of a fixed set of 64-bit keys: no false negatives,
    false positives with probability 1/256."""

    def __init__(self, seed: int, seg_len: int, seg_count: int, table: np.ndarray):
        self.seed, self.seg_len, self.seg_count, self.table = seed, seg_len, seg_count, table

    def _places(self, h: np.ndarray) -> np.ndarray:
        span = np.uint64(self.seg_len * self.seg_count)
        first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
        low = np.uint64(self.seg_len - 1)
        second = (first + np.uint64(self.seg_len)) ^ ((h >> np.uint64(18)) & low)
        third = (first + np.uint64(2 * self.seg_len)) ^ (h & low)
        return np.stack([first, second, third]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """``keys`` must be distinct.  Tries seeds until the graph peels."""
        n = len(keys)
        seg_len = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
        seg_count = max(1, -(-round(n * factor) // seg_len) - 2)
        for seed in range(1, 200):
            f = cls(seed, seg_len, seg_count, np.zeros((seg_count + 2) * seg_len, np.uint8))
            h = _mix(keys, seed)
            if f._fill(h):
                return f
            if seed % 10 == 0:
                seg_count += 1
        raise ValueError("no seed gives a filter; are the keys distinct?")

    def _fill(self, h: np.ndarray) -> bool:
        place = self._places(h)
        m = len(self.table)
        degree = np.bincount(place.ravel(), minlength=m)
        owner = np.zeros(m, np.int64)          # sum of the keys at a place: the key itself at degree 1
        for p in place:
            owner += np.bincount(p, weights=np.arange(len(h)), minlength=m).astype(np.int64)
        rounds, left = [], len(h)
        while left:
            at = np.flatnonzero(degree == 1)
            if not len(at):
                return False
            key, first = np.unique(owner[at], return_index=True)
            at = at[first]
            rounds.append((key, at))
            left -= len(key)
            for p in place[:, key]:
                degree -= np.bincount(p, minlength=m)
                owner -= np.bincount(p, weights=key, minlength=m).astype(np.int64)
        print_ = (h ^ (h >> np.uint64(32))).astype(np.uint8)
        for key, at in reversed(rounds):       # a place of a round belongs to one key of that round only
            t = self.table[place[:, key]]
            self.table[at] = 0
            t = np.where(place[:, key] == at, 0, t)
            self.table[at] = print_[key] ^ t[0] ^ t[1] ^ t[2]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys, self.seed)
        t = self.table[self._places(h)]
        return (h ^ (h >> np.uint64(32))).astype(np.uint8) == t[0] ^ t[1] ^ t[2]


def _keys(column) -> np.ndarray:
    """First 8 bytes of each 32-byte digest."""
    raw = b"".join(x.as_py()[:8] for x in column)
    return np.frombuffer(raw, np.uint64)


# --- snapshots --------------------------------------------------------------

class Snapshot:
    """Immutable: distinct digests in exact buckets and a filter per bucket."""

    def __init__(self, digests: DataFrame):
        """``digests``: stored table with a distinct binary column ``digest``."""
        n = digests.count()
        self.buckets = max(1, -(-n // BUCKET_KEYS))
        self.digests = digests.select("digest")

        def build(t: pa.Table) -> pa.Table:
            f = FuseFilter.build(np.unique(_keys(t["digest"].combine_chunks())))
            return pa.table({"bucket": t["bucket"][:1], "seed": pa.array([f.seed], pa.int32()),
                             "seg_len": pa.array([f.seg_len], pa.int32()), "seg_count": pa.array([f.seg_count], pa.int32()),
                             "bits": pa.array([f.table.tobytes()], pa.binary())})
        self.filters = stored(self._in_bucket(self.digests).groupBy("bucket").applyInArrow(
            build, "bucket long, seed int, seg_len int, seg_count int, bits binary"), "fuse-filters")

    def _in_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(self.buckets)))

    def screen(self, digests: DataFrame) -> DataFrame:
        """The digests that may be in the snapshot."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return left.select(["digest"]).slice(0, 0)
            r = right.slice(0, 1).to_pylist()[0]
            f = FuseFilter(r["seed"], r["seg_len"], r["seg_count"], np.frombuffer(r["bits"], np.uint8))
            return left.select(["digest"]).filter(pa.array(f.contains(_keys(left["digest"].combine_chunks()))))
        return (self._in_bucket(digests.select("digest")).groupBy("bucket")
                .cogroup(self.filters.groupBy("bucket")).applyInArrow(run, "digest binary"))

    def known(self, digests: DataFrame) -> DataFrame:
        """The digests that are in the snapshot: screened, then looked up."""
        return self.screen(digests).join(self.digests, "digest", "left_semi")


# --- documents --------------------------------------------------------------

def _normal(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_CLASS + "+", "")


def _rows(docs: DataFrame, batches: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return stored(docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"),
        docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(_normal(text), 256)).alias("digest"),
        F.length(text).cast("long").alias("n_cp"))
        .withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "dedup-rows")


def _best():
    # most code points, then smallest doc_id (null last), then smallest row
    last = F.lit((1 << 63) - 1)
    return F.max(F.struct("n_cp", F.bitwise_not(F.coalesce("doc_id", last)).alias("a"), F.bitwise_not("row").alias("b"),
                          "doc_id", "row")).alias("best")


def classes(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, row, digest, keep_id, keep_row, group_size of every row."""
    snapshots: list[Snapshot] = []
    found: list[DataFrame] = []
    for b in range(batches):
        new = stored(rows.where(F.col("batch") == b).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best()), "dedup-new")
        hits = [s.known(new) for s in snapshots]
        if hits:
            known = stored(reduce(DataFrame.unionByName, hits), "dedup-known")
            found.append(new.join(known, "digest", "left_semi"))
            new = stored(new.join(known, "digest", "left_anti"), "dedup-fresh")
        found.append(new)
        if b + 1 < batches:
            snapshots.append(Snapshot(new))
    groups = stored(reduce(DataFrame.unionByName, found).groupBy("digest")
                    .agg(F.sum("n").alias("n"), F.max("best").alias("best")), "dedup-groups")
    single = groups.where("n = 1").select(
        F.col("best.doc_id").alias("doc_id"), F.col("best.row").alias("row"), "digest",
        F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))
    return single.unionByName(_checked(rows, groups.where("n > 1").select("digest", F.col("best.row").alias("keep_row"))))


def _checked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Byte check of the rows of groups with two or more members."""
    many = stored(rows.select("doc_id", "row", "digest", "n_cp", _normal(F.col("doc.text")).alias("normal"))
                  .join(groups, "digest"), "dedup-many")
    kept = many.where(F.col("row") == F.col("keep_row")).select("digest", F.col("normal").alias("kept_normal"))
    checked = stored(many.join(kept, "digest").select(
        "doc_id", "row", "digest", "n_cp",
        F.when(F.col("normal") == F.col("kept_normal"), F.lit("")).otherwise(F.col("normal")).alias("other")), "dedup-checked")
    exact = stored(checked.groupBy("digest", "other").agg(F.count(F.lit(1)).alias("group_size"), _best()), "dedup-exact")
    return checked.join(exact, ["digest", "other"]).select(
        "doc_id", "row", "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too."""
    c = classes(_rows(docs.select("doc_id", "text"), BATCHES))
    return c.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT n, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM d JOIN g USING (n)
"""


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    rows = _rows(docs, BATCHES)
    gone = classes(rows).where("row <> keep_row").select("row")
    return rows.join(stored(gone, "dedup-gone"), "row", "left_anti").select("doc.*")
