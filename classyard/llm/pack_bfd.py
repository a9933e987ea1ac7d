"""Packing documents into fixed-length sequences by best-fit decreasing.

Documents are encoded and overlong ones first cut into full windows, which are
sequences as they are.  The remainders, at most one a document and shorter than
a window, are dealt by a hash into shards of about SHARD_DOCS documents; each
shard packs them in decreasing length, and a segment tree over remaining
capacities finds the tightest window that is still open.  Every shard leaves a
handful of part-filled windows, so padding does not depend on their number.

Nulls: a null text is a document of the end id alone; a null ``doc_id`` is kept.
Repeated rows are packed as often as they occur.  Ties (equal lengths, equally
tight windows) go by doc_id, start and ids.  An empty table packs to nothing.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.llm.common import stored
from classyard.llm.rans import as_bytes, as_crc32
from classyard.llm.tokens import encoder, text_slices

WINDOW = 1024
SHARD_DOCS = 1024     # documents per shard, on average


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over the capacities
    0 ... size holds where any window is open."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.by_room[room].append(window)
        k = room + self.leaves
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the least room >= length."""
        k = length + self.leaves
        if not self.any[k]:
            while k > 1 and (k & 1 or not self.any[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.any[2 * k] else 2 * k + 1
        room = k - self.leaves
        window = self.by_room[room].pop()
        if not self.by_room[room]:
            self.any[k] = 0
            k >>= 1
            while k and not (self.any[2 * k] or self.any[2 * k + 1]):
                self.any[k] = 0
                k >>= 1
        return room, window


def best_fit_decreasing(lengths, size: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window, offset) of each piece; lengths must already be decreasing."""
    open_, n, windows, offsets = OpenWindows(size), 0, [], []
    for length in lengths:
        found = open_.take(length)
        if found is None:
            found = (size, n)
            n += 1
        room, w = found
        windows.append(w)
        offsets.append(size - room)
        if room > length:
            open_.add(room - length, w)
    return windows, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, shards: int,
           what=as_bytes, field: str = "ids binary") -> DataFrame:
    """Full windows with their sequence_id, and remainders with their shard, of
    all documents; ``field`` is ``what`` of the ids."""
    name, kind = field.split()

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc, row, full = encoder(tokenizer, True), part * 7919, (shards + part) << 32
        for b in batches:
            docs_ = b.column(0).to_pylist()
            for lo, hi, texts in text_slices(b.column(1)):
                cols: list[list] = [[] for _ in range(7)]
                for d, ids in zip(docs_[lo:hi], enc.encode(texts, end_id)):
                    for a in range(0, len(ids), window):
                        ids_ = ids[a:a + window]
                        if len(ids_) == window:
                            place = (None, full)
                            full += 1
                        else:
                            # consecutive remainders go to different shards, the same ones on a retry
                            row += 1
                            place = (((row * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20) % shards, None)
                        for c, v in zip(cols, (d, a, len(ids_), len(ids), what(ids_), *place)):
                            c.append(v)
                        if len(cols[0]) >= 2_000:
                            yield batch(cols)
                            cols = [[] for _ in range(7)]
                yield batch(cols)

    def batch(cols):
        kinds = [pa.int64()] * 4 + [pa.binary() if kind == "binary" else pa.int64()] + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          ["doc_id", "start", "length", "doc_tokens", name, "shard", "sequence_id"])
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(
        run, f"doc_id long, start long, length long, doc_tokens long, {field}, shard long, sequence_id long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW,
         what=as_bytes, field: str = "ids binary") -> DataFrame:
    """Every piece with its sequence_id, its offset there and ``field``, which
    is ``what`` of its ids (the ids themselves, if nothing else is said)."""
    name = field.split()[0]
    shards = max(1, -(-docs.count() // SHARD_DOCS))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        length = table["length"].to_numpy()
        null = np.array(table["doc_id"].is_null().to_pylist(), bool)
        doc = table["doc_id"].fill_null(0).to_numpy()
        order = np.lexsort((table["start"].to_numpy(), doc, ~null, -length))
        w, off = best_fit_decreasing(length[order].tolist(), window)
        shard = table["shard"][0].as_py() if len(order) else 0
        out = table.take(pa.array(order)).drop_columns(["shard", "sequence_id"])
        return (out.append_column("sequence_id", pa.array(np.array(w, np.int64) + (shard << 32)))
                .append_column("offset", pa.array(np.array(off, np.int64))))
    every = stored(pieces(docs, tokenizer, end_id, window, shards, what, field), "pack-pieces")
    whole = (every.where("shard is null")
             .select("doc_id", "start", "length", "doc_tokens", name, "sequence_id", F.lit(0).cast("long").alias("offset")))
    return whole.unionByName(every.where("shard is not null").groupBy("shard").applyInArrow(
        run, f"doc_id long, start long, length long, doc_tokens long, {field}, sequence_id long, offset long"))


def sequences(packed: DataFrame, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """The padded sequences: sequence_id, n_ids, ids (uint16, ``window`` each)."""
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["offset"].to_numpy())
        ids = np.concatenate([np.frombuffer(table["ids"][int(k)].as_py(), np.uint16) for k in order])
        full = np.full(window, pad_id, np.uint16)
        full[:len(ids)] = ids
        return pa.table({"sequence_id": table["sequence_id"][:1], "n_ids": pa.array([len(ids)], pa.int64()),
                         "ids": pa.array([full.tobytes()], pa.binary())})
    return (packed.select("sequence_id", "offset", "ids").groupBy("sequence_id")
            .applyInArrow(run, "sequence_id long, n_ids long, ids binary"))


def packed_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces with the crc32 of their ids instead of the ids."""
    return (pack(docs, tokenizer, what=as_crc32, field="ids_crc32 long")
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
