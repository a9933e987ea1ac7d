"""Token-ID output: static range asymmetric numeral system (rANS) files.

A token file is a folder of Parquet parts, written and committed by Spark (a
lost executor only repeats its part).  Each row is one self-contained block:
``part, block, start`` (ids of the part before it), ``n_ids`` and ``payload``.
All blocks share one static frequency table, counted over the whole corpus.

Payload, little-endian: header (magic, version, scale bits, lanes, steps per
checkpoint, number of documents and ids, crc32 of the table, of the ids, and of
everything behind the header), the documents (id, null flag, ids each), the
checkpoints (first word and all lane states before each segment) and the coded
32-bit words.  ``LANES`` coder states are interleaved: step t codes the ids
``t*LANES ... t*LANES+LANES-1`` with one vector operation.  A checkpoint every
``STEPS`` steps lets segments of a block be decoded on their own, in any order;
blocks are independent of each other as well.

Nulls: a null text has no ids but the end id; a null ``doc_id`` sorts first.
Equal ``doc_id`` rows are all kept, ordered by their ids.  An empty table gives
files without blocks.  Further columns of the input are ignored.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.llm.common import scratch_path, stored
from classyard.llm.tokens import encoder, text_slices

SCALE = 20                    # frequencies sum to 2**SCALE
LANES, STEPS = 4096, 128      # ids per segment: LANES * STEPS
BLOCK_IDS = 1 << 20           # a block is closed by the document that reaches this
LOW = 1 << 31                 # coder states lie in [LOW, LOW << 32)
HEAD = struct.Struct("<4sHHIIqqIII")
MEMO = 1_600_000              # chunks that a Python worker remembers
MAGIC, VERSION = b"rANS", 1

IDS_SCHEMA = "doc_id long, ids binary"
BLOCK_SCHEMA = "part int, block int, start long, n_ids long, payload binary"


class Table:
    """Quantised static frequencies of symbols 0 ... len(counts)-1."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        self.freq = quantise(counts)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self.freq = self.freq.astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - SCALE)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))


def quantise(counts: np.ndarray) -> np.ndarray:
    """Integer frequencies with sum 2**SCALE, at least 1 for each seen symbol."""
    total, space = int(counts.sum()), 1 << SCALE
    if total == 0:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * space / total).astype(np.int64)), 0)
    order = np.argsort(-counts, kind="stable")
    left = space - int(freq.sum())
    if left > 0:
        freq[order[0]] += left
    for s in order:
        if left >= 0:
            break
        take = min(int(freq[s]) // 2, -left)
        freq[s] -= take
        left += take
    return freq


def encode_ids(ids: np.ndarray, table: Table) -> tuple[list, np.ndarray]:
    """Checkpoints [(first word, states)] in decoding order, and the words."""
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    words, marks, seen = [], [], 0
    freq, cum, limit = table.freq[ids], table.cum[ids], table.limit[ids]
    low32, b32, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min(n, (t + 1) * LANES)
        x, f = state[:b - a], freq[a:b]
        out = x >= limit[a:b]
        if out.any():
            words.append((x[out] & low32).astype(np.uint32))
            seen += len(words[-1])
            x[out] >>= b32
        q, r = np.divmod(x, f)
        state[:b - a] = (q << scale) + r + cum[a:b]
        if t % STEPS == 0:
            marks.append((seen, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    return [(len(stream) - s, st) for s, st in marks[::-1]], stream


def decode_segment(k: int, n: int, mark, words: np.ndarray, table: Table, slots: np.ndarray) -> np.ndarray:
    """Ids of segment k of a block of n ids, from its checkpoint alone."""
    at, state = int(mark[0]), mark[1].copy()
    first, last = k * STEPS * LANES, min(n, (k + 1) * STEPS * LANES)
    out = np.empty(last - first, np.uint16)
    mask, b32, scale, low = np.uint64((1 << SCALE) - 1), np.uint64(32), np.uint64(SCALE), np.uint64(LOW)
    for a in range(first, last, LANES):
        b = min(last, a + LANES)
        x = state[:b - a]
        slot = x & mask
        sym = slots[slot]
        out[a - first:b - first] = sym
        x = table.freq[sym] * (x >> scale) + slot - table.cum[sym]
        need = x < low
        c = int(np.count_nonzero(need))
        if c:
            x[need] = (x[need] << b32) | words[at:at + c]
            at += c
        state[:b - a] = x
    return out


def pack_block(doc_ids: list, parts: list[np.ndarray], table: Table) -> bytes:
    ids = np.concatenate(parts)
    marks, words = encode_ids(ids, table)
    body = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([len(p) for p in parts], "<i8").tobytes(),
        *(struct.pack("<q", at) + st.astype("<u8").tobytes() for at, st in marks),
        words.astype("<u4").tobytes()])
    return HEAD.pack(MAGIC, VERSION, SCALE, LANES, STEPS, len(doc_ids), len(ids), table.crc,
                     zlib.crc32(ids.astype("<u2").tobytes()), zlib.crc32(body)) + body


def unpack_block(payload: bytes, table: Table, slots: np.ndarray) -> tuple[list, list[np.ndarray]]:
    """(doc ids, id arrays) of a block; raises on a wrong table or checksum."""
    magic, version, scale, lanes, steps, n_docs, n, table_crc, ids_crc, body_crc = HEAD.unpack_from(payload)
    body = memoryview(payload)[HEAD.size:]
    if (magic, version, scale, lanes, steps) != (MAGIC, VERSION, SCALE, LANES, STEPS) or table_crc != table.crc:
        raise ValueError("block of another format or frequency table")
    if zlib.crc32(body) != body_crc:
        raise ValueError("block is damaged")
    doc_ids = np.frombuffer(body, "<i8", n_docs)
    at = 8 * n_docs
    nulls = np.frombuffer(body, np.uint8, n_docs, at)
    at += n_docs
    lens = np.frombuffer(body, "<i8", n_docs, at)
    at += 8 * n_docs
    marks = []
    for _ in range(-(-n // (LANES * STEPS))):
        marks.append((struct.unpack_from("<q", body, at)[0], np.frombuffer(body, "<u8", LANES, at + 8).astype(np.uint64)))
        at += 8 + 8 * LANES
    words = np.frombuffer(body, "<u4", offset=at).astype(np.uint64)
    ids = np.concatenate([decode_segment(k, n, m, words, table, slots) for k, m in enumerate(marks)])
    if zlib.crc32(ids.astype("<u2").tobytes()) != ids_crc:
        raise ValueError("decoded ids are damaged")
    return [None if z else int(d) for d, z in zip(doc_ids, nulls)], np.split(ids, np.cumsum(lens)[:-1])


def tokenise(docs: DataFrame, path: str, keep_blank: bool, end_id: int) -> DataFrame:
    """doc_id and its uint16 ids (with the end id) of every whole text."""
    def run(batches):
        enc = encoder(path, keep_blank, MEMO)
        for b in batches:
            for lo, hi, texts in text_slices(b.column(1)):
                ids = [x.tobytes() for x in enc.encode(texts, end_id)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(run, IDS_SCHEMA)


def all_ids(column: pa.Array) -> np.ndarray:
    """The ids of all rows of a binary column, one after another."""
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(values, np.uint8)[at[0]:at[-1]].view(np.uint16) if len(column) and at[-1] > at[0] else np.empty(0, np.uint16)


def as_bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes()


def as_crc32(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def count_ids(ids: DataFrame, size: int = 1 << 16) -> np.ndarray:
    """Counts of all ids.  Tasks send (id, count) pairs; the driver receives at
    most one row per vocabulary entry."""
    def run(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(all_ids(b.column(0)), minlength=size)
        s = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(n[s], pa.int64())], ["symbol", "n"])
    got = ids.select("ids").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in got:
        counts[r["symbol"]] = r["n"]
    return counts


def write_token_file(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1,
                     keep_blank: bool = False) -> np.ndarray:
    """Encode every whole text and write the token file ``out`` in ascending
    doc_id order; returns the corpus counts that define its table."""
    spark = docs.sparkSession
    ids = stored(tokenise(docs, tokenizer, keep_blank, end_id), "ids")
    counts = count_ids(ids)

    def run(batches):
        from pyspark import TaskContext
        part, table = TaskContext.get().partitionId(), Table(counts)
        block, start = 0, 0
        doc_ids, parts, size = [], [], 0

        def close():
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                 "start": pa.array([start], pa.int64()), "n_ids": pa.array([size], pa.int64()),
                 "payload": pa.array([pack_block(doc_ids, parts, table)], pa.binary())})
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                parts.append(np.frombuffer(x.as_py(), np.uint16))
                doc_ids.append(d)
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    yield close()
                    block, start = block + 1, start + size
                    doc_ids, parts, size = [], [], 0
        if parts:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the digest as a second key lets a hot (null or repeated) doc_id be split
    (ids.withColumn("_tie", F.xxhash64("ids")).repartitionByRange(n, F.col("doc_id"), F.col("_tie"))
        .sortWithinPartitions("doc_id", "_tie", "ids").select("doc_id", "ids")
        .mapInArrow(run, BLOCK_SCHEMA).write.parquet(out))
    return counts


def read_token_file(spark, path: str, counts: np.ndarray, what=as_bytes, field: str = "ids binary") -> DataFrame:
    """One row per document of a token file: doc_id, start (ids of all
    documents before it), n_tokens and ``field``, which is ``what`` of its ids
    (the ids themselves, if nothing else is said).  The driver sums one number
    per part of the file."""
    name, kind = field.split()
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sums = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, offsets = 0, {}
    for p in sorted(sums):
        offsets[p] = before
        before += sums[p]

    def run(batches):
        table = Table(counts)
        slots = table.slots()
        for b in batches:
            for part, start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                doc_ids, parts = unpack_block(payload.as_py(), table, slots)
                lens = np.array([len(p) for p in parts], np.int64)
                first = offsets[part] + start + np.cumsum(lens) - lens
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(first), pa.array(lens),
                     pa.array([what(p) for p in parts], pa.binary() if kind == "binary" else pa.int64())],
                    ["doc_id", "start", "n_tokens", name])
    return blocks.select("part", "start", "payload").mapInArrow(run, f"doc_id long, start long, n_tokens long, {field}")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the corpus as a token file and return per document, from the file
    read back: doc_id, start, n_tokens, ids_crc32."""
    out = scratch_path(docs.sparkSession, "tokens")
    counts = write_token_file(docs, out, tokenizer, end_id)
    return read_token_file(docs.sparkSession, out, counts, as_crc32, "ids_crc32 long")
