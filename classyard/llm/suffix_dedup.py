"""Removal of byte passages that occur twice, by a distributed merge sort of
suffixes.

A byte goes if a string of ``SPAN`` bytes that covers it also starts anywhere
else in the corpus.  Strings never cross texts and are judged on the input.

1. Anchors.  Every string of SPAN bytes owns one anchor: the leftmost least
   hash among its K-grams.  Equal strings have their anchors at equal offsets,
   so only the suffixes at anchors (about one in 60 bytes) need to be sorted.
2. Screening.  Anchors whose K-gram occurs once cannot repeat and are left out.
3. Runs.  Tasks sort the suffixes of their anchors (up to SPAN bytes, equal ones
   once), front-code them by the prefix shared with the one before, and deal
   them by a hash of the K-gram: one run per task slice and partition.
4. Merge.  A partition combines its runs with a loser tree that carries the
   common prefix of each head with the last suffix put out: heads with
   different common prefixes are ordered without a look at their bytes, others
   are compared behind the prefix only.  It gives the sorted suffixes and the
   common prefix of each with its predecessor.
5. Repeats.  For each offset of an anchor in its string, the sorted suffixes
   and the sorted (reversed) left contexts give classes of equal right and left
   parts; a string is repeated if its pair of classes occurs twice.
6. The repeated offsets go back to the runs, and from there, as byte spans, to
   the texts.  Occurrences of equal suffixes never leave their run, so a group
   of copies sends one suffix per run, however large it is.

Results are exact but for rows of equal 64-bit keys (doc_id and text); K-gram
hashes only choose anchors and candidates.  Null texts
are empty; texts shorter than SPAN keep all bytes; repeated rows repeat each
other's strings; an empty table gives no rows.  Only doc_id and text are read.
"""
from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.llm.common import stored
from classyard.llm.textvec import Buffer, mix64
from classyard.llm.tokens import text_slices

SPAN = 200
K = 32
WIDTH = SPAN - K + 1            # K-grams of a string: an anchor's offset is 0 ... WIDTH-1
PART_SUFFIXES = 20_000          # of a partition of the merge, on average
MIN_PARTS = 64
SLICE = 3_000_000               # bytes of text that make a run


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _expand(raw) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


# --- anchors ----------------------------------------------------------------

def anchors(buf: Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, first string, last string, K-gram hash) of all
    anchors; positions in the buffer, strings by their start."""
    n, none = len(buf.data), (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    if n <= SPAN:
        return none
    h = mix64((buf.sums[K:] - buf.sums[:-K]) * buf.inverse[:n - K + 1])
    low = np.uint64((1 << 26) - 1)
    rows = -(-len(h) // WIDTH)
    grid = np.full(rows * WIDTH, ~np.uint64(0))
    np.bitwise_or(h & ~low, np.arange(len(h), dtype=np.uint64), out=grid[:len(h)])     # ties go to the leftmost
    grid = grid.reshape(rows, WIDTH)
    m = len(h) - WIDTH + 1
    who = np.minimum(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:m],
                     np.minimum.accumulate(grid, axis=1).ravel()[WIDTH - 1:WIDTH - 1 + m])
    # strings that lie within one text: the white byte behind a text is not part of it
    room = np.clip(buf.ends - buf.starts - SPAN, 0, None)
    edge = np.zeros(m + 1, np.int8)
    inner = room > 0
    np.add.at(edge, np.minimum(buf.starts[inner], m), 1)
    np.add.at(edge, np.minimum(buf.starts[inner] + room[inner], m), -1)
    ok = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    new = np.empty(m, bool)
    new[:1] = True
    np.not_equal(who[1:], who[:-1], out=new[1:])
    new[1:] |= ~ok[:-1]
    first = np.flatnonzero(new & ok)
    if not len(first):
        return none
    stop = np.empty(m, bool)
    stop[-1:] = True
    stop[:-1] = new[1:] | ~ok[1:]
    last = np.flatnonzero(stop & ok)
    a = (who[first] & low).astype(np.int64)
    return np.searchsorted(buf.ends, first, side="right"), a, first, last, h[a]


def code(pos, first, last):
    """An anchor in one number: position in its text, offset in its first and
    in its last string."""
    return (pos << 16) | ((pos - first) << 8) | (pos - last)


# --- runs -------------------------------------------------------------------

def common_prefixes(rows: list[bytes], width: int) -> np.ndarray:
    """Of each string with the one before (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    for lo in range(0, len(rows), 20_000):
        part = rows[max(0, lo - 1):lo + 20_000]
        raw = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in part), np.uint8).reshape(len(part), width)
        size = np.fromiter(map(len, part), np.int64, len(part))
        differ = raw[1:] != raw[:-1]
        h = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[lo + (lo == 0):lo + (lo == 0) + len(h)] = np.minimum(h, np.minimum(size[1:], size[:-1]))
    return out


def pack_run(suffixes: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """Front-coded: (right part, reversed left part, largest and least offset,
    occurrences, at most 2) in ascending order."""
    right = [s[0] for s in suffixes]
    lcp = common_prefixes(right, SPAN)
    head = np.array([[h, len(r) - h, len(s[1]), s[2], s[3], s[4]] for h, r, s in zip(lcp, right, suffixes)], "<u2")
    body = b"".join([r[h:] for h, r in zip(lcp.tolist(), right)] + [s[1] for s in suffixes])
    return _squeeze(len(suffixes).to_bytes(4, "little") + head.tobytes() + body)


def unpack_run(blob: bytes) -> tuple[list[bytes], list[int], list[bytes], np.ndarray]:
    """Right parts, their common prefixes, left parts, (offsets, occurrences)."""
    raw = _expand(blob)
    n = int.from_bytes(raw[:4], "little")
    head = np.frombuffer(raw, "<u2", 6 * n, 4).reshape(n, 6).astype(np.int64)
    at, right, prev = 4 + 12 * n, [], b""
    for h, t in head[:, :2].tolist():
        prev = prev[:h] + raw[at:at + t]
        at += t
        right.append(prev)
    left = []
    for t in head[:, 2].tolist():
        left.append(raw[at:at + t])
        at += t
    return right, head[:, 0].tolist(), left, head[:, 3:]


# --- merge ------------------------------------------------------------------

def _first_difference(x: bytes, y: bytes, h: int) -> int:
    """Length of the common prefix of x and y, known to be h at least."""
    n = min(len(x), len(y))
    d = int.from_bytes(x[h:n], "big") ^ int.from_bytes(y[h:n], "big")
    return n - (d.bit_length() + 7) // 8 if d else n


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, index, common prefix with the one before) of all strings in order.
    A run is its sorted strings and their common prefixes with predecessors."""
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    strings = [r[0] for r in runs]
    at = [0] * size
    known = [0] * size                       # common prefix of a head with the last output
    head = [s[0] if s else None for s in strings] + [None] * (size - k)

    def beats(a: int, b: int) -> bool:
        """Whether head a comes before head b; the loser's known prefix becomes
        that with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return True
        if x is None:
            return False
        if known[a] != known[b]:
            return known[a] > known[b]
        h = _first_difference(x, y, known[a])
        if h == len(x) and (h < len(y) or a < b) or h < len(x) and h < len(y) and x[h] < y[h]:
            known[b] = h
            return True
        known[a] = h
        return False

    loser = [0] * size
    winner = list(range(size)) if size > 1 else [0]
    level = winner
    node0 = size
    while len(level) > 1:
        node0 >>= 1
        up = []
        for j in range(0, len(level), 2):
            a, b = level[j], level[j + 1]
            w, x = (a, b) if beats(a, b) else (b, a)
            loser[node0 + j // 2] = x
            up.append(w)
        level = up
    w = level[0]
    total = sum(map(len, strings))
    out_run, out_index, out_known = [0] * total, [0] * total, [0] * total
    for n in range(total):
        i = at[w]
        out_run[n], out_index[n], out_known[n] = w, i, known[w]
        i += 1
        at[w] = i
        if i < len(strings[w]):
            head[w], known[w] = strings[w][i], runs[w][1][i]
        else:
            head[w] = None
        node = (w + size) >> 1
        while node:
            x = loser[node]
            if not beats(w, x):
                loser[node], w = w, x
            node >>= 1
    return np.array(out_run, np.int64), np.array(out_index, np.int64), np.array(out_known, np.int64)


# --- repeats ----------------------------------------------------------------

def repeated_offsets(known: np.ndarray, left: list[bytes], most: np.ndarray, least: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Matrix (suffix, offset) of repeated strings.  ``known``: common prefix of
    each right part with the one before; ``left``: reversed left parts."""
    n = len(left)
    order = sorted(range(n), key=left.__getitem__)
    lcp = common_prefixes([left[k] for k in order], WIDTH)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out = np.zeros((n, WIDTH), bool)
    for o in range(WIDTH):
        use = np.flatnonzero((least <= o) & (o <= most))
        if not len(use):
            continue
        right_class = np.cumsum(known < SPAN - o)[use]
        left_class = np.cumsum(lcp < o)[place[use]] if o else np.zeros(len(use), np.int64)
        key = right_class * (n + 1) + left_class
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        weight = np.bincount(inverse, weights=times[use]) if (times[use] > 1).any() else count
        out[use, o] = weight[inverse] > 1
    return out


def offset_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of set columns."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def joined_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the spans."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    return start[first], end[np.concatenate([first[1:] - 1, [len(start) - 1]])]


# --- on Spark ---------------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text.  Rows of one key are equal, so they share their spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def _squeezed(keyed: DataFrame) -> DataFrame:
    """doc_id, key and the deflated text: what a join has to move."""
    def run(batches):
        for b in batches:
            for lo, hi, texts in text_slices(b.column(2)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array([_squeeze(t.encode()) for t in texts], pa.binary())],
                    ["doc_id", "key", "z"])
    return keyed.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, z binary")


def candidates(keyed: DataFrame) -> DataFrame:
    """key, codes: the anchors of a text whose K-gram occurs more than once."""
    def run(batches):
        for b in batches:
            for lo, hi, texts in text_slices(b.column(1), 1_500_000):
                buf = Buffer(texts)
                doc, a, first, last, h = anchors(buf)
                base = buf.starts[doc]
                key = b.column(0)[lo:hi].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.astype(np.int64)), pa.array(key[doc]), pa.array(code(a - base, first - base, last - base))], ["gram", "key", "code"])
    found = keyed.select("key", "text").mapInArrow(run, "gram long, key long, code long")
    many = stored(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "suffix-grams")
    return found.join(many, "gram").select("key", "code")


def suffix_runs(keyed: DataFrame, chosen: DataFrame, parts: int) -> DataFrame:
    """run, part, blob (front-coded suffixes), seen (where they occur)."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        seen, size = {}, 0

        def close():
            nonlocal number, seen, size
            by_part: dict[int, list] = {}
            for s in seen:
                by_part.setdefault(hash_part(s[0]), []).append(s)
            rows = [[], [], [], []]
            for p, group in by_part.items():
                group.sort()
                where = [seen[s] for s in group]
                rows[0].append(number)
                rows[1].append(p)
                rows[2].append(pack_run([(*s, min(2, len(x) // 2)) for s, x in zip(group, where)]))
                rows[3].append(_squeeze(np.array([len(x) for x in where], "<i8").tobytes()
                                             + np.array([y for x in where for y in x], "<i8").tobytes()))
            number, seen, size = number + 1, {}, 0
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()),
                                               pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], ["run", "part", "blob", "seen"])

        def hash_part(right: bytes) -> int:
            return crc32(right[:K]) % parts
        for b in batches:
            for key, z, codes in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                text = _expand(z.as_buffer())
                size += len(text)
                for c in codes.as_py():
                    pos, most, least = c >> 16, c >> 8 & 255, c & 255
                    s = (text[pos:pos - least + SPAN], text[pos - most:pos][::-1], most, least)
                    seen.setdefault(s, []).extend((key, pos))
                if size >= SLICE:
                    yield close()
        if seen:
            yield close()
    grouped = chosen.groupBy("key").agg(F.collect_set("code").alias("codes"))
    return _squeezed(keyed).join(grouped, "key").select("key", "z", "codes").mapInArrow(run, "run long, part int, blob binary, seen binary")


def merged(runs: DataFrame) -> DataFrame:
    """run, part, hits: the repeated offsets of the run's suffixes there, as
    numbers (suffix, first offset, last offset)."""
    def run(table: pa.Table) -> pa.Table:
        parts = [unpack_run(x.as_py()) for x in table["blob"]]
        who, index, known = merge_runs([(p[0], p[1]) for p in parts])
        left = [parts[r][2][i] for r, i in zip(who.tolist(), index.tolist())]
        start = np.cumsum([0] + [len(p[0]) for p in parts])
        info = np.concatenate([p[3] for p in parts])[start[who] + index]
        row, first, last = offset_runs(repeated_offsets(known, left, info[:, 0], info[:, 1], info[:, 2]))
        hit = np.stack([index[row], first, last], axis=1).astype("<i4")
        of = who[row]
        order = np.argsort(of, kind="stable")
        hit, of = hit[order], of[order]
        runs_hit, cut = np.unique(of, return_index=True)
        return pa.table({"run": table["run"].combine_chunks().take(pa.array(runs_hit)), "part": table["part"].combine_chunks().take(pa.array(runs_hit)),
                         "hits": pa.array([x.tobytes() for x in np.split(hit, cut[1:])] if len(hit) else [], pa.binary())})
    return runs.select("run", "part", "blob").groupBy("part").applyInArrow(run, "run long, part int, hits binary")


def spans(runs: DataFrame, hits: DataFrame) -> DataFrame:
    """key, spans: (start, end) pairs of removed bytes, several rows per key."""
    def run(batches):
        for b in batches:
            for seen, hit in zip(b.column(0), b.column(1)):
                raw = np.frombuffer(_expand(seen.as_py()), "<i8")
                h = np.frombuffer(hit.as_py(), "<i4").reshape(-1, 3).astype(np.int64)
                n = _n_suffixes(raw)
                size = raw[:n] // 2
                where = raw[n:].reshape(-1, 2)
                begin = np.concatenate([[0], np.cumsum(size)])
                c = size[h[:, 0]]
                pick = np.repeat(begin[h[:, 0]] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum()))
                key, pos = where[pick, 0], where[pick, 1]
                start, end = pos - np.repeat(h[:, 2], c), pos - np.repeat(h[:, 1], c) + SPAN
                order = np.lexsort((start, key))
                key, start, end = key[order], start[order], end[order]
                names, cut = np.unique(key, return_index=True)
                both = [np.stack(joined_spans(s, e), axis=1).astype("<i4").tobytes() for s, e in zip(np.split(start, cut[1:]), np.split(end, cut[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(both, pa.binary())], ["key", "spans"])
    return (runs.select("run", "part", "seen").join(hits, ["run", "part"]).select("seen", "hits")
            .mapInArrow(run, "key long, spans binary"))


def _n_suffixes(raw: np.ndarray) -> int:
    """Suffixes of a ``seen`` blob: as many sizes lead it as make up the rest."""
    total = np.cumsum(raw)
    return int(np.flatnonzero(total + np.arange(1, len(raw) + 1) == len(raw))[0]) + 1


def removed_spans(docs: DataFrame) -> DataFrame:
    """key, parts (arrays of span pairs, to be joined), of texts that lose bytes."""
    keyed = _keyed(docs)
    chosen = stored(candidates(keyed), "suffix-candidates")
    parts = max(MIN_PARTS, -(-chosen.count() // PART_SUFFIXES))
    runs = stored(suffix_runs(keyed, chosen, parts), "suffix-runs")
    hits = stored(merged(runs), "suffix-hits")
    return spans(runs, hits).groupBy("key").agg(F.collect_list("spans").alias("parts"))


def deduplicated(docs: DataFrame, what=bytes, field: str = "kept binary") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``field``: ``what`` of the
    remaining bytes (the bytes themselves, if nothing else is said)."""
    name, kind = field.split()

    def run(batches):
        for b in batches:
            cols = [[], [], [], []]
            for z, parts in zip(b.column(1), b.column(2)):
                text = _expand(z.as_buffer())
                got = parts.as_py() or []
                s = np.frombuffer(b"".join(got), "<i4").reshape(-1, 2).astype(np.int64)
                start, end = joined_spans(s[:, 0], s[:, 1])
                keep, at = [], 0
                for x, y in zip(start.tolist(), end.tolist()):
                    keep.append(text[at:x])
                    at = y
                keep.append(text[at:])
                for c, v in zip(cols, (len(text), int((end - start).sum()), len(start), what(b"".join(keep)))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary() if kind == "binary" else pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", name])
    return (_squeezed(_keyed(docs)).join(removed_spans(docs), "key", "left").select("doc_id", "z", "parts")
            .mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {field}"))


def dedup_digests(docs: DataFrame) -> DataFrame:
    """One row per document with the SHA-256 of what remains of it."""
    return deduplicated(docs, lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256 string")
