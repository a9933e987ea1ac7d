"""Whole-text encoding with the ``tokenizers`` library.

Both supported tokenizers never merge across certain places of a text,
whatever surrounds them.  A text is cut at such places, each *distinct* chunk
is encoded once by the library, and the ids of a text are the ids of its chunks
in order.  Text repeats most of its chunks, so this is several times faster
than encoding every text from scratch and gives the same ids (tested against
the library's own encoding of whole texts).

* ``keep_blank=False`` (white space is dropped, case is folded): any ASCII
  blank is a boundary.
* ``keep_blank=True`` (a blank belongs to the word after it): a single blank
  between two non-white characters is a boundary before the blank, a single
  line break between two non-white characters one on both sides.  Texts with
  other white space (runs, tabs, leading or trailing blanks) are cut only at
  single blanks between non-white characters.
* Both: a run of ASCII signs between a Latin letter and white space is a piece
  of its own.

Texts that hold an added token of the tokenizer (``<|endoftext|>``) are encoded
whole, as the library does by default.
"""
from __future__ import annotations

import os
import re

import numpy as np

_SINGLE_BLANK = re.compile(r"(?<=\S)(?= \S)")
# a run of ASCII signs between a letter and a blank
_STOP = re.compile(r"[!-/:-@\[-`{-~](?<=[A-Za-zÀ-ÖØ-öø-ÿ][!-/:-@\[-`{-~])[!-/:-@\[-`{-~]*(?=[ \n]|$)")


def _regular(text: str) -> bool:
    """Only single blanks and line breaks, each between non-white characters."""
    t = text.replace("\n", " ")
    return t.isprintable() and "  " not in t and t[0] != " " and t[-1] != " "


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models use for each byte: bytes
    that print stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Codes(dict):
    """chunk -> code; a chunk never seen before gets the next code."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk):
        self.new.append(chunk)
        self[chunk] = code = len(self)
        return code


class ChunkEncoder:
    """Encoder of texts into uint16 id arrays with a bounded memo of chunks."""

    def __init__(self, path: str, keep_blank: bool, memo: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        added = list(self.tok.get_added_tokens_decoder().values())
        if any(a.normalized or not a.special for a in added):
            raise ValueError("added tokens must be special and matched before normalisation")
        self.added = [a.content for a in added]
        # for chunks: folding case must not make an added token of <|ENDOFTEXT|>
        self.part = Tokenizer.from_file(path)
        self.part.encode_special_tokens = True
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("vocabulary does not fit 16-bit ids")
        self.keep_blank, self.memo = keep_blank, memo
        # Chunks of Latin letters are one pre-token each whatever the pattern:
        # they go to the library's model many at a time, between joints.
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.letters = _byte_letters()
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.joint = self.letters[10] if keep_blank else "!"
        self.joint_id = self.tok.model.tokenize(self.joint)[0].id
        self._reset()

    def _reset(self):
        self.codes = _Codes()
        self.ids = np.empty(1 << 16, np.uint16)
        self.filled = 0
        # chunk c: size[c] ids from start[c] on
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = np.zeros(0, np.int64)

    def _prune(self):
        """Forget the chunks that were used least, at least half of them."""
        used = self.used[:len(self.codes)]
        least = max(3, int(np.partition(used, len(used) // 2)[len(used) // 2]) + 1)
        keep = np.flatnonzero(used >= least)
        names = list(self.codes)
        codes = _Codes()
        for k, c in enumerate(keep.tolist()):
            codes[names[c]] = k
        lo, n = self.start[keep], self.size[keep]
        stop = np.cumsum(n)
        self.filled = int(stop[-1]) if len(stop) else 0
        self.ids = np.concatenate([self.ids[np.repeat(lo - (stop - n), n) + np.arange(self.filled)], np.zeros(1 << 16, np.uint16)])
        self.start = np.concatenate([stop - n, np.zeros(1 << 14, np.int64)])
        self.size = np.concatenate([n, np.zeros(1 << 14, np.int64)])
        self.used, self.codes = used[keep] // 2, codes

    def _chunks(self, text: str) -> list[str]:
        if not self.keep_blank:
            if text.isascii():
                text = text.lower()
            return _STOP.sub(r" \g<0>", text).replace("\n", " ").split(" ")
        if not _regular(text):
            return _SINGLE_BLANK.split(text)
        return _STOP.sub("\x00\\g<0>", text).replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")

    def _single(self, chunk: str) -> str | None:
        """The model's spelling of a chunk of Latin letters, else None."""
        word = chunk[1:] if self.keep_blank and chunk[:1] == " " else chunk
        if not word.isalpha():
            return None
        plain = word.isascii()
        if not plain and max(word) >= "Ā":
            return None
        if not self.keep_blank:
            word = word.lower()
        if not plain:
            word = word.encode().decode("latin-1").translate(self.letters)
        return self.letters[32] + word if chunk[0] == " " else word

    def _learn(self):
        new, self.codes.new = self.codes.new, []
        n1 = len(self.codes)
        n0 = n1 - len(new)
        words = [self._single(c) for c in new]
        size = np.zeros(len(new), np.int64)
        start = np.zeros(len(new), np.int64)
        at = np.flatnonzero(np.fromiter((w is not None for w in words), bool, len(words)))
        ids = np.empty(0, np.uint16)
        if len(at):
            # one text of all words between joints; the ids between joints are the words'
            text = f" {self.joint} ".join([w for w in words if w is not None])
            raw = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            joint = raw == self.joint_id
            ids = raw[~joint]
            last = np.append(np.flatnonzero(joint) - np.arange(len(at) - 1), len(ids))
            size[at] = np.diff(last, prepend=0)
            start[at] = last - size[at]
        rest = np.flatnonzero(np.fromiter((w is None for w in words), bool, len(words)))
        if len(rest):
            lists = [e.ids for e in self.part.encode_batch_fast([new[k] for k in rest], add_special_tokens=False)]
            size[rest] = [len(x) for x in lists]
            start[rest] = len(ids) + np.cumsum(size[rest]) - size[rest]
            ids = np.concatenate([ids, np.array([i for x in lists for i in x], np.uint16)])
        while n1 > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.start, self.size))
        self.start[n0:n1], self.size[n0:n1] = start + self.filled, size
        end = self.filled + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint16)])
        self.ids[self.filled:end] = ids
        self.filled = end

    def encode(self, texts, end_id: int) -> list[np.ndarray]:
        """One uint16 array per text, ``end_id`` appended; null is empty."""
        if len(self.codes) > self.memo:
            self._prune()
        n_chunks, flat, whole = [], [], {}
        for k, t in enumerate(texts):
            if t and any(a in t for a in self.added):
                whole[k] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint16)
                t = None
            cs = self._chunks(t) if t else []
            n_chunks.append(len(cs))
            flat += cs
        code = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        if self.codes.new:
            self._learn()
        if len(self.used) < len(self.codes):
            self.used = np.concatenate([self.used, np.zeros(len(self.codes) - len(self.used), np.int64)])
        self.used += np.bincount(code, minlength=len(self.used))
        lo, n = self.start[code], self.size[code]
        stop = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(lo - stop[:-1], n) + np.arange(stop[-1])]
        cuts = stop[np.concatenate([[0], np.cumsum(n_chunks, dtype=np.int64)])]
        end = np.array([end_id], np.uint16)
        return [np.concatenate([whole.get(k, ids[a:b]), end]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


_ENCODERS: dict = {}


def encoder(path: str, keep_blank: bool, memo: int = 600_000) -> ChunkEncoder:
    """One encoder per Python worker: its memo (about 160 bytes a chunk) serves
    all tasks of the worker."""
    key = (path, keep_blank, memo)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, keep_blank, memo)
    return _ENCODERS[key]


def text_slices(column, max_bytes: int = 1_000_000):
    """Runs of rows of bounded total length of an Arrow string column, each as
    (first row, row behind the last, texts)."""
    import pyarrow.compute as pc
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        done = int(size[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + max_bytes, side="right")))
        yield lo, hi, column[lo:hi].to_pylist()
        lo = hi
