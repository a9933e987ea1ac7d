"""Vectorised hashing of the words of many texts at once (NumPy, in tasks).

Texts are joined into one byte buffer; a word's hash is a difference of
polynomial prefix sums modulo 2**64, mixed afterwards, so no Python code runs
per word.
"""
from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = []
        for b in (_BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Buffer:
    """UTF-8 bytes of texts with a white byte after each."""

    def __init__(self, texts, lower: bool = False):
        raw = [(t or "").encode() for t in texts]
        lens = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.ends = np.cumsum(lens)                      # of text k with its white byte
        self.starts = self.ends - lens
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + (upper * np.uint8(32))
        n = len(self.data)
        self.power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start ... end-1."""
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def words(self, dull: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number) of all words; ``dull``: table of 256 flags
        of the bytes that separate words (white bytes by default)."""
        white = (_WHITE if dull is None else dull)[self.data]
        edge = np.diff(white.view(np.int8), prepend=np.int8(1))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(end) and len(start) and end[0] == 0:
            end = end[1:]
        return start, end, np.searchsorted(self.ends, start, side="right")
