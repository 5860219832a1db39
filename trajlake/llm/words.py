"""Words of whole Arrow text columns as NumPy arrays, without a Python object per word.

A word is a longest run of bytes other than space and \\x09-\\x0D, with A-Z in lower case.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits look independent (two multiply-shift rounds)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, n + (n >> 3))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Words:
    """Words of some texts, in order: bytes ``data[start:end]`` in text number ``text``."""

    n_texts: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            return mix64((total[self.end] - total[self.start]) * down[self.start])


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[first, last)`` of at most ``most`` bytes (one text at least), their bytes and offsets from 0."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary()) if len(texts) else texts.cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None and len(body) else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def find_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    data = _LOWER[raw]
    solid = ~_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edges = np.unique(offsets[:-1][offsets[:-1] < len(data)])
        begins[edges] = solid[edges]
        inner = edges[edges > 0] - 1
        ends[inner] = solid[inner]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(len(offsets) - 1, data, start, end, text)


def word_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    for first, last, raw, offsets in text_slices(texts, most):
        yield first, last, find_words(raw, offsets)
