"""Whole-batch text arithmetic on Arrow buffers (numpy, no per-row Python).

A word is ``[^\\x20\\x09-\\x0D]+``.  All byte positions below refer to the
UTF-8 data of one chunk of texts laid end to end.  Null texts are empty texts,
without words, windows or hashes; a text of any length stays whole, alone in its
chunk if it is longer than one; equal texts give equal hashes; no texts give no
chunk.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, base & (2**64 - 1), np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give free memory back to the system, as a worker stays for later tasks; where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_relieved = [0.0]


def relieve(seconds: float = 1.0) -> None:
    """``release`` at most so often, for functions that are called for many small groups."""
    if time.monotonic() - _relieved[0] > seconds:
        release()
        _relieved[0] = time.monotonic()


class Chunk:
    """Texts end to end: ``data`` bytes and ``offsets`` of len(texts) + 1."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the first word of each text (n + 1 entries)."""
        inside = np.zeros(len(self.data) + 2, bool)
        np.logical_not(_SPACE[self.data], out=inside[1:-1])
        edge = inside[1:] != inside[:-1]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.data))]
        cut = np.unique(cut[inside[cut] & inside[cut + 1]])  # a word up to a text's end and one from the next's start
        flips = np.flatnonzero(edge)
        starts, ends = flips[0::2], flips[1::2]
        if len(cut):
            starts, ends = np.sort(np.r_[starts, cut]), np.sort(np.r_[ends, cut])
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        data = _LOWER[self.data] if lower else self.data
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power_table(_BASE, len(data)), out=run[1:])
        raw = (run[ends] - run[starts]) * _power_table(_BASE_INV, len(data) + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a 0/1 byte array over each text."""
        run = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, Chunk]]:
    """(first row, chunk) over a string array; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, Chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside texts, and the first window of each text (len(first) entries)."""
    count = np.diff(first)
    windows = np.maximum(count - n + 1, 0)
    bounds = np.r_[0, np.cumsum(windows)]
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    at = np.repeat(first[:-1] - bounds[:-1], windows) + np.arange(bounds[-1])
    out = np.zeros(bounds[-1], np.uint64)
    for k in range(n):
        out = (out + words[at + k]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2 * k + 1)
    return mix(out), bounds
