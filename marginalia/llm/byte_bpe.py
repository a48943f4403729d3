"""Byte-level BPE: encoding and decoding with length-bucketed numpy matrices.

Text is split by the tokenizer's pattern; a piece that is a token is that
token.  The other pieces, each distinct one once, are laid into padded
matrices by length.  In each round every row merges its leftmost pair of
minimum rank: the rank of a pair comes from a hash table, the row closes up
over the gap, and rows without a pair left leave the matrix.

Null texts encode as empty texts; an empty text has no ids and decodes to no
bytes.  Rows are independent, so ties, repeated rows and empty tables need no
rule.  Only the named columns are read; others cannot clash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textops import Chunk, chunks, release

#: A piece of more bytes is merged by a heap under the same rule: a matrix row would be closed up once per merge, in quadratic time.
LONG = 4096
#: Cells of one matrix.
CELLS = 1 << 20
#: Distinct pieces kept with their ids by a worker; beyond it the store starts anew.
KEPT = 100_000
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from a pair of token ids to the rank of their concatenation."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, int(2 * len(pairs)).bit_length() + 1)
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        keys, ranks = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: int, right: int) -> int:
        """Rank of one pair."""
        return int(self.rank(np.array([left]), np.array([right]))[0])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is none or either id is padding (below 0)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, _NONE, np.int32)
        open_ = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys, flat = keys.ravel()[open_], out.ravel()
        slot = self._slot(keys)
        for _ in range(self.probes):
            here = self.keys[slot]
            hit = here == keys
            flat[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (here >= 0)
            if not on.any():
                break
            open_, keys, slot = open_[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(out.shape)


class Bpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.table = PairTable({(self.ranks[t[:i]] << 32) | self.ranks[t[i:]]: rank for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks})
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # for decoding: all tokens end to end, by id
        size = max(self.ranks.values()) + 1
        self.width = np.zeros(size, np.int64)
        for token, rank in self.ranks.items():
            self.width[rank] = len(token)
        self.begin = np.r_[0, np.cumsum(self.width)][:-1]
        self.letters = np.frombuffer(b"".join(t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.at, self.len = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    # -- encoding ---------------------------------------------------------
    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of like length, one matrix."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        rows = np.full((len(pieces), width), -1, np.int32)
        rows[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.table.rank(rows[:, :-1], rows[:, 1:])
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        number = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            least = ranks[line, at] if ranks.shape[1] else np.full(len(rows), _NONE)
            over = least == _NONE
            if over.any():
                for i in np.flatnonzero(over):
                    out[number[i]] = rows[i, : size[i]].copy()
                on = ~over
                rows, ranks, number, size, at, least = rows[on], ranks[on], number[on], size[on], at[on], least[on]
                if not len(rows):
                    break
                line = np.arange(len(rows))
            # close every row up over the right half of its merged pair
            size = size - 1
            width = int(size.max())
            cols = np.arange(width)
            src = cols + (cols > at[:, None])
            rows = np.take_along_axis(rows, src, 1)
            rows[line, at] = least
            rows[cols >= size[:, None]] = -1
            if width < 2:
                ranks = np.full((len(rows), 1), _NONE, np.int32)
                continue
            padded = np.c_[ranks, np.full(len(ranks), _NONE, np.int32)]
            ranks = np.take_along_axis(padded, src[:, : width - 1], 1)
            for k in (at - 1, at):  # the two pairs that the new token is part of
                ok = (k >= 0) & (k < width - 1)
                r, c = line[ok], k[ok]
                ranks[r, c] = self.table.rank(rows[r, c], rows[r, c + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same rule by a heap over a linked list."""
        start = self.byte[np.frombuffer(piece, np.uint8)]
        first = self.table.rank(start[:-1], start[1:]).tolist()
        ids = start.tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(first[i], i, ids[i], ids[i + 1]) for i in range(n - 1) if first[i] != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := self.table.get(rank, ids[k])) != _NONE:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := self.table.get(ids[h], rank)) != _NONE:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, through one matrix per length bucket and CELLS."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        at = 0
        while at < len(order):
            least = len(pieces[order[at]])
            if least > LONG:
                out[order[at]] = self.merge_long(pieces[order[at]])
                at += 1
                continue
            most, to = min(LONG, max(8, 1 << (least - 1).bit_length())), at
            while to < len(order) and len(pieces[order[to]]) <= most and (to - at + 1) * len(pieces[order[to]]) <= max(CELLS, most):
                to += 1
            for i, ids in zip(order[at:to], self.merge_matrix([pieces[i] for i in order[at:to]]), strict=True):
                out[i] = ids
            at = to
        return out

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces not seen yet."""
        raw = [p.encode() for p in new]
        whole = [self.ranks.get(p) for p in raw]
        rest = [i for i, r in enumerate(whole) if r is None]
        found = dict(zip(rest, self.merge([raw[i] for i in rest]), strict=True))
        ids = [found[i] if r is None else np.array([r], np.int32) for i, r in enumerate(whole)]
        sizes = np.array([len(x) for x in ids], np.int64)
        n, total = len(self.number), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + len(new) > len(self.at):
            self.at, self.len = np.r_[self.at, np.zeros_like(self.at)], np.r_[self.len, np.zeros_like(self.len)]
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.at[n : n + len(new)] = self.used + np.r_[0, np.cumsum(sizes)][:-1]
        self.len[n : n + len(new)] = sizes
        self.used += total
        self.number.update(zip(new, range(n, n + len(new)), strict=True))

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's texts end to end, and their n + 1 bounds."""
        raw, pieces, per = chunk.data.tobytes(), [], np.zeros(chunk.n, np.int64)
        for i in range(chunk.n):
            found = self.split(raw[chunk.offsets[i] : chunk.offsets[i + 1]].decode())
            per[i] = len(found)
            pieces += found
        if len(self.number) > KEPT or self.used > 8 * KEPT:
            self._clear()
        if new := list(set(pieces).difference(self.number)):
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        ids, ends = gather(self.flat, self.at[number], self.len[number])
        return ids, np.r_[0, ends][np.r_[0, np.cumsum(per)]]

    # -- decoding ---------------------------------------------------------
    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of ids end to end, and where each id's bytes end."""
        return gather(self.letters, self.begin[ids], self.width[ids])


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of flat laid end to end, and the end of each."""
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0], ends
    return flat[np.repeat(at - (ends - size), size) + np.arange(ends[-1])], ends


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """A tokenizer of this process."""
    return Bpe(path, pattern)


def _ids(bounds: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def _letters(bpe: Bpe, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """What each row's ids decode to."""
    letters, ends = bpe.decode(ids)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.r_[0, ends][bounds].astype(np.int32)), pa.py_buffer(letters)])


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for at, chunk in chunks(batch.column(1)):
                ids, bounds = bpe.encode(chunk)
                out = {id_col: batch.column(0).slice(at, chunk.n), "ids": _ids(bounds, ids)}
                yield pa.RecordBatch.from_pydict(out | ({"decoded": _letters(bpe, ids, bounds)} if decoded else {}))
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decoded)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``ids array<int>`` of every whole text; path: a rank file that workers can read."""
    return _encoded(docs, path, pattern, id_col, text_col, decoded=False)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode``, and ``decoded binary``: what the ids decode to, in the same pass over the texts."""
    return _encoded(docs, path, pattern, id_col, text_col, decoded=True)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Every column of ``encoded``, and ``decoded binary``; null ids decode to no bytes."""
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            step = max(1, (1 << 20) * batch.num_rows // max(1, len(batch.column(ids_col).flatten())))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                col = part.column(ids_col)
                sizes = np.asarray(col.value_lengths().fill_null(0))
                yield pa.RecordBatch.from_arrays([*part.columns, _letters(bpe, np.asarray(col.flatten()), np.r_[0, np.cumsum(sizes)])], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")
    return encoded.select(*names).mapInArrow(run, f"{fields}, decoded binary")
