"""Cross-tokenizer alignment by segments that are tokenised and aligned once.

A text is cut before white space where neither vocabulary can merge across
(``Cutter``).  Texts are taken in blocks of some megabytes: a block keeps its
distinct segments and, for each text, their numbers.  Segments are dealt out by
their hash, many in a row; where equal ones of all blocks meet they are
tokenised by both tokenizers and aligned, once each, and go back to their blocks.
A block then counts in how many of its texts it has each id pair; the pairs'
totals come back to the block, which composes its texts.

A block holds each of its segments and pairs once, so however common one is,
its rows grow with the blocks, not with the occurrences; and beyond SHARE
blocks a segment is aligned once for each SHARE of them, so that no task meets
more.  A text is never split among blocks; one longer than a block
is a block by itself.

Null and empty texts, and those that either tokenizer doesn't give back byte by
byte, have no tokens, and their pairs aren't counted.  Repeated rows get equal
results and count each.  An empty table gives an empty result; only the id and
the text are read.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import table, temporary, tidy
from .textops import chunks, release

#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Segments tokenised at once.
BATCH = 4096
#: Segments of texts whose pairs are counted at once; a text of more is counted alone.
COUNTED = 50_000
#: Segments of blocks that a task aligns in one go, and blocks that may share a segment's alignment.
DEALT, SHARE = 100_000, 200_000
_SPACE = "▁"


@lru_cache(maxsize=2)
def _byte_level(path: str):
    """A byte-level tokenizer of the tokenizers library, and the bytes of each of its entries."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    # printable bytes stand for themselves, the others for the code points from 256 on, in order
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return tok, {k: bytes(back[c] for c in entry) for entry, k in tok.get_vocab(with_added_tokens=False).items()}


@lru_cache(maxsize=2)
def _pieces(path: str):
    """A sentencepiece model, and the bytes of each of its pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return model, [bytes([int(x[3:5], 16)]) if model.is_byte(k) else x.replace(_SPACE, " ").encode() for k, x in enumerate(names)]


class Cutter:
    """Where texts may be cut: before a space after which no merge can reach back.

    ``crossed`` are endings of the character before a space within an entry of
    either vocabulary; after a character with such an ending a text stays whole.
    Byte-level tokenizers also look for white space by a pattern, which always
    starts anew at the first white space after another character, so the
    character before the cut must not be white space in any reading: only
    letters, marks, digits, punctuation and symbols count.
    """

    def __init__(self, entries: list[bytes]):
        self.crossed = set()
        for entry in entries:
            at = entry.find(b" ", 1)
            while at > 0:
                if entry[at - 1] != 0x20:
                    start = at - 1
                    while start and entry[start] & 0xC0 == 0x80:
                        start -= 1
                    self.crossed.add(entry[start:at])
                at = entry.find(b" ", at + 1)
        self._wide: dict[int, bool] = {}
        self._ascii = np.array([b > 0x20 and b != 0x7F and b < 0x80 and bytes([b]) not in self.crossed for b in range(256)])

    def _safe(self, code: int) -> bool:
        """Whether a text may be cut after a character beyond ASCII, given by its bytes as one number."""
        if code not in self._wide:
            raw = code.to_bytes(4, "big").lstrip(b"\0")
            char = raw.decode("utf-8", "replace")
            self._wide[code] = unicodedata.category(char[-1])[0] in "LMNPS" and not any(raw.endswith(x) for x in self.crossed)
        return self._wide[code]

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions of the spaces before which UTF-8 data may be cut."""
        at = np.flatnonzero(data[1:] == 0x20) + 1
        before = data[at - 1]
        safe = self._ascii[before]
        wide = np.flatnonzero(before >= 0x80)
        if len(wide):
            end = at[wide]
            code, more = np.zeros(len(end), np.int64), np.ones(len(end), bool)
            for k in range(4):  # bytes of the character, from its last
                byte = data[np.maximum(end - 1 - k, 0)].astype(np.int64)
                code += np.where(more, byte << (8 * k), 0)
                more &= (byte & 0xC0) == 0x80
            kinds, which = np.unique(code, return_inverse=True)
            safe[wide] = np.array([self._safe(int(x)) for x in kinds], bool)[which]
        return at[safe]


@lru_cache(maxsize=2)
def cutter(a_path: str, b_path: str) -> Cutter:
    return Cutter([*_byte_level(a_path)[1].values(), *_pieces(b_path)[1]])


def pack(values: np.ndarray) -> bytes:
    """Numbers in little space: first all their lowest bytes, then all the next ones, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(packed: bytes, dtype: str) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    planes = pa.decompress(packed[8:], size, "zstd", asbytes=True) if size else b""
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def _reordered(values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs of ``values`` of given sizes in another order."""
    n = sizes[order].astype(np.int64)
    begin = np.cumsum(sizes, dtype=np.int64) - sizes
    return values[np.repeat(begin[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _blocks(a_path: str, b_path: str, id_type: pa.DataType):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), *((c, pa.binary()) for c in ("first", "which", "texts", "sizes")), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(a_path, b_path)
        for batch in batches:
            for at, chunk in chunks(batch.column(1), BLOCK_BYTES):
                inner, edge = cut.cuts(chunk.data), np.zeros(len(chunk.data) + 1, bool)
                edge[chunk.offsets] = True
                edge[inner[~edge[inner + 1]]] = True  # a last space alone would be an empty text to the pieces
                starts = np.flatnonzero(edge[:-1])
                coded = strings(chunk.data, np.r_[starts, len(chunk.data)]).dictionary_encode()
                which, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
                # frequent segments get small numbers
                order = np.argsort(-np.bincount(which, minlength=n), kind="stable")
                place = np.empty(n, np.int32)
                place[order] = np.arange(n, dtype=np.int32)
                data, offsets = laid(coded.dictionary)
                sizes = np.diff(offsets).astype("<u4")
                packed = [np.searchsorted(starts, chunk.offsets).astype("<i4"), place[which], _reordered(data, sizes, order), sizes[order]]
                ids = batch.column(0).slice(at, chunk.n)
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), ids, *(pa.array([pack(x)], pa.binary()) for x in packed), pa.array([n])], schema=schema)
        release()

    return run


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def laid(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings end to end, and where each begins and the last ends."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


A_ENDS, B_ENDS, LAST = 1, 2, 4  #: moves, one for each link: which of its tokens ends with it, and whether it ends its segment


def id_type(a_path: str, b_path: str) -> str:
    """The narrowest numpy type that holds the ids of both vocabularies."""
    most = max(_byte_level(a_path)[0].get_vocab_size(), _pieces(b_path)[0].get_piece_size())
    return "<u2" if most <= 1 << 16 else "<u4"


def _dealt(buckets: int, shares: int):
    """Segments of blocks by buckets of their hash, a row for each bucket and block."""
    schema = pa.schema([("bucket", pa.int64()), ("owner", pa.int64()), *((c, pa.binary()) for c in ("steps", "texts", "sizes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, texts, sizes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data, sizes, bucket = unpack(texts, "u1"), unpack(sizes, "<u4"), []
                if not len(sizes):
                    continue
                for _, chunk in chunks(strings(data, np.r_[0, np.cumsum(sizes, dtype=np.int64)])):
                    bucket.append(chunk.word_hashes(chunk.offsets[:-1], chunk.offsets[1:], lower=False) % np.uint64(buckets))
                bucket = np.concatenate(bucket).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                kinds, first = np.unique(bucket[order], return_index=True)
                data, sizes = _reordered(data, sizes, order), sizes[order]
                bytes_at, bounds, rows = np.r_[0, np.cumsum(sizes, dtype=np.int64)], [*first.tolist(), len(order)], []
                for i, j in zip(bounds, bounds[1:], strict=False):
                    rows.append((pack(np.diff(order[i:j], prepend=0).astype("<u4")), pack(data[bytes_at[i] : bytes_at[j]]), pack(sizes[i:j])))
                yield pa.RecordBatch.from_arrays([pa.array(kinds * shares + owner % shares), pa.array(np.full(len(kinds), owner)), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], schema=schema)
        release()

    return run


class Aligner:
    """Segments tokenised by both tokenizers and aligned, many at once."""

    def __init__(self, a_path: str, b_path: str, dtype: str):
        self.dtype = dtype
        (self.tok, a_bytes), (self.model, b_bytes) = _byte_level(a_path), _pieces(b_path)
        self.cutter = cutter(a_path, b_path)
        self.a_bytes = [a_bytes.get(k, b"") for k in range(max(a_bytes) + 1)]
        self.b_bytes = b_bytes
        self.a_size, self.b_size = (np.array([len(x) for x in of]) for of in (self.a_bytes, self.b_bytes))

    def align(self, segments: list[str]) -> list[tuple[bytes, bytes, bytes] | None]:
        """(A ids, B ids, moves) of each segment; None where its tokens don't give it back."""
        if not segments:
            return []
        raw = [x.encode() for x in segments]
        # segments that may be cut apart may be tokenised as one text
        bounds, apart = np.cumsum([len(x) for x in raw]), np.zeros(sum(map(len, raw)) + 1, bool)
        apart[self.cutter.cuts(np.frombuffer(b"".join(raw), np.uint8))] = True
        at = [0, *(np.flatnonzero(~apart[bounds[:-1]]) + 1).tolist(), len(raw)]
        return [x for i, j in zip(at, at[1:], strict=False) for x in self._together(raw[i:j])]

    def _together(self, raw: list[bytes]) -> list[tuple[bytes, bytes, bytes] | None]:
        found = self._joined(b"".join(raw), np.cumsum([len(x) for x in raw]))
        if found or len(raw) == 1:
            return found or [None]
        half = len(raw) // 2
        return self._together(raw[:half]) + self._together(raw[half:])

    def _joined(self, whole: bytes, bounds: np.ndarray) -> list[tuple[bytes, bytes, bytes]] | None:
        text = whole.decode()
        a = self.tok.encode(text, add_special_tokens=False).ids
        b = self.model.encode(text[1:])  # which adds the space again
        if b"".join([self.a_bytes[k] for k in a]) != whole or b"".join([self.b_bytes[k] for k in b]) != whole:
            return None
        a, b = np.array(a), np.array(b)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        marks = np.zeros(len(whole) + 1, np.uint8)
        marks[a_ends] = A_ENDS
        marks[b_ends] |= B_ENDS
        if (marks[bounds] != A_ENDS | B_ENDS).any():
            return None
        # each stretch between two ends of either kind is one pair of tokens that share bytes
        marks[bounds] |= LAST
        ends = np.flatnonzero(marks)
        moves = marks[ends].tobytes()
        a, b, w = a.astype(self.dtype).tobytes(), b.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        at = [np.r_[0, np.searchsorted(of, bounds) + 1].tolist() for of in (a_ends, b_ends, ends)]
        return [(a[w * i : w * i2], b[w * j : w * j2], moves[k:k2]) for i, i2, j, j2, k, k2 in zip(at[0], at[0][1:], at[1], at[1][1:], at[2], at[2][1:], strict=False)]


_LOST = (b"", b"", bytes([LAST]))  #: no token, and a move without a link


def _aligned(a_path: str, b_path: str, dtype: str):
    schema = pa.schema([("owner", pa.int64()), *((c, pa.binary()) for c in ("steps", "a", "b", "moves"))])

    def run(rows: pa.Table) -> pa.Table:
        own = Aligner(a_path, b_path, dtype)
        data = np.concatenate([unpack(x, "u1") for x in rows.column("texts").to_pylist()])
        sizes = [unpack(x, "<u4") for x in rows.column("sizes").to_pylist()]
        coded = strings(data, np.r_[0, np.cumsum(np.concatenate(sizes), dtype=np.int64)]).dictionary_encode()
        texts, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        found = [x or _LOST for at in range(0, len(texts), BATCH) for x in own.align(texts[at : at + BATCH])]
        bounds, out = np.r_[0, np.cumsum(list(map(len, sizes)))].tolist(), []
        for i, j in zip(bounds, bounds[1:], strict=False):
            each = [found[k] for k in which[i:j].tolist()]
            out.append([pack(np.frombuffer(b"".join([x[k] for x in each]), kind)) for k, kind in enumerate((dtype, dtype, "u1"))])
        release()
        return pa.table([rows.column("owner"), rows.column("steps"), *(pa.array([r[k] for r in out], pa.binary()) for k in range(3))], schema=schema)

    return run


def _all(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.concatenate([unpack(x, dtype) for x in column.to_pylist()] or [np.zeros(0, dtype)])


class _Block:
    """A block's texts as numbers of segments, and its segments' alignments end to end in that numbering.

    ``row`` is as ``_blocks`` made it or, with ``segments`` None, as ``_counted`` did.
    """

    def __init__(self, row: pa.Table, segments: pa.Table | None, dtype: str):
        get = lambda name, kind: unpack(row.column(name)[0].as_py(), kind)
        self.ids = row.column("ids").combine_chunks().flatten()
        self.first, self.which = get("first", "<i4"), get("which", "<i4")
        self.n = len(self.first) - 1
        self.text = np.repeat(np.arange(self.n), np.diff(self.first))
        source = {c: get(c, kind) if segments is None else _all(segments.column(c), kind) for c, kind in (("a", dtype), ("b", dtype), ("moves", "u1"))}
        moves = source["moves"]
        ends = np.flatnonzero(moves & LAST) + 1
        count = lambda bit: np.diff(np.r_[0, np.cumsum(moves & bit > 0)][ends], prepend=0)
        self.sizes = [count(A_ENDS), count(B_ENDS), np.diff(ends, prepend=0)]
        if segments is not None:
            numbers = [np.cumsum(unpack(x, "<u4"), dtype=np.int64) for x in segments.column("steps").to_pylist()]
            order = np.argsort(np.concatenate(numbers or [np.zeros(0, np.int64)]))
            source = {c: _reordered(source[c], n, order) for c, n in zip(source, self.sizes, strict=True)}
            self.sizes = [n[order] for n in self.sizes]
        self.a, self.b, self.moves = source.values()
        # what isn't given back has no token at all, and a segment is never empty
        self.lost = np.bincount(self.text, (self.sizes[0] == 0)[self.which], self.n) > 0 if len(self.which) else np.zeros(self.n, bool)
        self.links = np.zeros(0, np.int64)
        shared = self.moves & (A_ENDS | B_ENDS) > 0  # not those of lost segments
        self.sizes[2] = np.where(self.sizes[0] > 0, self.sizes[2], 0)
        self.moves = self.moves[shared] if not shared.all() else self.moves
        a_ends, b_ends = self.moves & A_ENDS > 0, self.moves & B_ENDS > 0
        if len(self.moves):
            self.links = self.a.astype(np.int64)[np.cumsum(a_ends) - a_ends] << 32 | self.b[np.cumsum(b_ends) - b_ends]
        self.both = a_ends & b_ends
        self.begin = np.r_[0, np.cumsum(self.sizes[2])]

    def marked(self) -> np.ndarray:
        """The moves as they were made, a lost segment as one move without a link."""
        empty = np.flatnonzero(self.sizes[2] == 0)
        return np.insert(self.moves, self.begin[empty], LAST) if len(empty) else self.moves

    def per_segment(self, of_links: np.ndarray) -> np.ndarray:
        run = np.r_[0, np.cumsum(of_links)]
        return run[self.begin[1:]] - run[self.begin[:-1]]

    def per_text(self, of_segments: np.ndarray) -> np.ndarray:
        """Sum of a value of each segment over each text; 0 for texts without tokens."""
        run = np.r_[0, np.cumsum(of_segments[self.which].astype(np.int64))]
        return np.where(self.lost, 0, run[self.first[1:]] - run[self.first[:-1]])

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, and how many texts hold each."""
        pairs, number = np.unique(self.links, return_inverse=True)
        count, at = np.zeros(len(pairs), np.int64), 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(self.first, self.first[at] + COUNTED, side="right")) - 1)
            span = slice(self.first[at], self.first[to])
            good = ~self.lost[self.text[span]]
            once = np.unique(self.text[span][good] * len(self.sizes[2]) + self.which[span][good])  # each segment once a text
            text, segment = once // len(self.sizes[2]), once % len(self.sizes[2])
            n = self.sizes[2][segment]
            link = np.repeat(self.begin[segment] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            held = np.unique(np.repeat(text, n) * max(1, len(pairs)) + number[link])
            count += np.bincount(held % max(1, len(pairs)), minlength=len(pairs))
            at = to
        return pairs[count > 0], count[count > 0]

    def groups(self) -> list[str]:
        """The groups of each segment as text."""
        both = np.flatnonzero(self.both)
        a_at = np.r_[0, np.cumsum(self.moves & A_ENDS > 0)[both]].tolist()
        b_at = np.r_[0, np.cumsum(self.moves & B_ENDS > 0)[both]].tolist()
        names = list(map(str, range(max(self.a.max(initial=0), self.b.max(initial=0)) + 1)))
        a, b = ([names[k] for k in x.tolist()] for x in (self.a, self.b))
        each = [",".join(a[i:i2]) + "|" + ",".join(b[j:j2]) for i, i2, j, j2 in zip(a_at, a_at[1:], b_at, b_at[1:], strict=False)]
        ends = np.searchsorted(both, self.begin).tolist()
        return [";".join(each[k:k2]) for k, k2 in zip(ends, ends[1:], strict=False)]


def _counted(id_type: pa.DataType, dtype: str):
    fields = [("block", pa.int64()), ("ids", pa.list_(id_type)), *((c, pa.binary()) for c in ("first", "which", "a", "b", "moves")), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(block: pa.Table, segments: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        own = _Block(block, segments, dtype)
        pairs, counts = own.pair_counts()
        packed = [pack(own.a), pack(own.b), pack(own.marked())]
        release()
        return pa.table([*(block.column(c) for c in ("block", "ids", "first", "which")), *([x] for x in packed), [pairs], [counts]], schema=schema)

    return run


def _composed(id_field: pa.Field, dtype: str):
    schema = pa.schema([id_field, *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups", pa.string())])

    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        own = _Block(block, None, dtype)
        # pairs that only texts without tokens hold were not counted
        total, best = np.zeros(len(own.links), np.int64), np.zeros(len(own.links), np.int64)
        if counts.num_rows:
            counts = counts.sort_by("pair")
            known = counts.column("pair").to_numpy()
            at = np.minimum(np.searchsorted(known, own.links), len(known) - 1)
            hit = known[at] == own.links
            total, best = (np.where(hit, counts.column(c).to_numpy()[at], 0) for c in ("n", "best"))
        of_segments = [own.sizes[0], own.sizes[1], own.per_segment(own.both), own.sizes[2], own.per_segment(best), own.per_segment(total)]
        shown, first = own.groups(), own.first.tolist()
        texts = ["" if own.lost[k] else ";".join([shown[x] for x in own.which[first[k] : first[k + 1]].tolist()]) for k in range(own.n)]
        out = pa.table([own.ids, *(pa.array(own.per_text(x)) for x in of_segments), pa.array(texts, pa.string())], schema=schema)
        del own, shown, texts
        release()
        return out

    return run


@contextmanager
def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> Iterator[DataFrame]:
    """Id, ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups`` of each document.

    Text A is a space and the text, by the byte-level tokenizer at ``a_path``;
    B the text by the pieces at ``b_path``, which add that space.  ``groups``:
    ``a1,a2|b1;a3|b2,b3``, cut wherever tokens of both end.  Links are pairs of
    an A and a B token that share a byte; a pair's count is the number of
    documents that hold it.  ``n_best``: links of the highest count of their A
    id; ``count_sum``: counts added over links.

    The rows are worked out when they are read, which has to be inside the block:
    what they come from goes at its end.
    """
    kind, arrow_id = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    dtype = id_type(a_path, b_path)
    with temporary(docs.sparkSession), tidy(docs.sparkSession):
        whole = docs.select(F.col(id_col), F.when(F.length(text_col) > 0, F.concat(F.lit(" "), F.col(text_col))).alias("text"))
        numbers = f"block long, ids array<{kind}>, first binary, which binary"
        with temporary(docs.sparkSession):  # the blocks go once they are counted
            blocks = table(whole.mapInArrow(_blocks(a_path, b_path, arrow_id), f"{numbers}, texts binary, sizes binary, n long"), "align-blocks")
            held, n = blocks.agg(F.sum("n"), F.count("*")).first()
            deal = _dealt(-(-(held or 1) // DEALT), -(-(n or 1) // SHARE))
            dealt = blocks.select("block", "texts", "sizes").mapInArrow(deal, "bucket long, owner long, steps binary, texts binary, sizes binary")
            tokens = "a binary, b binary, moves binary"
            segments = dealt.groupBy("bucket").applyInArrow(_aligned(a_path, b_path, dtype), f"owner long, steps binary, {tokens}")
            met = blocks.drop("texts", "sizes", "n").groupBy("block").cogroup(segments.groupBy("owner"))
            counted = table(met.applyInArrow(_counted(arrow_id, dtype), f"{numbers}, {tokens}, pairs array<long>, counts array<long>"), "align-counted", keep=True)
        pairs = counted.select(F.col("block").alias("owner"), F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("owner", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("own"))
        totals = table(pairs.groupBy("pair").agg(F.sum("own").alias("n")).withColumn("a", F.shiftright("pair", 32)), "align-pairs")
        best = totals.groupBy("a").agg(F.max("n").alias("most"))
        totals = totals.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
        totals = pairs.select("owner", "pair").join(totals, "pair").groupBy("owner")
        out = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
        rows = counted.drop("pairs", "counts").groupBy("block").cogroup(totals).applyInArrow(_composed(pa.field(id_col, arrow_id), dtype), out)
        yield rows


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``aligned`` as a table that stays."""
    with aligned(docs, a_path, b_path, id_col, text_col) as rows:
        return table(rows, "alignments", keep=True)
