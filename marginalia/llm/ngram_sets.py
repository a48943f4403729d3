"""Documents as sets of n-word shingles, and which of the sets can have a partner at all.

Tokens are 64-bit hashes of shingles; a set is named by a 64-bit hash of its
tokens (``node``), and by a second one (``node2``) where documents are told to
hold equal sets.  Null texts and texts without a word are empty sets; a text of
fewer than n words is one token, its whole sequence.  Repeated texts are equal
sets, sent once from each mapper.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .store import table
from .textops import Chunk, chunks, mix, ngrams, release

BUCKET = 1_000_000  #: sampled tokens that one task counts, about
FLUSH = 500_000  #: sampled tokens that a mapper sends at once
_U32 = np.uint64(32)


class Shape:
    """The numbers that follow from n and the threshold."""

    def __init__(self, n: int, percent: int):
        self.n, self.percent = n, percent
        # sizes are cut into bands; the lower end of each
        self.lower = np.array(sorted({int(np.ceil(1.5**k)) for k in range(60)}))
        self.differ = [self.spare(int(x) - 1) for x in self.lower[1:]]
        self.parts = [d + 3 + d // 16 for d in self.differ]
        #: share of tokens that step 1 looks at: nearly twice what a linked set can be without
        self.share = min(1.0, 1.75 * (100 - percent) / 100)

    def spare(self, size: int) -> int:
        """Tokens in which a set of this size and a linked set no smaller differ at most."""
        return size * (100 - self.percent) // self.percent

    def linked(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (both > 0) & (100 * both >= self.percent * (a + b - both))

    def signatures(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each part of a sorted set's tokens, in the bands where a linked set may be the smaller one.

        The lowest six bits say the band.  With each goes how many signatures
        of its band the set shares at least with any set linked to it there:
        one for each part, less those that may differ or be empty.
        """
        size = len(tokens)
        low = -(-size * self.percent // 100)
        run = np.r_[np.uint64(0), np.cumsum(mix(tokens))]
        out, need = [], []
        for band in sorted({int(np.searchsorted(self.lower, x, "right")) - 1 for x in (low, size)}):
            parts, differ = self.parts[band], self.differ[band]
            if differ < 1:
                continue  # only equal sets could link here
            count = np.bincount(((tokens >> np.uint64(40)).astype(np.int64) * parts) >> 24, minlength=parts)
            ends = np.cumsum(count)
            salt = mix(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 32))
            sig = (mix((run[ends] - run[ends - count]) ^ salt) & ~np.uint64(63)) | np.uint64(band)
            empty = int((count == 0).sum())
            least = parts - min(differ, self.spare(size)) - empty
            if least >= 1:
                sig = sig[count > 0]
            else:  # so many are empty that an agreement may be on empty parts alone, or on one that is not
                least = 1
            out.append(sig)
            need.append(np.full(len(sig), least, np.int32))
        return (np.concatenate(out), np.concatenate(need)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def shingle_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each text, end to end, and their n + 1 bounds."""
    starts, ends, first = chunk.words()
    words = chunk.word_hashes(starts, ends, lower=True)
    tokens, bounds = ngrams(words, first, n)
    own = np.repeat(np.arange(chunk.n), np.diff(bounds))
    count = np.diff(first)
    for k in range(1, n):  # too few words: the whole sequence
        short = np.flatnonzero(count == k)
        if len(short):
            at = np.arange(k) + first[short][:, None]
            whole, _ = ngrams(words[at.ravel()], np.arange(len(short) + 1) * k, k)
            tokens, own = np.r_[tokens, whole], np.r_[own, short]
    order = np.lexsort((tokens, own))
    tokens, own = tokens[order], own[order]
    if len(tokens):
        fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])]
        tokens, own = tokens[fresh], own[fresh]
    return tokens, np.searchsorted(own, np.arange(chunk.n + 1))


def set_hashes(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        run = np.r_[np.uint64(0), np.cumsum(mix(tokens ^ np.uint64(salt)))]
        out.append(mix(run[bounds[1:]] - run[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def pack(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of sorted tokens: enough to tell the tokens of one group apart."""
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(packed) -> list[np.ndarray]:
    out = []
    for x in packed:
        wide = np.zeros((len(x) // 6, 8), np.uint8)
        wide[:, 2:] = np.frombuffer(x, np.uint8).reshape(-1, 6)
        out.append(wide.view(np.uint64).ravel())
    return out


def _sampled(tokens: np.ndarray, share: float) -> np.ndarray:
    """Which tokens are in step 1's share; by bits that order neither parts nor buckets."""
    return (mix(tokens + np.uint64(0x5851F42D4C957F2D)) >> _U32) < np.uint64(int(share * (1 << 32)))


# -- step 1: tokens that one set alone holds ----------------------------------
#: Packed rows: tokens of a bucket, or, without ``tokens``, hits of a slot of sets.
SENT = "place int, tokens binary, nodes binary, runs binary, sizes binary, samples binary"
_NAMES = [x.split()[0] for x in SENT.split(", ")]


class Sender:
    """Collects tokens with their sets and sends them off packed by token bucket, FLUSH at a time.

    Of a token that three sets or more hold in one flush two go to its bucket;
    that the others share theirs is known here, and goes as hits to their slots.
    So a token however common is sent twice a flush at most.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets
        self._clear()

    def _clear(self) -> None:
        self.tokens, self.owns, self.sets, self.size, self.n = [], [], [], 0, 0

    def add(self, token: np.ndarray, own: np.ndarray, node: np.ndarray, size: np.ndarray, sample: np.ndarray) -> Iterator[list]:
        """Tokens with the number of the set each is of, in order; of the sets their node, size, and how many tokens are sent in all."""
        self.tokens.append(token)
        self.owns.append((own + self.n).astype(np.uint32))
        self.sets.append((node, size.astype(np.uint32), sample.astype(np.uint32)))
        self.size += len(token)
        self.n += len(node)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[list]:
        if not self.size:
            return
        token, own = np.concatenate(self.tokens), np.concatenate(self.owns)
        node, size, sample = (np.concatenate(x) for x in zip(*self.sets, strict=True))
        self._clear()
        order = np.argsort(token, kind="stable")
        third = order[2:][token[order[2:]] == token[order[:-2]]]
        del order
        yield from _hits(node, np.bincount(own[third], minlength=len(node)), size, sample, self.buckets)
        two = np.ones(len(token), bool)
        two[third] = False
        token, own = token[two], own[two]
        bucket = ((token >> _U32) * np.uint64(self.buckets)) >> _U32
        if self.buckets < 1 << 16:
            bucket = bucket.astype(np.uint16)  # sorted by its digits
        order = np.argsort(bucket, kind="stable")  # sets stay in order within a bucket
        token, own, bucket = token[order], own[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            run = np.flatnonzero(np.r_[True, own[s][1:] != own[s][:-1]])
            runs, mine = np.diff(np.r_[run, cuts[b + 1] - cuts[b]]), own[s][run]
            yield [int(b), *(x.tobytes() for x in (mix(token[s]).astype(np.uint32), node[mine], runs.astype(np.uint32), size[mine], sample[mine]))]


def _hits(nodes: np.ndarray, hits: np.ndarray, size: np.ndarray, sample: np.ndarray, slots: int) -> Iterator[list]:
    """Rows of SENT with the hits of each set that has some, packed by slot of sets."""
    some = np.flatnonzero(hits)
    slot = (mix(nodes[some].view(np.uint64)) % np.uint64(slots)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    some, cuts = some[order], np.searchsorted(slot[order], np.arange(slots + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        i = some[cuts[k] : cuts[k + 1]]
        yield [int(k), None, *(x.tobytes() for x in (nodes[i], hits[i].astype(np.uint32), size[i], sample[i]))]


def _whole(rows: pd.DataFrame, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows[name]), kind)


def with_partners(sent: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(node) of the sets of which few enough tokens are held by no other set; sent: a table of SENT.

    Two tokens that share their 32 bits within a bucket count as one, and an
    entry that two mappers have seen to be shared counts twice; either only
    ever keeps a set.
    """

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        """Each set's tokens that another set holds, within a bucket of tokens; sets packed by slot."""
        nodes, at, code = np.unique(_whole(rows, "nodes", np.int64), return_index=True, return_inverse=True)
        own = np.repeat(code.astype(np.uint32), _whole(rows, "runs", np.uint32))
        token = _whole(rows, "tokens", np.uint32)
        order = np.lexsort((own, token))
        token, own = token[order], own[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])][: len(token)]
        token, own = token[fresh], own[fresh]
        same = token[1:] == token[:-1]
        hits = np.bincount(own[np.r_[False, same] | np.r_[same, False]] if len(own) else own, minlength=len(nodes))
        sizes, samples = (_whole(rows, name, np.uint32)[at] for name in ("sizes", "samples"))
        out = pd.DataFrame(list(_hits(nodes, hits, sizes, samples, buckets)), columns=_NAMES)
        release()
        return out

    def live(rows: pd.DataFrame) -> pd.DataFrame:
        """The sets of a slot that leave no more tokens out than the threshold spares."""
        nodes, at, back = np.unique(_whole(rows, "nodes", np.int64), return_index=True, return_inverse=True)
        hits = np.bincount(back, _whole(rows, "runs", np.uint32), minlength=len(nodes))
        sizes, samples = (_whole(rows, name, np.uint32)[at].astype(np.int64) for name in ("sizes", "samples"))
        return pd.DataFrame({"node": nodes[(samples - hits) * 100 <= sizes * (100 - percent)]})

    counted = sent.where("tokens is not null").groupBy("place").applyInPandas(count, SENT)
    return counted.unionByName(sent.where("tokens is null and nodes is not null")).groupBy("place").applyInPandas(live, "node long")


def first_pass(docs: DataFrame, shape: Shape, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: (id, n_shingles, node, node2) of every document, and (node) of the sets that the sampled tokens leave in."""
    # tokens are counted by the bytes, six a word or so, as they only size the buckets
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = int(n_bytes / 6 * shape.share) // BUCKET + 1
    kinds = [f"id {docs.schema[id_col].dataType.simpleString()}", "n_shingles long", "node long", "node2 long"]
    names = ["id", "n_shingles", "node", "node2", *_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, seen = Sender(buckets), set()
        kind = None

        def sent(rows: list[list]) -> Iterator[pa.RecordBatch]:
            cols = list(zip(*rows, strict=True))
            packed = [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), kind), *(pa.nulls(len(rows), pa.int64()) for _ in range(3)), *packed], names)

        for batch in batches:
            kind = batch.column(0).type
            for at, chunk in chunks(batch.column(1)):
                tokens, bounds = shingle_sets(chunk, shape.n)
                one, two = set_hashes(tokens, bounds)
                told = [batch.column(0).slice(at, chunk.n), pa.array(np.diff(bounds)), pa.array(one), pa.array(two)]
                yield pa.RecordBatch.from_arrays([*told, pa.nulls(chunk.n, pa.int32()), *(pa.nulls(chunk.n, pa.binary()) for _ in _NAMES[1:])], names)
                fresh = np.zeros(chunk.n, bool)
                for i, x in enumerate(one.tolist()):  # equal sets once from each mapper
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                own = np.repeat(np.arange(chunk.n), np.diff(bounds))
                take = _sampled(tokens, shape.share)
                sample = np.bincount(own[take], minlength=chunk.n)
                take &= fresh[own]
                own = own[take]
                for row in sender.add(tokens[take], own, one, np.diff(bounds), sample):
                    yield from sent([row])
        for row in sender.flush():
            yield from sent([row])
        release()

    rows = table(docs.select(id_col, text_col).mapInArrow(run, ", ".join([*kinds, SENT])), "first-pass")
    nodes = rows.where("n_shingles is not null").select(F.col("id").alias(id_col), "n_shingles", "node", "node2")
    return nodes, with_partners(rows.select(*_NAMES), buckets, shape.percent)


def still_live(sets: DataFrame, shape: Shape) -> DataFrame:
    """Step 1 again, on all tokens of the sets left in: their partners are among themselves."""
    buckets = int(sets.agg(F.sum("size")).first()[0] or 0) // BUCKET + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets)
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, len(_NAMES)))], _NAMES)
        for batch in batches:
            for node, tokens in zip(batch.column(0).to_pylist(), unpacked(batch.column(1).to_pylist()), strict=True):
                n = np.array([len(tokens)])
                for row in sender.add(tokens, np.zeros(len(tokens), np.int64), np.array([node]), n, n):
                    yield out([row])
        for row in sender.flush():
            yield out([row])
        release()

    return with_partners(table(sets.select("node", "tokens").mapInArrow(send, SENT), "sent"), buckets, shape.percent)


def token_sets(docs: DataFrame, shape: Shape, live: Bloom, text_col: str = "text") -> DataFrame:
    """(node, size, tokens) of the sets left in; a set may come from several mappers."""
    sent = docs.sparkSession.sparkContext.broadcast(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, chunk in chunks(batch.column(0)):
                tokens, bounds = shingle_sets(chunk, shape.n)
                node, _ = set_hashes(tokens, bounds)
                size = np.diff(bounds)
                own = np.repeat(np.arange(chunk.n), size)
                sample = np.bincount(own[_sampled(tokens, shape.share)], minlength=chunk.n)
                # a set that may differ from a linked one at all, and that step 1 has not ruled out
                keep = size * (100 - shape.percent) >= shape.percent
                keep &= (100 * sample <= size * (100 - shape.percent)) | sent.value.holds(node)
                rows = []
                for i in np.flatnonzero(keep):
                    if (x := int(node[i])) not in seen:
                        seen.add(x)
                        rows.append((x, int(size[i]), pack(tokens[bounds[i] : bounds[i + 1]])))
                if len(seen) > 1_000_000:
                    seen.clear()
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["node", "size", "tokens"])
        release()

    return docs.select(text_col).mapInArrow(run, "node long, size long, tokens binary")


def signed(sets: DataFrame, shape: Shape, live: Bloom) -> DataFrame:
    """The sets still left in, with their ``signatures`` and what each set must share of them."""
    sent = sets.sparkSession.sparkContext.broadcast(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sent.value.holds(batch.column(0).to_numpy())))
            found = [shape.signatures(x) for x in unpacked(batch.column(2).to_pylist())]
            bounds = pa.array(np.r_[0, np.cumsum([len(x) for x, _ in found], dtype=np.int64)], pa.int32())
            sig, need = (np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in (0, 1))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(sig.astype(np.uint64).view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(need.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], ["node", "size", "tokens", "signatures", "needs"])

    return sets.mapInArrow(run, "node long, size long, tokens binary, signatures array<long>, needs array<int>")
