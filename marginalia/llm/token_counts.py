"""Token counts through a digest cache.

The cache is a Parquet folder of (tokenizer, digest, n_tokens): ``tokenizer``
is the digest of the model file, ``digest`` that of the normalised content.
The documents' digests are joined to it; only the texts of the misses are then
dealt out, each distinct one is encoded once, and the new counts are appended.
A repeated call encodes nothing.

Normalisation turns a null text into the empty text and no more: anything
further could change what the tokenizer counts.  Repeated rows keep one result
each; an empty table gives an empty result and appends nothing of note.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom
from .store import table, temporary
from .textops import chunks

CACHE = "tokenizer binary, digest binary, n_tokens long"
#: Digests a mapper remembers to send a content only once; beyond it, it starts anew.
SEEN = 200_000


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def tokenizer_digest(path: str) -> bytes:
    """Version of a tokenizer: the digest of its file, as the driver has it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def read_cache(spark: SparkSession, cache: str, tokenizer: bytes) -> DataFrame | None:
    """Stored counts of one tokenizer, one row a digest; None where nothing is stored yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # two appends that ran at once may both hold a digest, with the same count
    return rows.where(F.col("tokenizer") == F.lit(tokenizer)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _head(digests: pa.Array) -> np.ndarray:
    """The first sixty bits of each digest, as a number."""
    return (np.frombuffer(b"".join(x[:8] for x in digests.to_pylist()), ">u8") >> 4).astype(np.int64)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        take = []
        for i, digest in enumerate(batch.column(0).to_pylist()):
            if digest not in seen:
                seen.add(digest)
                take.append(i)
        if len(seen) > SEEN:
            seen.clear()
        yield batch.take(pa.array(take, pa.int64()))


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of each distinct content; misses: digest, text, dealt out by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in _first_of_each(batches):
            for at, chunk in chunks(batch.column(1)):
                texts = batch.column(1).slice(at, chunk.n).to_pylist()
                counts = [len(x) for x in model.encode(texts, num_threads=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, chunk.n), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _keyed(docs: DataFrame, text_col: str, *others: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*others, text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def fill(docs: DataFrame, digests: DataFrame, path: str, cache: str, text_col: str = "text") -> None:
    """Append the counts of those contents of ``docs`` that the cache has not; digests: (digest) of all of them."""
    spark, version = docs.sparkSession, tokenizer_digest(path)
    with temporary(spark):
        known, wanted = read_cache(spark, cache, version), digests.select("digest").distinct()
        misses = table(wanted if known is None else wanted.join(known, "digest", "left_anti"), "misses")
        live = spark.sparkContext.broadcast(Bloom(misses.select(F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long").alias("node"))))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Contents that may be misses, once from each mapper, so that a hot content stays small."""
            yield from _first_of_each(b.filter(pa.array(live.value.holds(_head(b.column(0))))) for b in batches)

        sent = _keyed(docs, text_col).select("digest", "text").mapInArrow(send, "digest binary, text string")
        found = encode_misses(sent.hint("merge").join(misses, "digest", "left_semi"), path)
        found.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_bytes`` and ``n_tokens`` of every whole text; path: a sentencepiece model that workers can read."""
    spark, version = docs.sparkSession, tokenizer_digest(path)
    rows = _keyed(docs, text_col, id_col).select(id_col, "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    rows = table(rows, "digests")
    fill(docs, rows, path, cache, text_col)
    # written anew, one row a digest, so that the join below can split a hot content's rows among tasks
    counts = table(read_cache(spark, cache, version), "counts")
    return rows.join(counts, "digest").select(id_col, "n_bytes", "n_tokens")
