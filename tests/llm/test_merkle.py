"""The manifest against hashlib, one tree after the other."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle, registry
from marginalia.llm.store import read

LOWER = {k: k + 32 for k in range(65, 91)}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """nodes: (digest, proof so far, digest of the tampered); the last node, and those proofs up to it."""
    own = [[d, [], t] for d, t in nodes]
    groups = [[k] for k in range(len(own))]
    digests = [d for d, _ in nodes]
    while len(digests) > 1:
        up, joined = [], []
        for at in range(0, len(digests), 8):
            run = digests[at : at + 8]
            for k in range(len(run)):
                for member in groups[at + k]:
                    own[member][1] += run[:k] + run[k + 1 :]
                    own[member][2] = h(*run[:k], own[member][2], *run[k + 1 :])
            up.append(h(*run))
            joined.append([m for g in groups[at : at + 8] for m in g])
        digests, groups = up, joined
    return digests[0], own


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    tops, found = [], []
    for lang in sorted(trees, key=lambda x: (x is not None, (x or "").encode())):
        members = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])), k) for k, r in enumerate(trees[lang]))
        members = [trees[lang][k] for _, k in members]
        hit = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 for r in members]
        tampered = [leaf(r, r["text"].translate(LOWER) if x and r["text"] is not None else r["text"]) for r, x in zip(members, hit, strict=True)]
        top, own = climb([(leaf(r, r["text"]), t) for r, t in zip(members, tampered, strict=True)])
        tops.append(top)
        found.append((members, own))
    # the trees' last nodes climb on, each with its tree's leaves under it
    root, last = climb([(t, t) for t in tops])
    out = []
    for (members, own), top, (_, above, _) in zip(found, tops, last, strict=True):
        steps, digests, at = [], tops, tops.index(top)
        while len(digests) > 1:
            run = digests[at // 8 * 8 : at // 8 * 8 + 8]
            steps.append((run[: at % 8], run[at % 8 + 1 :]))
            digests, at = [h(*digests[k : k + 8]) for k in range(0, len(digests), 8)], at // 8
        for r, (d, proof, t) in zip(members, own, strict=True):
            for before, after in steps:
                t = h(*before, t, *after)
            out.append((r["doc_id"], d, top, root, h(*proof, *above), t, t == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows.collect()), key=repr)


def of(spark, tmp_path, rows):
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    return found(registry.op11_merkle(spark, str(tmp_path)))


def test_op11(spark, small):
    rows = [r.asDict() for r in read(spark, small, "documents").collect()]
    assert found(registry.op11_merkle(spark, small)) == brute(rows)


def test_odd(spark, odd_documents, tmp_path):
    rows = [r.asDict() for r in odd_documents.collect()]
    assert of(spark, tmp_path, odd_documents) == brute(rows)


@pytest.mark.parametrize("sizes", [[1], [8], [9], [64, 1], [65, 1, 3], [1] * 9, [2, 70] + [1] * 70])
def test_shapes(spark, tmp_path, sizes):
    rows = [(1000 * g + k, f"Text {k}" if k % 5 else None, None if g == 1 else f"l{g}é", "s", k) for g, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert of(spark, tmp_path, docs) == brute([r.asDict() for r in docs.collect()])


def test_repeated_rows_and_keys(spark, tmp_path):
    rows = [(7, "Same", "en", "s", 4)] * 40 + [(7, f"Other {k}", "en", None, None) for k in range(20)] + [(None, None, "en", None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert of(spark, tmp_path, docs) == brute([r.asDict() for r in docs.collect()])


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert of(spark, tmp_path, docs) == []


def test_a_tree_is_dealt_to_ranges(spark):
    """Rows of one tree are numbered without a gap though several tasks hold them, and no window has the tree alone."""
    rows = spark.range(0, 4000, 1, 8).select(F.lit("t").alias("tree"), (F.col("id") * 7919 % 4000).alias("key"))
    out = merkle.numbered(rows, ["key"])
    assert out.where("idx <> key or n <> 4000").count() == 0 and out.count() == 4000
    assert out.select("tree").distinct().count() == 1


def test_another_fanout(spark, small):
    docs = read(spark, small, "documents")
    manifest = merkle.build(docs, [F.col("text")], F.lit(None).cast("string"), F.col("doc_id"), F.col("doc_id"), fanout=3)
    rows = manifest.proofs().withColumn("again", merkle.folded(F.col("leaf"), F.col("path")))
    assert rows.count() == docs.count() and rows.where(F.col("again") != manifest.root).count() == 0
