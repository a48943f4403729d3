"""Rows of many matches: running values as plain ones, and growth in the length of a text."""

import itertools
import random
import time

from pyspark.sql import functions as F

from marginalia.llm import chat_format, folds, secret_scan, sharding


def test_running_values(spark):
    rng = random.Random(1)
    given = [(k, [rng.randrange(100) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3, 4, 5, 9, 10, 17, 100, 1000])]
    rows = spark.createDataFrame(given, "k int, v array<int>")
    found = rows.select("v", folds.running_sum(F.col("v")), folds.running_max(F.col("v")), folds.following_min(F.col("v")), folds.bound(F.col("v"), lambda v: F.flatten(folds.runs(v)))).collect()
    for v, total, most, least, again in found:
        assert total == list(itertools.accumulate(v, initial=0))[: len(v)]
        assert most == list(itertools.accumulate(v, max, initial=0))[: len(v)]
        assert least == [min(v[k + 1 :], default=2**31 - 1) for k in range(len(v))]
        assert (again or []) == v


def secrets(n, seed=0):
    rng = random.Random(seed)
    return "\n".join(f"{rng.getrandbits(96):024x} user=alice{k} pwd: hunter{k}" if k % 8 == 0 else f"{rng.getrandbits(96):024x}" for k in range(n))


def test_texts_of_many_secrets_are_not_quadratic(spark):
    def took(what, n):
        docs = spark.createDataFrame([(1, secrets(n))], "doc_id long, text string")
        began = time.perf_counter()
        what(docs).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for what in (secret_scan.scan, secret_scan.redact):
        took(what, 2000)
        once = max(1.0, took(what, 20_000))
        assert took(what, 40_000) < 3 * once


def test_many_secrets_are_all_masked(spark):
    docs = spark.createDataFrame([(1, secrets(3000) + " tail é")], "doc_id long, text string")
    masked = secret_scan.redact(docs).first().text
    assert masked.count(secret_scan.MASK) == 3000 + 2 * 375 and masked.endswith(" tail é") and "hunter" not in masked
    assert masked == "\n".join(" ".join([secret_scan.MASK] * (3 if k % 8 == 0 else 1)) for k in range(3000)) + " tail é"


def test_loss_mask_of_many_turns(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(400)]
    row = chat_format.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()
    assert [row.formatted[m.start : m.end] for m in row.loss_mask] == [f"turn {k}" for k in range(1, 400, 2)]


def test_a_lone_run_of_small_files_is_merged(spark, tmp_path):
    store = sharding.ShardStore(spark, f"{tmp_path}/shards")
    rows = spark.range(0, 500, 1, 20).withColumn("text", F.lit("word"))
    store.append(rows)
    assert store.manifest().first().files == 20
    store.compact()
    assert [r.files for r in store.manifest().collect()] == [1] and store.read().count() == 500
    version = store.version()
    assert store.compact() == version
