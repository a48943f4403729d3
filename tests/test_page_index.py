"""Phrases looked up in stored postings against phrases joined with all words, and what is moved for it."""

import os
import random

from marginalia.operators import evidence as E
from marginalia.sources.page_index import PageIndex

WORDS = "paper string, slug string, page int, pos int, word string, x0 double, y0 double, x1 double, y1 double"
CLAIMS = "paper string, id int, source_slug string, source_page int, anchor_phrases array<string>"


def pages(seed, papers):
    rng, rows = random.Random(seed), []
    for p in papers:
        for page in (1, 2, 3):
            for pos in range(rng.choice([0, 1, 6, 25])):
                word = rng.choice(["the", "The", "cat", "sat", "on", None, "mat", "é"])
                rows.append((p, "s", page, pos * rng.choice([1, 1, 2]) + 1000 * pos, word, float(pos), 0.0, pos + 1.0, 10.0) if seed % 2 else (p, "s", page, pos, word, float(pos), 0.0, pos + 1.0, 10.0))
    return rows


def claims(spark, papers):
    phrases = [["the cat", "cat"], ["The the the", " sat  on ", ""], [], None, ["mat é cat sat", "nowhere", "the"]]
    return spark.createDataFrame([(p, k, "s", page, phrases[k % 5]) for p in papers for k, page in enumerate([1, 2, 3, 1, 2, 3, 9])], CLAIMS)


def rows(df):
    return sorted(map(str, df.collect()))


def test_as_all_words_joined(spark, tmp_path):
    for seed in (1, 2):
        papers = [f"p{k}" for k in range(12)]
        words = spark.createDataFrame(pages(seed, papers), WORDS)
        index = PageIndex(spark, f"{tmp_path}/index{seed}", buckets=4)
        index.append(words)
        wanted = rows(E.phrase_hits(claims(spark, papers), words))
        assert rows(E.indexed_hits(claims(spark, papers), index.table())) == wanted and wanted


def files(path):
    return {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-")}


def test_appending_rewrites_nothing(spark, tmp_path):
    one, two = ["a", "b", "c"], ["d", "e"]
    path = f"{tmp_path}/index"
    index = PageIndex(spark, path, buckets=3)
    index.append(spark.createDataFrame(pages(4, one), WORDS))
    before = files(path)
    words = spark.createDataFrame(pages(4, one) + pages(6, two), WORDS)
    index.append(words)  # the first pages again, which are left out
    after = files(path)
    assert before.items() <= after.items() and len(after) > len(before)
    assert rows(E.indexed_hits(claims(spark, one + two), index.table())) == rows(E.phrase_hits(claims(spark, one + two), words))
    index.append(words)
    assert sum(1 for _ in files(path)) == len(after) or index.table().count() == index.table().select("paper", "slug", "page", "word").distinct().count()


def test_another_session_finds_it(spark, tmp_path):
    path = f"{tmp_path}/index"
    index = PageIndex(spark, path, buckets=3)
    index.append(spark.createDataFrame(pages(4, ["a"]), WORDS))
    wanted = rows(index.table())
    spark.sql(f"DROP TABLE {index.name}")  # what a new session knows of it; the folder stays
    again = PageIndex(spark, path, buckets=7)
    assert again.buckets == 3 and rows(again.table()) == wanted


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = PageIndex(spark, f"{tmp_path}/index", buckets=4)
    index.append(spark.createDataFrame(pages(4, [f"p{k}" for k in range(30)]), WORDS))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.indexed_hits(claims(spark, ["p1"]), index.table())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    join = next(k for k, x in enumerate(lines) if "SortMergeJoin" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    scan = next(k for k, x in enumerate(lines) if "FileScan parquet" in x)
    above = [x for x in lines[join:scan] if depth(x) < depth(lines[scan])]
    branch = []
    for x in reversed(lines[join + 1 : scan]):
        if not branch or depth(x) < depth(branch[-1]):
            branch.append(x)
    assert above and "Bucketed: true" in lines[scan]
    assert not any("Exchange" in x for x in branch), plan


def test_empty(spark, tmp_path):
    index = PageIndex(spark, f"{tmp_path}/index", buckets=2)
    index.append(spark.createDataFrame([], WORDS))
    assert E.indexed_hits(claims(spark, ["a"]), index.table()).count() == 0
