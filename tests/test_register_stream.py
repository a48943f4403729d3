"""Any cut of the hits into batches gives the registers of all of them; so does a restart."""

import random

import pytest

from marginalia.operators import scout
from marginalia.streaming import registers as G

FOUND = "paper string, ord int, via string, title string, year int, doi string, journal string, authors string"
COLUMNS = ["paper", "rank", "ord", "via", "title", "year", "doi", "journal", "authors"]


def hits(seed):
    rng, rows = random.Random(seed), []
    for p in ("p", "q", "r"):
        n = {"p": 60, "q": 8, "r": 1}[p]
        for k in range(n):
            title = rng.choice(["", f"Title {rng.randrange(40)}", "The paper itself"])
            rows.append((p, k, "citing" if k < n // 3 else "search", title, rng.choice([None, 1990, 2010, 2015, 2016, 2020]), rng.choice(["", f"10.1/{rng.randrange(40)}", "10.1/own"]), "J", rng.choice(["Roe A", "Poe B, Roe A", ""])))
    return rows


def tables(spark):
    papers = spark.createDataFrame([(p, "The paper itself", "10.1/OWN", 2015 if p != "q" else None) for p in "pqr"], "paper string, paper_title string, paper_doi string, paper_year int")
    refs = spark.createDataFrame([(p, f"10.1/{k}", f"roe-{1990 + k}") for p in "pq" for k in range(0, 30, 3)] + [("r", None, None)], "paper string, doi string, slug string")
    return papers, refs


def batch(spark, rows):
    newer, overlooked = scout.registers(spark.createDataFrame(rows, FOUND), *tables(spark))
    return sorted([("newer", *r) for r in newer.select(*COLUMNS).collect()] + [("overlooked", *r) for r in overlooked.select(*COLUMNS).collect()], key=str)


def streamed(spark, folder, parts, runs):
    """Each part a micro-batch, the runs one after the other over one checkpoint."""
    papers, refs = tables(spark)
    at = iter(parts)
    for n in runs:
        for _ in range(n):
            spark.createDataFrame(next(at), FOUND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        found = spark.readStream.schema(FOUND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = G.register_stream(found, papers, refs, f"{folder}/out", f"{folder}/checkpoint")
        query.awaitTermination(240)
        assert query.exception() is None
    return sorted([(r.register, *(r[c] for c in COLUMNS)) for r in G.current(spark, f"{folder}/out").collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_and_a_restart(spark, tmp_path, seed):
    rows, rng = hits(seed), random.Random(seed)
    if seed == 2:
        rng.shuffle(rows)  # hits that belong before others come later
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    parts[2] = parts[2] + parts[0][:5]  # some arrive again
    wanted = batch(spark, rows)
    assert wanted and streamed(spark, tmp_path, parts, [2, 2]) == wanted
