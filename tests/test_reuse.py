"""A stage runs for the papers whose inputs have changed, and for no other."""

from pyspark.sql import functions as F

from marginalia.plans import reuse

BLOCKS = "paper string, seq int, text string"


def blocks(spark, **changed):
    rows = [(f"p{k}", n, changed.get(f"p{k}_{n}", f"text {k} {n}")) for k in range(6) for n in range(5)]
    return spark.createDataFrame(rows, BLOCKS)


def run(spark, path, rows, asked, version="1", template="ASK"):
    """Two stages, the second on the first; ``asked`` gets the papers that each is run for."""
    store = reuse.Store(spark, path)
    first = reuse.keys(rows, "extract", version, {"blocks": reuse.content(rows)}, template)

    def extract(papers):
        asked.append(("extract", sorted(r.paper for r in papers.collect())))
        return rows.join(papers, "paper").groupBy("paper").agg(F.max("text").alias("claim"))

    claims = store.run("extract", first, extract)

    def judge(papers):
        asked.append(("judge", sorted(r.paper for r in papers.collect())))
        return claims.join(papers, "paper").where("paper <> 'p5'").withColumn("verdict", F.lit("supported"))

    judged = store.run("judge", reuse.keys(rows, "judge", "1", {"claims": first}), judge)
    return {r.paper: r.claim for r in judged.collect()}


def test_one_changed_block_reruns_its_paper_alone(spark, tmp_path):
    path, asked = str(tmp_path), []
    every = [f"p{k}" for k in range(6)]
    first = run(spark, path, blocks(spark), asked)
    assert asked == [("extract", every), ("judge", every)] and sorted(first) == every[:5]  # p5 has no rows, and is done
    asked.clear()
    assert run(spark, path, blocks(spark).orderBy(F.desc("text")), asked) == first and asked == []
    found = run(spark, path, blocks(spark, p2_4="text 2 9"), asked)
    assert asked == [("extract", ["p2"]), ("judge", ["p2"])] and found == first | {"p2": "text 2 9"}
    asked.clear()
    assert run(spark, path, blocks(spark), asked) == first and asked == []  # back again
    run(spark, path, blocks(spark), asked, template="ASK AGAIN")
    assert asked == [("extract", every), ("judge", every)]
    asked.clear()
    run(spark, path, blocks(spark), asked, version="2")
    assert asked == [("extract", every), ("judge", every)]


def test_contents(spark):
    def digest(rows, schema=BLOCKS):
        return {r.paper: r.digest for r in reuse.content(spark.createDataFrame(rows, schema)).collect()}

    one = digest([("a", 1, "x"), ("a", 2, None), ("b", 1, "x")])
    assert one == digest([("b", 1, "x"), ("a", 2, None), ("a", 1, "x")])
    assert one["a"] != digest([("a", 1, "x"), ("a", 2, "")])["a"] and one["a"] != digest([("a", 1, "x"), ("a", 2, None), ("a", 2, None)])["a"]
    assert one["b"] != digest([("b", 1, "x", None)], BLOCKS + ", more string")["b"]
    assert digest([]) == {}


def test_states(spark):
    done = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "paper string, key string")
    wanted = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "1")], "paper string, key string")
    assert {r.paper: r.state for r in reuse.states(wanted, done).collect()} == {"a": "same", "b": "changed", "c": "new"}


def test_no_papers(spark, tmp_path):
    rows = spark.createDataFrame([], BLOCKS)
    assert run(spark, str(tmp_path), rows, []) == {}
