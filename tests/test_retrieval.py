from pyspark.sql import functions as F

from marginalia.operators import retrieval as W

REFS = "paper string, ord int, num string, raw string, doi string, slug string"
DOWN = "paper string, ord int, source string, http_status int, is_pdf boolean, first_page string"
RIGHT, WRONG = "imaging screening cohort results", "unrelated words"


def resolve(spark, doi, downloads=(), crossref=None, error=None, file=None):
    refs = spark.createDataFrame([("p", 1, "1", "Fixture F. Imaging screening cohort", doi, "fixture-2023")], REFS)
    files = spark.createDataFrame([("p", file)] if file else [], "paper string, name string")
    down = spark.createDataFrame([("p", 1, s, 200, True, page) for s, page in downloads], DOWN)
    looks = spark.createDataFrame([("p", 1, crossref, error)], "paper string, ord int, crossref_doi string, lookup_error string")
    return W.resolve(refs, W.match_provided(refs, files), down, looks).first()


def test_states(spark):
    assert resolve(spark, None, [("unpaywall", RIGHT)], crossref="10.1/x").resolver == "unpaywall"
    assert resolve(spark, "10.1/x", [("europepmc", RIGHT)])[3:5] == ("retrieved", "europepmc")
    assert resolve(spark, None, [("arxiv", RIGHT)])[3:5] == ("retrieved", "arxiv")
    r = resolve(spark, "10.1/x")
    assert r.status == "paywalled" and "no legal open-access copy" in r.reason
    assert resolve(spark, None).status == "no_doi"
    assert resolve(spark, None, file="fixture-et-al-2023-synthetic-method.pdf")[3:5] == ("provided", "user")
    r = resolve(spark, "10.1/x", [("unpaywall", WRONG)])
    assert r.status == "mismatch" and "different paper" in r.reason
    assert resolve(spark, "10.1/x", [("unpaywall", "")]).status == "retrieved"
    assert resolve(spark, "10.1/x", [("unpaywall", WRONG), ("europepmc", RIGHT)])[3:5] == ("retrieved", "europepmc")
    assert resolve(spark, None, [("arxiv", WRONG)]).status == "no_doi"
    assert resolve(spark, "10.1/x", error="ReadTimeout")[3:6] == ("error", None, "network: ReadTimeout")
    assert resolve(spark, None, crossref="10.1/y").resolver == "crossref"


def test_short_tokens_do_not_match(spark):
    refs = spark.createDataFrame([("p", 1, "1", "Du", None, "du-2023"), ("p", 2, "2", "Li", None, "li")], REFS)
    files = spark.createDataFrame([("p", "zz-2023.pdf"), ("p", "aa-2023.pdf")], "paper string, name string")
    assert [(r.ord, r.file) for r in W.match_provided(refs, files).collect()] == [(1, "aa-2023.pdf")]


def test_bodies(spark):
    row = spark.createDataFrame([(200, '{"message":{"items":[]}}', '{"best_oa_location":null}', '{"resultList":{"result":[{"pmcid":"PMC1"}]}}')], "s int, a string, b string, c string")
    out = row.select(W.crossref_doi(F.col("a")), W.unpaywall_url(F.col("s"), F.col("b")), W.epmc_url(F.col("s"), F.col("c")), W.is_pdf(F.col("s"), F.lit(b"%PDF-1"))).first()
    assert out[0] is None and out[1] is None and out[2].endswith("accid=PMC1&blobtype=pdf") and out[3]
