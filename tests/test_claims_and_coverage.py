from pyspark.sql import functions as F

from marginalia.functions import judgement as J
from marginalia.functions import labels as L
from marginalia.operators import claims as C
from marginalia.operators import coverage as V
from marginalia.sources import seams

BODY = "Rain [3, 4] and snow [11-13]; [20] then [31–33] in (1998).\n\n## References\n\n[77] x"
CLAIMS = "paper string, id int, claim string, location string, refs array<string>"
REFS = "paper string, ord int, num string, status string, slug string"


def test_labels(spark):
    def labels(text):
        return spark.createDataFrame([(text,)], "t string").select(L.labels_in_text(F.col("t"))).first()[0]

    assert labels(BODY) == ["3", "4", "11", "12", "13", "20", "31", "32", "33"]
    assert labels("[5-2] [1-90] [07]") == ["07"]
    assert labels("none") == [] and labels("") == []


def test_coverage(spark):
    texts = spark.createDataFrame([("p", BODY), ("q", "bare")], "paper string, clean_md string")
    claims = spark.createDataFrame([("p", 1, "a", "", ["3", "4"]), ("p", 2, "b", "", ["11", "12", "13"])], CLAIMS)
    rows = {r.paper: r for r in V.coverage_audit(texts, claims).collect()}
    assert rows["p"].missing == ["20", "31", "32", "33"] and rows["p"].covered == ["3", "4", "11", "12", "13"] and rows["p"].status == "missing"
    assert rows["q"].status == "not audited"


def test_failed_check_is_no_gap(spark):
    claims = spark.createDataFrame([("p", 1, "a", "M", ["1"]), ("p", 2, "b", "M", ["9"]), ("p", 3, "c", "M", [])], CLAIMS)
    refs = spark.createDataFrame([("p", 1, "1", "retrieved", "good-2020")], REFS)
    routed = C.route(claims, refs)
    sources = spark.createDataFrame([("p", "good-2020", "text")], "paper string, slug string, annotated_md string")

    def fails(prompt):
        raise RuntimeError("down")

    answers = seams.ask(C.prompts(claims, routed, sources, "<<CLAIMS>> <<SLUG>> <<SOURCE>>"), fails)
    assert [(r.slug, r.attempts) for r in answers.collect()] == [("good-2020", 2)]
    rows = {r.id: r for r in C.merge_verdicts(routed, answers).collect()}
    assert rows[1].verdict == "unchecked" and "source WAS retrieved" in rows[1].note
    assert rows[2].verdict == "not_retrieved" and "unknown ref" in rows[2].note
    assert rows[3].verdict == "not_retrieved"


def test_missing_verdict(spark):
    claims = spark.createDataFrame([("p", 1, "a", "M", ["1"]), ("p", 2, "b", "M", ["1"])], CLAIMS)
    routed = C.route(claims, spark.createDataFrame([("p", 1, "1", "provided", "s")], REFS))
    answers = spark.createDataFrame([("p", "s", '```json\n[{"id":1,"verdict":"supported"},{"id":1,"note":"last"}]\n```', None)], "paper string, slug string, raw string, error string")
    rows = {r.id: r for r in C.merge_verdicts(routed, answers).collect()}
    assert (rows[1].verdict, rows[1].note) == ("partial", "last")
    assert rows[2].verdict == "unchecked"


def test_fenced_object(spark):
    raw = '```json\n{"cited":[{"id":1,"claim":"x","refs":["1"]}],"uncited":[]}\n```'
    cited, uncited = C.extracted(spark.createDataFrame([("p", raw), ("q", "nothing")], "paper string, raw string"))
    assert [(r.paper, r.claim, r.location, r.refs) for r in cited.collect()] == [("p", "x", "", ["1"])]
    assert uncited.collect() == []


def test_labels_of_verdicts(spark):
    rows = spark.createDataFrame([("supported",), ("odd",)], "v string").select(J.verdict_label(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["✅ SUPPORTED", "ODD"]
