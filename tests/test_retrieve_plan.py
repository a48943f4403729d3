import json

from pyspark.sql import functions as F

from marginalia.plans import retrieve as P

REFS = "paper string, ord int, num string, raw string, doi string, slug string"


def keeper(tmp_path):
    def keep(df, name):
        path = f"{tmp_path}/{name}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return keep


def first_page(body):
    return F.substring_index(body.cast("string"), "|", -1)


def web_of(log, answers):
    """Answers by address; each request is noted in a file, as workers are processes of their own."""
    log = str(log)

    def get(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        for part, answer in answers.items():
            if part in url:
                if answer == "down":
                    raise TimeoutError
                return 200, answer if isinstance(answer, bytes) else json.dumps(answer).encode()
        return 404, b""

    return get


def test_chain(spark, tmp_path):
    title = "Tidal mixing narrow fjords"
    refs = spark.createDataFrame(
        [
            ("p", 1, "1", f"Aalto R. {title}", None, "aalto-2019"),
            ("p", 2, "2", f"Dembele O. {title} arXiv:2105.04417", None, "dembele-2021"),
            ("p", 3, "3", f"Roe B. {title}", "10.1/open", "roe-2020"),
            ("p", 4, "4", f"Poe C. {title}", "10.1/wrong", "poe-2020"),
            ("p", 5, "5", f"Coe D. {title}", None, "coe-2020"),
            ("p", 6, "6", f"Moe E. {title}", "10.1/down", "moe-2020"),
        ],
        REFS,
    )
    right, wrong = b"%PDF|tidal mixing narrow fjords", b"%PDF|unrelated"
    offer = lambda url: {"best_oa_location": {"url_for_pdf": url}}
    web = web_of(tmp_path / "log", {"arxiv.org": right, "v2/10.1/open": offer("http://pdf/right"), "v2/10.1/wrong": offer("http://pdf/wrong"), "v2/10.1/down": "down", "wrong%22": {"resultList": {"result": [{"pmcid": "PMC9"}]}}, "pdf/right": right, "pdf/wrong": wrong, "accid=PMC9": right, "api.crossref": {"message": {"items": []}}})
    files = spark.createDataFrame([("p", "aalto-2019.pdf")], "paper string, name string")
    rows = P.retrieve(refs, files, web, first_page, "me@example.org", keeper(tmp_path)).orderBy("ord").collect()
    assert [(r.status, r.resolver) for r in rows] == [("provided", "user"), ("retrieved", "arxiv"), ("retrieved", "unpaywall"), ("retrieved", "europepmc"), ("no_doi", None), ("error", None)]
    asked = open(tmp_path / "log").read().split()
    assert sum("crossref" in u for u in asked) == 1 and sum("europepmc/webservices" in u for u in asked) == 1
    assert sum("arxiv" in u for u in asked) == 1 and len(asked) == len(set(asked))


def hits(*rows):
    return [{"title": t, "pubYear": y, "doi": d, "authorString": ""} for t, y, d in rows]


def test_scout(spark, tmp_path):
    me = {"resultList": {"result": [{"id": "7", "source": "MED", "title": "Deep learning radiograph triage.", "doi": "10.1/me", "pubYear": "2020"}]}}
    web = web_of(tmp_path / "log", {"/MED/7/citations": {"citationList": {"citation": hits(("Citing", "2021", ""))}}, "DOI%3A%2210.1%2Fme": me, "deep%20AND%20learning": {"resultList": {"result": hits(("Later", "2022", "10.1/a"), ("Earlier", "2019", "10.1/b"), ("Cited", "2018", "10.1/C"))}}, "DOI%3A": {"resultList": {"result": []}}, "TITLE": {"resultList": {"result": []}}})
    papers = spark.createDataFrame([("p", "10.1/me", "x"), ("q", "10.1/none", "y")], "paper string, doi string, title string")
    refs = spark.createDataFrame([("p", "10.1/c", "z-2018")], "paper string, doi string, slug string")
    newer, overlooked, errors = P.scout_papers(papers, refs, web, keeper(tmp_path))
    assert [r.title for r in newer.orderBy("rank").collect()] == ["Later", "Citing"]
    assert [r.title for r in overlooked.collect()] == ["Earlier"]
    assert [tuple(r) for r in errors.collect()] == [("q", "paper not identified")]


def test_scout_fails_soft(spark, tmp_path):
    me = {"resultList": {"result": [{"id": "7", "source": "MED", "title": "Deep learning radiograph triage.", "doi": "10.1/me", "pubYear": "2020"}]}}
    web = web_of(tmp_path / "log", {"/MED/7/citations": {"citationList": {"citation": hits(("B", "2021", ""), ("A", "2023", ""))}}, "DOI%3A": me, "deep%20AND": "down"})
    papers = spark.createDataFrame([("p", "10.1/me", "x")], "paper string, doi string, title string")
    refs = spark.createDataFrame([], "paper string, doi string, slug string")
    newer, overlooked, errors = P.scout_papers(papers, refs, web, keeper(tmp_path))
    assert [r.title for r in newer.orderBy("rank").collect()] == ["B", "A"] and overlooked.count() == 0
    assert errors.first().error == "network: TimeoutError — scan incomplete"
