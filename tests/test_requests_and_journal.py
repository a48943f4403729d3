"""Each address asked once, hosts at their pace, and runs that go on where they were lost."""

import json
import sys
import threading
import time
from collections import Counter, defaultdict
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from marginalia.plans import retrieve as P
from marginalia.plans.journal import Journal
from marginalia.sources import http, seams
from marginalia.sources.request_ledger import RequestLedger

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find this module
REFS = "paper string, ord int, num string, raw string, doi string, slug string"


def noted(log, answer):
    """A web whose requests are noted with their times, as workers are processes of their own."""
    log = str(log)

    def get(url):
        with open(log, "a") as f:
            f.write(f"{time.time()} {url}\n")
        return answer(url)

    return get


def calls(log):
    return [(float(t), url) for t, url in (x.split(" ", 1) for x in open(log).read().splitlines())]


def ok(url):
    return 200, b"{}"


def test_a_thousand_references_of_one_address_are_one_request(spark, tmp_path):
    urls = spark.createDataFrame([("http://a/1",)] * 1000 + [("http://a/2",), (None,)], "url string").repartition(5)
    ledger = RequestLedger(spark, f"{tmp_path}/ledger", noted(tmp_path / "log", ok), pace=0.0)
    assert sorted((r.url, r.status, bytes(r.body)) for r in ledger.fetch(urls).collect()) == [("http://a/1", 200, b"{}"), ("http://a/2", 200, b"{}")]
    # another session, and more of the same
    again = RequestLedger(spark, f"{tmp_path}/ledger", noted(tmp_path / "log", ok), pace=0.0)
    assert again.fetch(spark.createDataFrame([("http://a/2",), ("http://b/3",)], "url string")).count() == 2
    assert sorted(u for _, u in calls(tmp_path / "log")) == ["http://a/1", "http://a/2", "http://b/3"]


def test_hosts_keep_their_pace(spark, tmp_path):
    pace = 0.15
    urls = spark.createDataFrame([(f"http://{h}/{k}",) for h in ("a", "b", "c") for k in range(6)], "url string")
    ledger = RequestLedger(spark, f"{tmp_path}/ledger", noted(tmp_path / "log", ok), pace=pace, round_size=7)
    assert ledger.fetch(urls).count() == 18
    ledger.fetch(spark.createDataFrame([("http://a/more",)], "url string")).count()
    by_host = defaultdict(list)
    for t, url in calls(tmp_path / "log"):
        by_host[url.split("/")[2]].append(t)
    assert Counter({h: len(t) for h, t in by_host.items()}) == {"a": 7, "b": 6, "c": 6}
    for times in by_host.values():
        assert min(b - a for a, b in zip(sorted(times), sorted(times)[1:], strict=False)) >= pace * 0.95


def test_refusals_wait_longer_and_end_as_rows(spark, tmp_path):
    def answer(url):
        if "busy" in url:
            return 429, b""
        if "lost" in url:
            raise ConnectionError
        return 404, b"no"

    ledger = RequestLedger(spark, f"{tmp_path}/ledger", noted(tmp_path / "log", answer), pace=0.05, tries=3)
    urls = spark.createDataFrame([("http://h/busy",), ("http://i/lost",), ("http://j/none",), ("no address",)], "url string")
    found = {r.url: (r.status, r.error) for r in ledger.fetch(urls).collect()}
    assert found == {"http://h/busy": (429, None), "http://i/lost": (None, "ConnectionError"), "http://j/none": (404, None), "no address": (404, None)}
    times = [t for t, u in calls(tmp_path / "log") if "busy" in u]
    assert len(times) == 3 and times[1] - times[0] >= 0.095 and times[2] - times[1] >= 0.19
    before = len(calls(tmp_path / "log"))
    ledger.fetch(urls).count()
    assert len(calls(tmp_path / "log")) == before
    ledger.fetch(urls, again=True).count()
    assert len(calls(tmp_path / "log")) == before + 6  # the two that had failed, three tries each


def test_nothing_to_ask(spark, tmp_path):
    ledger = RequestLedger(spark, f"{tmp_path}/ledger", ok)
    assert ledger.fetch(spark.createDataFrame([(None,)], "url string")).count() == 0 and ledger.rows().count() == 0


TITLE = "Tidal mixing narrow fjords"
ANSWERS = {"arxiv.org": b"%PDF|tidal mixing narrow fjords", "v2/10.1/open": {"best_oa_location": {"url_for_pdf": "http://pdf/right"}}, "wrong%22": {"resultList": {"result": [{"pmcid": "PMC9"}]}}, "pdf/right": b"%PDF|tidal mixing narrow fjords", "accid=PMC9": b"%PDF|tidal mixing narrow fjords", "api.crossref": {"message": {"items": []}}}


def service(url):
    for part, answer in ANSWERS.items():
        if part in url:
            return 200, answer if isinstance(answer, bytes) else json.dumps(answer).encode()
    return 404, b""


def references(spark, papers):
    rows = []
    for p in papers:
        rows += [(p, 1, "1", f"Aalto R. {TITLE}", None, "aalto-2019"), (p, 2, "2", f"Dembele O. {TITLE} arXiv:2105.04417", None, "dembele-2021"), (p, 3, "3", f"Roe B. {TITLE}", "10.1/open", "roe-2020"), (p, 4, "4", f"Poe C. {TITLE}", "10.1/wrong", "poe-2020")]
    return spark.createDataFrame(rows, REFS)


def run(spark, tmp_path, refs, get, journal=None):
    files = spark.createDataFrame([], "paper string, name string")
    out = P.retrieve(refs, files, get, lambda body: F.substring_index(body.cast("string"), "|", -1), "me@example.org", lambda df, _: seams.kept(df), journal)
    return sorted(map(tuple, out.select("paper", "ord", "status", "resolver").collect()))


class Lost(Exception):
    pass


class Breaking(Journal):
    def advance(self, stage, rows, make):
        if stage == "europepmc-lookup":
            raise Lost
        return super().advance(stage, rows, make)


def test_a_lost_run_goes_on_without_asking_twice(spark, tmp_path):
    refs = references(spark, ["p", "q"])
    wanted = run(spark, tmp_path, refs, noted(tmp_path / "plain", service))
    get = noted(tmp_path / "log", service)
    with pytest.raises(Lost):
        run(spark, tmp_path, refs, get, Breaking(spark, f"{tmp_path}/facts", P.STAGES))
    half = len(calls(tmp_path / "log"))
    assert half > 0
    assert run(spark, tmp_path, refs, get, Journal(spark, f"{tmp_path}/facts", P.STAGES)) == wanted
    asked = [u for _, u in calls(tmp_path / "log")]
    assert len(asked) == len(set(asked)) and all("europepmc" in u for u in asked[half:])
    assert sorted(asked) == sorted(u for _, u in calls(tmp_path / "plain"))


def test_later_references_are_a_further_version(spark, tmp_path):
    journal = Journal(spark, f"{tmp_path}/facts", P.STAGES)
    ledger = RequestLedger(spark, f"{tmp_path}/ledger", noted(tmp_path / "log", service), pace=0.0)
    run(spark, tmp_path, references(spark, ["p"]), ledger, journal)
    first = len(calls(tmp_path / "log"))
    both = references(spark, ["p", "q"])
    assert run(spark, tmp_path, both, ledger, journal) == run(spark, tmp_path, both, service)
    assert len(calls(tmp_path / "log")) == first  # the same addresses again
    history = journal.history()
    assert {(r.paper, r.version) for r in history.where("stage = 'arxiv'").collect()} == {("p", 0), ("q", 1)}
    assert history.groupBy("paper", "ord", "stage").count().where("count > 1").count() == 0
    present = {(r.paper, r.ord): (r.stage, r.found) for r in journal.present().collect()}
    assert present["q", 2] == ("arxiv", True) and present["p", 4] == ("europepmc", True)


def test_a_taken_version_is_an_error(spark, tmp_path):
    journal = Journal(spark, f"{tmp_path}/facts", ("x",))
    rows = spark.createDataFrame([("p", 1)], "paper string, ord int")
    journal.advance("x", rows, lambda r: r.withColumn("v", F.lit(1)))
    with pytest.raises(RuntimeError, match="another run"):
        journal._append("x", rows, rows.withColumn("v", F.lit(2)), None)
    assert journal.advance("x", rows, lambda r: r.withColumn("v", F.lit(3))).first().v == 1


def test_client_says_who_it_is_and_follows_few_redirects():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["User-Agent"]))
            to = {"/once": "/end", "/file": "file:///etc/passwd"}.get(self.path) or ("/loop" + self.path if self.path.startswith("/loop") else None)
            self.send_response(302 if to else 404 if self.path == "/none" else 200)
            if to:
                self.send_header("Location", to)
            self.end_headers()
            self.wfile.write(b"" if to else b"body")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at, get = f"http://127.0.0.1:{server.server_port}", http.client("me@example.org", 5)
        assert get(f"{at}/once") == (200, b"body") and get(f"{at}/none") == (404, b"body")
        assert get(f"{at}/file")[0] == 302
        n = len(seen)
        assert get(f"{at}/loop")[0] == 302 and len(seen) - n <= http.MOST_REDIRECTS + 2
        assert all("mailto:me@example.org" in a for _, a in seen)
        with pytest.raises(ValueError):
            get("file:///etc/passwd")
    finally:
        server.shutdown()


def test_hanging_calls_are_bounded():
    release = threading.Event()
    before = threading.active_count()
    for _ in range(seams.MOST_HUNG + 10):
        with pytest.raises(TimeoutError):
            seams.within(lambda _: release.wait(30), None, 0.001)
    assert threading.active_count() - before <= seams.MOST_HUNG
    release.set()
    time.sleep(0.5)
    assert seams.within(lambda x: x + 1, 1, 5) == 2


def test_calls_share_a_thread_until_one_is_late():
    on = [seams.within(lambda _: threading.current_thread(), None, 5) for _ in range(20)]
    assert len(set(on)) == 1
    with pytest.raises(KeyError):
        seams.within({}.__getitem__, "x", 5)
    with pytest.raises(TimeoutError):
        seams.within(lambda _: sys.exit(1), None, 5)
    release = threading.Event()
    with pytest.raises(TimeoutError):
        seams.within(lambda _: release.wait(30), None, 0.01)
    after = seams.within(lambda _: threading.current_thread(), None, 5)
    release.set()
    on[0].join(5)
    assert after not in on and not on[0].is_alive()


def test_requests_are_dealt_out_by_number(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("url")).distinct()
    parts = seams.fetch(rows, lambda url: (200, b"")).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in parts) == 200
