import json
import uuid

import pytest
from pyspark.sql import functions as F

from marginalia import schemas as S
from marginalia.functions import geometry as G
from marginalia.operators import evidence as E
from marginalia.operators import html as H
from marginalia.operators import ingest as I
from marginalia.operators import references as R
from marginalia.operators import report as P
from marginalia.plans import audit
from marginalia.sources import case, json_files, seams
from marginalia.streaming import arrivals

BOX = (1.0, 2.0, 3.0, 4.0)


def raw(spark, rows):
    return spark.createDataFrame([("p", i, 0, 1, BOX, t, s) for i, (t, s) in enumerate(rows)], S.RAW_BLOCKS)


def test_flat_page(spark):
    rows = raw(spark, [("Title of it all", 16.0), ("Abstract", 13.0), ("Body text", 10.0), ("", 9.0), ("References", 13.0), ("1. Aalto", 9.0), ("2. Castell", 9.0), ("Appendix", 13.0), ("Dice", 10.0)])
    blocks = I.flat_blocks(rows)
    assert [(r.id, r.type) for r in blocks.orderBy("seq").collect()][:3] == [("block_0001", "sectionheader"), ("block_0002", "sectionheader"), ("block_0003", "text")]
    assert R.references_section(blocks).first().section == "1. Aalto\n2. Castell"
    assert I.paper_title(blocks).first().title == "Title of it all"
    text = I.markdown(blocks).first()
    assert text.clean_md.startswith("## Title of it all\n\n## Abstract\n") and "Body text  <!-- block_0003, page 1 -->" in text.annotated_md


def test_flip(spark):
    def flip(origin):
        return tuple(spark.range(1).select(G.to_top_left(*(F.lit(float(x)) for x in (50, 800, 300, 760)), F.lit(origin), F.lit(842.0)).alias("b")).first().b)

    assert flip("CoordOrigin.BOTTOMLEFT") == (50, 42, 300, 82)
    assert flip("TOPLEFT") == (50, 760, 300, 800)


def test_layout(spark):
    def item(seq, label, kind, text="", table=None, caption=None, page=1):
        return ("p", seq, label, kind, text, table, caption, page, 842.0, 0.0, 10.0, 5.0, 1.0, "BOTTOMLEFT")

    rows = [item(0, "section_header", "SectionHeaderItem", "Results"), item(1, "DocItemLabel.TEXT", "TextItem", "body  text"), item(2, "table", "TableItem", table="|a|", caption="T1"), item(3, "picture", "PictureItem", caption="Fig"), item(4, "list_item", "ListItem", "first item"), item(5, "page_footer", "TextItem", "foot"), item(6, "text", "TextItem", "x", page=None), item(7, "list_item", "ListItem", "")]
    blocks = I.layout_blocks(spark.createDataFrame(rows, S.LAYOUT_ITEMS)).orderBy("seq").collect()
    assert [b.type for b in blocks] == ["sectionheader", "text", "table", "picture", "list", "list"]
    assert [b.id for b in blocks] == [f"block_000{k}" for k in range(1, 7)]
    assert blocks[1].heading_path == ["Results"] and blocks[1].text == "body text"
    assert blocks[2].text == "**T1**\n\n|a|" and blocks[3].text == "[FIGURE: Fig]" and blocks[4].text == "- first item" and blocks[5].text == "- "


def test_backends():
    assert seams.backend("auto", True) == "docling" and seams.backend("auto", False) == "pymupdf" and seams.backend("pymupdf", True) == "pymupdf"
    with pytest.raises(RuntimeError):
        seams.backend("docling", False)


def test_files_and_decoder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one|two")
    (tmp_path / "b.txt").write_bytes(b"no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"%PDF")
    files = seams.pdf_files(spark, str(tmp_path), content=True)
    assert [r.name for r in files.collect()] == ["a.pdf"]
    rows = seams.decode(files.select(F.col("name").alias("paper"), "content"), lambda b: [(1, 0, 0.0, 0.0, 1.0, 1.0, t, 10.0) for t in b.decode()[5:].split("|")])
    assert [(r.paper, r.seq, r.text) for r in rows.orderBy("seq").collect()] == [("a.pdf", 0, "one"), ("a.pdf", 1, "two")]


def test_fetch_failures_are_rows(spark):
    def get(url):
        if "bad" in url:
            raise TimeoutError
        return 200, b"%PDF"

    rows = seams.fetch(spark.createDataFrame([("1", "http://good"), ("2", "http://bad")], "key string, url string"), get)
    assert [(r.status, r.error) for r in rows.orderBy("key").collect()] == [(200, None), (None, "TimeoutError")]


def test_calls_have_a_time_limit(spark):
    import time

    def slow(_):
        time.sleep(5)

    def odd(_):
        raise KeyError("client")

    began = time.time()
    one = spark.createDataFrame([("1", "http://x")], "key string, url string")
    assert seams.fetch(one, slow, 0.2).first().error == "TimeoutError"
    assert seams.fetch(one, odd).first().error == "KeyError"
    asked = seams.ask(spark.createDataFrame([("p", "s", "?")], "paper string, slug string, prompt string"), slow, 0.2).first()
    assert asked.attempts == 2 and asked.error.startswith("TimeoutError")
    assert time.time() - began < 5 + 5


def test_json_defaults_and_round_trip(spark, tmp_path):
    for name, body in {"a/results.json": {"manuscript": "m", "claims": [{"id": 1, "claim": "c", "location": "l"}]}, "a/source_map.json": {"doc": "d", "pages": 2, "blocks": [{"id": "block_0001", "type": "text", "page": 1, "bbox": [1, 2, 3, 4]}]}, "a/scout.json": {"paper": {"title": "t"}}}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    runs, claims, uncited = json_files.results(spark, f"{tmp_path}/*/results.json")
    assert runs.first().converter == "pymupdf" and runs.first().missing == [] and uncited.count() == 0
    assert (claims.first().verdict, claims.first().refs, claims.first().paper) == ("not_retrieved", [], "a")
    docs, blocks = json_files.source_maps(spark, f"{tmp_path}/*/source_map.json")
    assert docs.first().converter == "pymupdf" and blocks.first().heading_path == [] and blocks.first().text == ""
    assert json.loads(json_files.source_map_json(docs, blocks).first().json)["blocks"][0]["bbox"] == [1, 2, 3, 4]
    assert json.loads(json_files.results_json(runs, claims, uncited).first().json)["counts"]["not_retrieved"] == 1
    assert json_files.scouts(spark, f"{tmp_path}/*/scout.json").first().paper_title == "t"


def test_guard(spark):
    had = spark.createDataFrame([("case", "one.pdf")], "paper string, manuscript string")
    new = lambda name, paper="case": spark.createDataFrame([(paper, name)], had.schema)
    assert audit.guard(had, new("one.pdf")).count() == 1 and audit.guard(had, new("x.pdf", "fresh")).count() == 1
    with pytest.raises(ValueError):
        audit.guard(had, new("two.pdf"))
    with pytest.raises(ValueError):
        audit.contact(None, ("NO_SUCH_VARIABLE",))


def test_evidence(spark):
    claims = spark.createDataFrame([("p", 1, "hoshino-2019", 1, "block_0001", ["salt wedges move"])], "paper string, id int, source_slug string, source_page int, source_block string, anchor_phrases array<string>")
    words = spark.createDataFrame([("p", "hoshino-2019", 1, k, w, k * 10.0, 5.0, k * 10.0 + 8, 15.0) for k, w in enumerate("There the salt wedges move inland".split())], "paper string, slug string, page int, pos int, word string, x0 double, y0 double, x1 double, y1 double")
    hit = E.phrase_hits(claims, words).first()
    assert (hit.pos, tuple(hit.hit)) == (2, (20.0, 5.0, 48.0, 15.0))
    blocks = spark.createDataFrame([("p", "hoshino-2019", 0, "block_0001", 2, BOX)], f"paper string, slug string, seq int, id string, page int, bbox {S.BOX}")
    pages = spark.createDataFrame([("p", "hoshino-2019", 1, 612.0, 792.0)], "paper string, slug string, page int, width double, height double")
    crop = E.crops(claims, blocks, words, pages).first()
    assert crop.file == "claim_01_hoshino-2019_p1.png" and len(crop.boxes) == 1 and crop.zoom == 8.0


def test_draw_and_case(spark, tmp_path):
    crops = spark.createDataFrame([("p", 1, "s-2020", 2, "a.png", BOX, 2.0, [BOX])], f"paper string, id int, source_slug string, source_page int, file string, region {S.BOX}, zoom double, boxes array<{S.BOX}>")
    files = spark.createDataFrame([("p", "s-2020", bytearray(b"%PDF"))], "paper string, slug string, content binary")
    row = seams.draw(crops, files, lambda pdf, page, region, zoom, boxes: pdf + b"%d %d" % (page, len(boxes))).first()
    assert (row.file, bytes(row.png)) == ("a.png", b"%PDF2 1")
    assert case.init(spark, str(tmp_path / "c")) == list(case.FOLDERS) and case.init(spark, str(tmp_path / "c")) == []


def test_pages(spark):
    claims = spark.createDataFrame([("p", 1, "a <b>", "M §1", ["1"], "supported", "n", "s-1", 2, "b", [], "e.png"), ("p", 2, "gap", "M §2", ["2"], "not_retrieved", "", None, None, None, [], None)], S.CLAIMS)
    uncited = spark.createDataFrame([("p", 1, "said", "")], S.UNCITED)
    coverage = spark.createDataFrame([("p", ["1"], ["1"], [], "all covered")], "paper string, labels_in_text array<string>, covered array<string>, missing array<string>, status string")
    hits = spark.createDataFrame([("p", k, "search", f"hit {k:02d}.", 2021, "", "J", "", k) for k in range(1, 13)], S.HITS + ", rank int")
    for look, newer, overlooked in (("editor", 10, 8), ("terminal", 8, 6)):
        page = H.pages(claims, uncited, coverage, hits, hits, look).first().html
        assert page.count("newer ·") == newer and page.count("overlooked ·") == overlooked and "Full lists" in page
        assert "a &lt;b&gt;" in page and "[U1] said" in page and "Not verified (1 of 2)" in page and '<img src="e.png">' in page
    assert "Full lists" not in H.pages(claims, uncited.limit(0), coverage.limit(0), hits.limit(0), hits.limit(0), "editor").first().html


def test_audit_end_to_end(spark):
    blocks = raw(spark, [("Introduction here", 14.0), ("A claim [1] and another [2].", 10.0), ("References", 14.0), ("1. Quist A. Gauges (2010)", 10.0), ("2. Okafor B. Weirs (2009)", 10.0)])
    refs = audit.parse_only(blocks).withColumns({"status": F.when(F.col("num") == "1", "retrieved").otherwise("paywalled"), "resolver": F.lit(None).cast("string"), "reason": F.lit("")})
    claims = spark.createDataFrame([("p", 1, "a claim", "Introduction ¶1", ["1"]), ("p", 2, "another", "Introduction", ["2"])], "paper string, id int, claim string, location string, refs array<string>")
    sources = spark.createDataFrame([("p", "quist-2010", "text")], "paper string, slug string, annotated_md string")
    done = audit.run(blocks, refs, claims, sources, "<<CLAIMS>>|<<SLUG>>|<<SOURCE>>", lambda _: '[{"id":1,"verdict":"supported","note":"n","source_page":1}]')
    assert {r.id: r.verdict for r in done.claims.collect()} == {1: "supported", 2: "not_retrieved"}
    assert done.coverage.first().status == "all covered"
    text = done.report.first().report
    assert "✅ SUPPORTED" in text and "1/2 sources available" in text and "**Introduction** (1)" in text
    assert P.verdict_counts(done.claims).first().asDict() == {"paper": "p", "supported": 1, "partial": 0, "contradicted": 0, "not_retrieved": 1, "unchecked": 0}


def test_whole_audit(spark, tmp_path):
    """From blocks to a report with retrieval, search, extraction, verdicts and crops behind replayed seams."""
    blocks = raw(spark, [("Rivers and their gauges", 14.0), ("Levels rose [1] and fell [2].", 10.0), ("References", 14.0), ("1. Quist A. Gauges (2010) arXiv:2105.04417", 10.0), ("2. Okafor B. Weirs (2009)", 10.0)])
    papers = spark.createDataFrame([("p", "m.pdf")], "paper string, manuscript string")
    files = spark.createDataFrame([], "paper string, name string")

    def get(url):
        return (200, b"%PDF") if "arxiv.org" in url else (404, b"")

    def judge(prompt):
        if prompt.startswith("EXTRACT"):
            return json.dumps({"cited": [{"id": 1, "claim": "rose", "location": "§1", "refs": ["1"]}, {"id": 2, "claim": "fell", "refs": ["2"]}], "uncited": [{"id": 1, "claim": "so it is"}]})
        return '[{"id":1,"verdict":"supported","note":"n","source_page":1,"anchor_phrases":["levels rose"]}]'

    def read(refs):
        words = spark.createDataFrame([("p", "quist-2010", 1, k, w, k * 10.0, 5.0, k * 10.0 + 8, 15.0) for k, w in enumerate("here levels rose".split())], "paper string, slug string, page int, pos int, word string, x0 double, y0 double, x1 double, y1 double")
        pages = words.select("paper", "slug", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).distinct()
        own = spark.createDataFrame([], f"paper string, slug string, seq int, id string, page int, bbox {S.BOX}")
        return audit.Sources(spark.createDataFrame([("p", "quist-2010", "text")], "paper string, slug string, annotated_md string"), own, words, pages)

    def keep(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    outside = audit.Outside(get, judge, lambda body: F.lit(""), read, keep)
    runs = spark.createDataFrame([("p", "model judge · x", "2024-05-06", "m.pdf", "pymupdf")], "paper string, checker string, date string, manuscript string, converter string")
    done = audit.audit(blocks, papers, papers.limit(0), files, outside, "EXTRACT <<MANUSCRIPT>>", "<<CLAIMS>>|<<SLUG>>|<<SOURCE>>", "me@example.org", runs)
    assert {r.num: r.status for r in done.refs.collect()} == {"1": "retrieved", "2": "no_doi"}
    assert {r.id: (r.verdict, r.evidence_image) for r in done.claims.collect()} == {1: ("supported", "evidence/claim_01_quist-2010_p1.png"), 2: ("not_retrieved", None)}
    assert done.scout_errors.first().error == "paper not identified"
    text = done.report.first().report
    for part in ("Checker: model judge · x · 2024-05-06", "Manuscript: m.pdf", P.FLAT_NOTE, "![evidence](evidence/claim_01_quist-2010_p1.png)", "## Assertions without citation (1)", "**[U1]** so it is", "> Scan incomplete: paper not identified", "1/2 sources available"):
        assert part in text
    with pytest.raises(ValueError):
        audit.audit(blocks, papers, papers.withColumn("manuscript", F.lit("other.pdf")), files, outside, "", "", "me@example.org")


def test_an_audit_reads_and_asks_once(spark, tmp_path):
    rows = raw(spark, [("Rivers and their gauges", 14.0), ("Levels rose [1] and fell [2].", 10.0), ("References", 14.0), ("1. Quist A. Gauges (2010) arXiv:2105.04417", 10.0), ("2. Okafor B. Weirs (2009)", 10.0)])
    (tmp_path / "calls").mkdir()
    log = lambda what: open(f"{tmp_path}/calls/{uuid.uuid4().hex}-{what}", "x").close()

    def passed(batches):
        log("read")
        yield from batches

    def judge(prompt):
        if prompt.startswith("EXTRACT"):
            log("extract")
            return '{"cited":[{"id":1,"claim":"rose","location":"","refs":["1"]}],"uncited":[]}'
        log("check")
        return '[{"id":1,"verdict":"supported","note":"n"}]'

    papers = spark.createDataFrame([("p", "m.pdf")], "paper string, manuscript string")
    texts = spark.createDataFrame([("p", "quist-2010", "text")], "paper string, slug string, annotated_md string")
    outside = audit.Outside(lambda url: (200, b"%PDF") if "arxiv.org" in url else (404, b""), judge, lambda body: F.lit(""), lambda refs: audit.Sources(texts), lambda df, _: seams.kept(df))
    done = audit.audit(rows.coalesce(1).mapInPandas(passed, rows.schema), papers, papers.limit(0), spark.createDataFrame([], "paper string, name string"), outside, "EXTRACT <<MANUSCRIPT>>", "<<CLAIMS>>|<<SLUG>>|<<SOURCE>>", "me@example.org")
    assert [(r.id, r.verdict) for r in done.claims.collect()] == [(1, "supported")]
    calls = [f.name.split("-")[1] for f in (tmp_path / "calls").iterdir()]
    assert sorted(calls) == ["check", "extract", "read"]


def test_stream_repeats_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "paper string, clean_md string"
    spark.createDataFrame([("a", "x [1]"), ("b", "y [2-3]")], schema).write.parquet(source)
    for more in ([], [("b", "changed"), ("c", "z")]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(source)
        arrivals.audit_stream(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp")).awaitTermination()
    assert {r.paper: r.labels_in_text for r in arrivals.audited(spark, out).collect()} == {"a": ["1"], "b": ["2", "3"], "c": []}
